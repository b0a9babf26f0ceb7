"""Embedding of text columns, each distinct text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_distinct(df: DataFrame, text: str, embed: Callable[[Column], Column], model: str = "hash") -> DataFrame:
    """Add ``embedding``; ``embed`` may be a SQL expression or a pandas UDF.

    Keys are hashes of model and text. Copies collapse before the shuffle, so
    a text that makes up a third of the table is still embedded once. On the
    way back every key has one vector, so Spark may split the rows of a key
    that many copies share.
    """
    keyed = df.withColumn("_key", F.sha2(F.concat_ws("\x1f", F.lit(model), F.col(text)), 256))
    once = keyed.groupBy("_key").agg(F.first(text).alias("_text")).select("_key", embed(F.col("_text")).alias("embedding"))
    return keyed.join(once, "_key").drop("_key")
