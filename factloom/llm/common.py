"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import cut, prepare

#: Arrow batches are bounded by bytes as well as rows, so long texts come alone.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: The operators here were measured with broadcasts of files up to this size.
BATCH_CONF["spark.sql.autoBroadcastJoinThreshold"] = "10m"


def ready(spark: SparkSession) -> SparkSession:
    """Settings of the package, with batches small enough for whole texts."""
    prepare(spark)
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``cut``, and the shuffle files behind it may go.

    Executors drop a shuffle once the driver has collected its last reference;
    between large steps that is worth asking for, else all steps' files add up.
    """
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; columns passed on keep their exact values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """Whole texts of a column; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def same_row(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality of key columns in which null equals null."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def hidden(*names: str) -> list[str]:
    """Column names that no table has, one per name."""
    mark = uuid.uuid4().hex
    return [f"{n}_{mark}" for n in names]
