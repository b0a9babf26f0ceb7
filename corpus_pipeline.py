"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, packing, quality, secret_scan, simhash
from factloom.llm.common import ready, table
from factloom.session import cut


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that text and site mark as toxic or of low quality."""
    return quality.keep_good(docs, table(ready(spark), sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ready(spark)
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents made of them dropped."""
    return decontaminate.decontaminate(docs, table(ready(spark), sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the text."""
    ready(spark)
    return secret_scan.redact_secrets(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces by training sequence."""
    ready(spark)
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("near_copies", distinct_documents),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

#: Tokens, trained classifiers and SimHash groups are beyond SQL; tests replay the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
