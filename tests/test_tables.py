"""Loads and memory build on odd rows, against their SQL twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from factloom.sources import tables

DOCUMENTS = [(n, "   " if n in (4, 38) else "" if n == 45 else f"text {n}", "en", f"src{n % 3}") for n in range(60)]


@pytest.mark.parametrize("name", ["s9_memory_build", "s9_memory_build_errors"])
def test_blank_documents_are_memories_as_in_the_sql(spark, tmp_path, name):
    spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = entry_module.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(want.fetchall())


def test_blank_rows_are_reported_unless_they_are_kept(spark):
    texts = spark.createDataFrame([("e", "d1", "some"), ("e", "d2", "  "), ("e", "d3", None), (" ", "d4", "some")], "entity_id string, document_id string, text string")
    chunks = texts.withColumn("index", F.lit(0))
    errors = lambda **how: {(r.document_id, r.error) for r in tables.build_memories(chunks, "2024-02-01 00:00:00", **how)[1].collect()}
    assert errors() == {("d2", "empty content"), ("d3", "empty content"), ("d4", "missing entity")}
    assert errors(keep_blank=True) == {("d3", "empty content"), ("d4", "missing entity")}
