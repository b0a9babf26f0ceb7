"""Training-data queries against their SQL twins in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from factloom.llm import catalog

SF = os.environ.get("FACTLOOM_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(str, r)) for r in cursor.fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == want
