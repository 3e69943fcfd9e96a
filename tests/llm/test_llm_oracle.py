"""Queries with SQL against DuckDB, row for row, on the smallest tables."""

import duckdb
import pytest

from featlake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
