"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest
from llm_cases import SMALL

from strideflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
