"""Registered training-data queries that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from shelfage.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, key):
    got = queries.queries()[key](spark, SF)
    cur = duck.execute(queries.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(r) for r in cur.fetchall())
    assert want and want == Counter(tuple(r) for r in got.select(*names).collect())
