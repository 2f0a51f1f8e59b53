"""Driver contract: entry(), queries() and oracle_sql() agree with DuckDB."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest
from conftest import SF0001

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem").split()
# every registered query of the reports (scripts/check_oracle.py runs the same at any scale); the
# training-data queries have tests of their own
ALL_KEYS = sorted(k for k in E.queries() if k != "pipeline" and not re.match(r"op\d+_", k))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "Payment Terms" and len(df.columns) == 17


def test_every_query_has_an_oracle():
    assert set(ALL_KEYS) == {k for k in E.oracle_sql() if not re.match(r"op\d+_", k)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SF0001) / (t + '.parquet')}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return (1, round(float(v), 6) if math.isfinite(float(v)) else str(v))
    if hasattr(v, "as_tuple"):
        return (1, round(float(v), 6))
    return (2, str(v))


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("key", ALL_KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF0001)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, srows) == _canon(ocols, orows)
