"""Every registered query against its DuckDB twin, whole tables of the smallest scale."""

import math

import duckdb
import pytest

from vidspark.checks import load
from vidspark.checks.views import TABLES

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def kind(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(kind(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(kind(row[names.index(c)]) for c in cols) for row in res.fetchall())
    assert got == want
