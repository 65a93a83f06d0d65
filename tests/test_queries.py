"""Registered queries: they run on the smallest tables, and a sample of each module equals its SQL in DuckDB."""

import glob
import os

import pytest

from fieldmill.plans.registry import collect

QUERIES, SQL = collect()
NAMES = [n for n in SQL if n[0] in "afpuz" or n.startswith(("w1", "x1", "l2", "g2", "d1"))][::3]


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
    assert a == b
