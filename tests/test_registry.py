"""The registry, and every core query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

import tailrace.plans  # noqa: F401
from tailrace.plans import core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v).replace("+00:00", "")
    return v


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    result = duck.execute(core.SQL[name])
    there = [x[0] for x in result.description]
    assert sorted(there) == names
    want = sorted(repr([plain(r[there.index(c)]) for c in names]) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
