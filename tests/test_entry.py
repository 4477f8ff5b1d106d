"""The driver contract on the smallest tables, and every query's SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return list(v) if hasattr(v, "tolist") or isinstance(v, list) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def core():
    """Names of the library's own queries; the subpackage's are tested beside it."""
    from tidelot.plans import registry

    return sorted(k for m in registry.modules() for k in m.QUERIES)


@pytest.mark.parametrize("name", core())
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["lot_id", "window_start_us", "n_accepted", "n_rejected"]


def test_no_oracle_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
