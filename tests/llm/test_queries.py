import os

import duckdb
import pytest

from tidelot.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(registry.modules()[0].QUERIES))
def test_query(spark, name):
    m = registry.modules()[0]
    df = m.QUERIES[name](spark, SF)
    rows = df.collect()
    if name.endswith("_found") or name == "p8_ids":
        assert len(rows) == len({tuple(map(str, r)) for r in rows})
    if name in m.ORACLES:
        con = duckdb.connect()
        con.execute("set TimeZone = 'UTC'")
        for f in os.listdir(SF):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
        res = con.execute(m.ORACLES[name])
        cols = [c[0] for c in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(res.fetchall()) == sorted(tuple(r[c] for c in cols) for r in rows)


def test_beside_windows_has_the_stated_bounds(spark):
    r = registry.modules()[0].QUERIES["p2_beside_windows"](spark, SF).filter("estimate > 0").selectExpr("max((ci_high - ci_low) / estimate) AS width").first()
    assert 0 < r["width"] < 0.14  # 1.96 standard errors of 3.1 % to either side
