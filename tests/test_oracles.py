"""Every query against its oracle SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from hearthline import plans as core  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, tables, name):
    out = core.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in out.collect())
    if name not in core.ORACLES:
        assert got
        return
    found = tables.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, row, strict=True))[c]) for c in columns]) for row in found.fetchall())
    assert got == want
