"""Registered queries against their DuckDB counterparts on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def names():
    from docustrata.plans import catalog

    return sorted(catalog.ORACLES)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v if isinstance(v, (bool, int)) else str(v)[:19]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    own = [c[0] for c in cur.description]
    assert columns == sorted(own)
    want = sorted(repr([plain(r[own.index(c)]) for c in columns]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
