"""The llm queries against their DuckDB counterparts on the smallest tables."""

import os

import pytest
from test_queries import FOLDER, plain

from docustrata.llm import queries

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_llm_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = con.execute(queries.ORACLES[name])
    own = [c[0] for c in cur.description]
    assert columns == sorted(own)
    want = sorted(repr([plain(r[own.index(c)]) for c in columns]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
