"""Named queries against SQL of the same rows."""

import os

import duckdb
import pytest

from nearfield.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, DATA)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r[c] for c in names) for r in got.collect()) == key(tuple(r[want.columns.index(c)] for c in names) for r in want.fetchall())
