"""Queries with a SQL statement must agree with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gapscope.llm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(os.path.join(FOLDER, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rel = con.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    place = [list(rel.columns).index(c) for c in columns]
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(str(r[i]) for i in place) for r in rel.fetchall())
