"""Every query with a SQL statement must agree with it on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gapscope.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(os.path.join(FOLDER, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (1, "")
    return (0, repr(v) if isinstance(v, float) else str(v))


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(SQL[name])
    columns = list(rel.columns)
    assert sorted(columns) == sorted(df.columns)
    assert got == normal([tuple(r) for r in rel.fetchall()], columns)


ROWS_ONLY = [
    "ks_mwu", "meta_random_effects_tails", "scan_jsonl", "sink_table", "sink_all_or_nothing",
    "sink_provenance", "expand_blocks", "preprocess_schema", "bootstrap_gap", "bootstrap_auroc",
    "cluster_vs_naive", "ipw_interval", "calibration_curve_ci", "permutation_group",
    "export_performance",
]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
