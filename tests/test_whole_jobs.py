"""Queries run at the study's sizes and over whole tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from gapscope.operators import compare as C
from gapscope.operators import models as L
from gapscope.operators import permute as PM
from gapscope.operators import resample as RS
from gapscope.plans import modelling
from gapscope.plans.catalog import QUERIES, SQL


class Called(Exception):
    pass


SIZES = [
    ("bootstrap_rows", RS, "bootstrap_comparison", 1000), ("bootstrap_clusters", RS, "bootstrap_comparison", 1000),
    ("calibration_status_counts", RS, "bootstrap_comparison", 1000), ("bootstrap_gap", RS, "bootstrap_gap", 1000),
    ("bootstrap_auroc", RS, "bootstrap_comparison", 1000), ("bootstrap_auroc_gap", RS, "bootstrap_comparison", 1000),
    ("cluster_vs_naive", RS, "cluster_vs_naive", 1000), ("ipw_interval", RS, "ipw_interval", 500),
    ("calibration_curve_ci", RS, "calibration_curve_ci", 300), ("export_performance", RS, "bootstrap_comparison", 1000),
    ("permutation_outcome", PM, "outcome_permutation", 200), ("repeated_splits", L, "repeated_splits", list(range(10))),
]


@pytest.mark.parametrize("name, module, operator, size", SIZES)
def test_sizes_of_the_study(spark, monkeypatch, name, module, operator, size):
    def record(*args, **options):
        raise Called([*args, *options.values()])

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Called) as got:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert any(type(v) is type(size) and v == size for v in got.value.args[0])


def test_pool_of_the_study():
    assert (modelling.POOL.forest_trees, modelling.POOL.boosted_rounds) == (300, 300)


def test_columns_come_from_the_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, c string")
    assert sorted(r["column"] for r in C.filled_columns(df, "run").collect()) == ["a", "c"]
    assert C.filled_columns(df.limit(0), "run").collect() == []


@pytest.mark.parametrize("name", ["score_distribution_negatives", "project_blinded_all"])
def test_whole_tables_are_registered(name):
    assert name in QUERIES and name in SQL


@pytest.mark.parametrize("good, bad", [(1, 1), (3, 9), (40, 7), (1, 5000), (300, 200), (5, 10**12)])
def test_the_urn_sampler_is_exact(good, bad):
    """Its box holds every value's region, and its probabilities are the binomial coefficients'."""
    for n in {1, 2, min(good + bad, 17), (good + bad) // 2, good + bad - 1}:
        ns = np.array([n])
        low, high, mode, centre, width = (v[0] for v in RS.urn_shape(good, bad, ns))
        x = np.arange(low, high + 1)
        ones = np.ones_like(x)
        got = RS.urn_log_ratio(good, bad, n * ones, mode * ones, x)
        if good + bad < 10**4:
            choose = lambda k: math.comb(good, k) * math.comb(bad, n - k)
            want = [float(Fraction(choose(int(k)), choose(int(mode)))) for k in x]
            np.testing.assert_allclose(np.exp(got), want, rtol=1e-8, atol=1e-250)
        reach = np.maximum(np.abs(x - centre), np.abs(x + 1 - centre)) * np.exp(got / 2)
        assert (reach <= width / 2).all(), (n, (reach / width).max())


def test_the_urn_is_dealt_at_any_size():
    rng = np.random.default_rng(3)
    small = RS.hypergeometric(rng, 30, 50, np.full(40_000, 20))
    assert abs(small.mean() - 7.5) < 0.05 and abs(small.var() - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.1
    rare = RS.hypergeometric(rng, 3, 3 * 10**9, np.full(40_000, 10**9))
    assert abs((rare == 0).mean() - (2 / 3) ** 3) < 0.02 and rare.max() == 3
    half = 10**12
    large = RS.hypergeometric(rng, half, half, np.full(40_000, half))
    assert abs(large.mean() - half / 2) < 1e4 and abs(large.std() / (half / 8) ** 0.5 - 1) < 0.02
    assert not hasattr(RS, "URN_LIMIT")


def test_unconverged_permutations_are_null(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "AB"[i % 2], int(rng.random() < 0.4), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, g string, y_true int, x double")
    cut = PM.outcome_permutation(df, df, ["x"], "g", "A", "B", n_perm=10, steps=1).collect()
    assert len(cut) == 6 and all(r["null_mean"] is None and r["n_unconverged"] == 10 for r in cut)
    whole = PM.outcome_permutation(df, df, ["x"], "g", "A", "B", n_perm=10).collect()
    assert len(whole) == 6 and all(r["n_unconverged"] == 0 for r in whole)
    assert all(r["null_mean"] is not None for r in whole if r["metric"] == "auroc")


def test_a_narrow_band_of_scores_is_cut_into_buckets(spark):
    rows = spark.range(40_000).selectExpr(
        "'k' as k", "cast(id % 2 as tinyint) as _side", "0.5 + floor(id / 4) * 1e-9 as _prob",
        "cast(1 as tinyint) as _pred", "cast(floor(id / 2) % 2 as tinyint) as _y", "1L as _n",
    )
    got = RS._score_buckets(rows, ["k"])
    assert sorted(got.columns) == sorted([*rows.columns, "_b"]) and got.count() == 40_000
    spans = got.groupBy("_b").agg({"_n": "sum", "_prob": "max"}).orderBy("_b").collect()
    assert max(r["sum(_n)"] for r in spans) <= RS.BUCKET_MEMBERS and len(spans) == 20
    assert all(x["max(_prob)"] < y["max(_prob)"] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("range_rows", [400_000, 40])
def test_replicates_are_ranked_in_packed_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(PM, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(7)
    x, y = np.round(rng.normal(size=500), 1), rng.integers(0, 2, 500)
    slopes = np.array([1.0, -2.0, 0.0])
    df = spark.createDataFrame([(float(v), int(t)) for v, t in zip(x, y)], "x double, y int").repartition(3)
    got = PM.replicate_auroc(df, lambda pdf: np.abs(pdf[["x"]].to_numpy() * slopes) / 20, np.array([0, 1, 5], dtype=np.int32), "y").collect()
    score = np.abs(x[:, None] * slopes) / 20
    for r, j in ((0, 0), (1, 1), (5, 2)):
        d = score[y == 1, j][:, None] - score[y == 0, j][None, :]
        want = ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size
        assert {v["replicate"]: v["auroc"] for v in got}[r] == pytest.approx(want, abs=1e-12)
