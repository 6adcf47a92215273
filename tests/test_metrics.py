import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapscope.functions import tails
from gapscope.functions.columns import equal_width_bin, grid_index, linspace
from gapscope.operators import gaps as G
from gapscope.operators import intervals as I
from gapscope.operators import meta as X
from gapscope.operators import metrics as M
from gapscope.operators import ranking as K
from gapscope.operators import thresholds as H
from gapscope.operators.resample import calibration_fit


def scored(spark, n=400, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.02, 0.98, n)
    p = np.round(p, 2) if ties else p
    y = (rng.uniform(size=n) < p).astype(int)
    return pd.DataFrame(
        {"k": rng.integers(0, 2, n), "g": np.where(rng.uniform(size=n) < 0.4, "A", "B"), "y_true": y,
         "prob": p, "pred": (p >= 0.5).astype(int), "row_id": np.arange(n)}
    )


def brute_auroc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


def brute_ap(y, p):
    total, last = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        hit = (p >= t) & (y == 1)
        recall = hit.sum() / y.sum()
        total += (recall - last) * hit.sum() / (p >= t).sum()
        last = recall
    return total


@pytest.mark.parametrize("ties", [True, False])
def test_discrimination_equals_pair_count(spark, ties):
    pdf = scored(spark, ties=ties)
    got = {r["k"]: r for r in M.discrimination(spark.createDataFrame(pdf), ["k"]).collect()}
    for k, part in pdf.groupby("k"):
        y, p = part["y_true"].to_numpy(), part["prob"].to_numpy()
        assert got[k]["auroc"] == pytest.approx(brute_auroc(y, p), abs=1e-12)
        assert got[k]["auprc"] == pytest.approx(brute_ap(y, p), abs=1e-12)


def test_partitioning_and_order_do_not_matter(spark):
    df = spark.createDataFrame(scored(spark))
    one = sorted(map(tuple, M.subgroup_metrics(df, ["k", "g"]).collect()))
    two = sorted(map(tuple, M.subgroup_metrics(df.repartition(13).orderBy(F.rand(3)), ["k", "g"]).collect()))
    for a, b in zip(one, two):
        assert a == pytest.approx(b, abs=1e-12)


def test_one_class_extreme_and_constant_scores(spark):
    rows = [("neg", 0, 0.2), ("neg", 0, 0.4), ("flat", 0, 0.3), ("flat", 1, 0.3), ("ends", 0, 0.0), ("ends", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, y_true int, prob double")
    got = {r["k"]: r for r in M.discrimination(df, ["k"]).collect()}
    assert got["neg"]["auroc"] is None and got["neg"]["auprc"] is None
    assert got["flat"]["auroc"] == 0.5 and got["ends"]["auroc"] == 1.0


def test_bins_follow_the_edge_doubles(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.7, 0.9999, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = [r[0] for r in df.select(equal_width_bin("p")).collect()]
    edges = np.linspace(0, 1, 11)
    assert got == list(np.clip(np.digitize(values, edges) - 1, 0, 9))


@pytest.mark.parametrize("size", [99, 999, 25])
def test_grid_index_counts_points(spark, size):
    grid = linspace(0.01, 0.99, size)
    rng = np.random.default_rng(0)
    values = np.r_[grid, np.nextafter(grid, 0), np.nextafter(grid, 1), rng.uniform(-0.2, 1.2, 200)]
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    got = [r[0] for r in df.select(grid_index("p", grid)).collect()]
    assert got == [int((np.array(grid) <= v).sum()) for v in values]


@pytest.mark.parametrize("shape", ["uniform", "clustered", "ties"])
def test_exact_quantiles(spark, shape):
    rng = np.random.default_rng(3)
    v = {"uniform": rng.normal(0, 50, 501), "clustered": 1e6 + rng.uniform(-1e-3, 1e-3, 400),
         "ties": rng.integers(0, 4, 300).astype(float)}[shape]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    row = K.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.975, "lo": 0.0, "hi": 1.0}).first()
    for name, q in {"a": 0.1, "b": 0.5, "c": 0.975, "lo": 0.0, "hi": 1.0}.items():
        assert row[name] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-12)


def test_threshold_ties_are_positive_and_curve_matches(spark):
    pdf = scored(spark)
    got = H.threshold_curve(spark.createDataFrame(pdf), ["k"], H.SWEEP_GRID).collect()
    for r in got:
        part = pdf[pdf.k == r["k"]]
        flag = part.prob >= r["threshold"]
        assert r["tp"] == int((flag & (part.y_true == 1)).sum())
        assert r["tn"] == int((~flag & (part.y_true == 0)).sum())


def test_equal_sensitivity_example(spark):
    rows = list(zip(["g"] * 8, [1, 1, 1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.95, 0.55, 0.4, 0.1]))
    df = spark.createDataFrame(rows, "g string, y_true int, prob double")
    pick = lambda t: H.equal_sensitivity_threshold(df, ["g"], t).first()["threshold"]
    assert pick(0.5) == 0.8 and pick(1.0) == 0.6 and pick(0.0) == float("inf")
    with pytest.raises(ValueError):
        H.equal_sensitivity_threshold(df, ["g"], 1.2)
    with pytest.raises(Exception, match="no positive"):
        H.equal_sensitivity_threshold(df.where("y_true = 0"), ["g"], 0.5).collect()


def test_youden_returns_infinity_when_never_positive(spark):
    df = spark.createDataFrame([("g", 0, 0.9), ("g", 1, 0.1)], "g string, y_true int, prob double")
    assert H.youden_threshold(df, ["g"]).first()["threshold"] == float("inf")


def test_numeric_threshold_needs_permission():
    with pytest.raises(ValueError):
        H.fixed_threshold(0.4)
    with pytest.raises(ValueError):
        H.fixed_threshold(1.4, allow_nonprimary=True)
    assert H.fixed_threshold(0.4, allow_nonprimary=True) == 0.4


# Confusion counts and the published standardised gaps they imply.
COUNTS = [
    ("cdc", "A", 4411, 8757, 19196, 1247), ("cdc", "B", 5148, 10705, 25453, 1187),
    ("d130", "A", 876, 4391, 8050, 610), ("d130", "B", 1153, 5790, 8656, 654),
    ("brfss", "A", 5490, 14702, 40334, 1458), ("brfss", "B", 4044, 19571, 45502, 933),
    ("nhanes", "A", 134, 229, 458, 32), ("nhanes", "B", 121, 284, 469, 29),
    ("cchs", "A", 1301, 4371, 7423, 259), ("cchs", "B", 1189, 5541, 9463, 199),
]
GAPS = [
    ("cdc", "ppv", 0.1575869862, 0.0102452474, -0.0216110788, 310.937598),
    ("cdc", "npv", 0.1575869862, -0.0164418179, -0.0092055013, 44.011658),
    ("cdc", "predicted_positive_rate", 0.1575869862, 0.0187032897, 0.0092972273, 50.290951),
    ("d130", "ppv", 0.1091119947, 0.0002520456, 0.0066574748, -2541.377213),
    ("d130", "npv", 0.1091119947, -0.0001917529, -0.0032160503, -1577.184798),
    ("d130", "predicted_positive_rate", 0.1091119947, -0.0489964171, -0.0479351065, 2.166098),
    ("brfss", "ppv", 0.0903176455, 0.1006427687, 0.0155057546, 84.593275),
    ("brfss", "npv", 0.0903176455, -0.0147944572, -0.0017154218, 88.404970),
    ("brfss", "predicted_positive_rate", 0.0903176455, -0.0113548586, -0.0326053022, -187.148465),
    ("nhanes", "ppv", 0.1799544419, 0.0703805734, 0.0275874877, 60.802411),
    ("nhanes", "npv", 0.1799544419, -0.0070731907, 0.0041050207, 158.036335),
    ("nhanes", "predicted_positive_rate", 0.1799544419, -0.0229481252, -0.0358370723, -56.165578),
    ("cchs", "ppv", 0.0991057621, 0.0527007358, -0.0048705427, 109.241887),
    ("cchs", "npv", 0.0991057621, -0.0131190285, -0.0038034143, 71.008415),
    ("cchs", "predicted_positive_rate", 0.0991057621, 0.0141755206, -0.0010643678, 107.508492),
]


@pytest.fixture
def golden(spark):
    counts = spark.createDataFrame(COUNTS, "k string, g string, tp long, fp long, tn long, fn long")
    return G.pair_table(counts, ["k"], "g", "A", "B")


def test_published_standardised_gaps(golden):
    got = {(r["k"], r["metric"]): r for r in G.prevalence_adjusted_gap(golden, ["k"]).collect()}
    for k, m, target, raw, adj, att in GAPS:
        r = got[k, m]
        assert r["target_prevalence"] == pytest.approx(target, abs=1e-9)
        assert r["raw_gap"] == pytest.approx(raw, abs=1e-9)
        assert r["adjusted_gap"] == pytest.approx(adj, abs=1e-9)
        assert r["attenuation_pct"] == pytest.approx(att, abs=1e-5)


def test_shapley_parts_sum_and_ipw_equals_bayes(golden):
    for r in G.shapley_gap(golden, ["k"]).collect():
        assert r["check_sum"] == pytest.approx(r["raw_gap"], abs=1e-12)
    for r in G.ipw_prevalence(golden, ["k"]).collect():
        assert r["absolute_diff"] < 1e-12


def test_gaps_change_sign_when_groups_swap(spark):
    df = spark.createDataFrame(scored(spark))
    ab = G.gap_row(df, ["k"], "g", "A", "B").orderBy("k").collect()
    ba = G.gap_row(df, ["k"], "g", "B", "A").orderBy("k").collect()
    for a, b in zip(ab, ba):
        for c in ("sensitivity_gap", "fnr_gap", "ppv_gap_raw", "ppv_gap_adj", "ppr_gap"):
            assert a[c] == pytest.approx(-b[c], abs=1e-12)


def test_wilson_contains_points_and_is_null_without_trials(spark):
    df = spark.createDataFrame([("g", 2, 1, 2, 1), ("none", 0, 0, 3, 0)], "g string, tp long, fp long, tn long, fn long")
    for r in I.wilson_ci(df, ["g"]).collect():
        if r["denominator"]:
            assert 0 <= r["ci_low"] <= r["point"] <= r["ci_high"] <= 1
        else:
            assert r["point"] is None and r["ci_low"] is None and r["ci_high"] is None


def newton(y, p):
    x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    d, b = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]), d.T @ (y - mu))
    return b


def test_calibration_fit_and_its_statuses(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.05, 0.95, 1500)
    y = (rng.uniform(size=1500) < p).astype(int)
    frames = [
        pd.DataFrame({"k": "good", "y_true": y, "prob": p}),
        pd.DataFrame({"k": "separated", "y_true": (p > 0.5).astype(int), "prob": p}),
        pd.DataFrame({"k": "one_class", "y_true": 0, "prob": p[:50]}),
        pd.DataFrame({"k": "constant", "y_true": y[:200], "prob": 0.3}),
    ]
    got = {r["k"]: r for r in calibration_fit(spark.createDataFrame(pd.concat(frames)), ["k"]).collect()}
    a, b = newton(y, p)
    assert got["good"]["calib_status"] == "ok"
    assert got["good"]["calib_intercept"] == pytest.approx(a, abs=1e-8)
    assert got["good"]["calib_slope"] == pytest.approx(b, abs=1e-8)
    assert got["separated"]["calib_status"] in ("separation", "not_converged", "singular_information_matrix")
    assert got["separated"]["calib_slope"] is None
    assert got["one_class"]["calib_status"] == "single_class"
    assert got["constant"]["calib_status"] == "degenerate_predictor"


def test_tail_functions():
    assert tails._normal_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert tails._chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails._chi2_sf(12.591587243743977, 6) == pytest.approx(0.05, abs=1e-10)
    assert tails._chi2_sf(14.067140449340169, 7) == pytest.approx(0.05, abs=1e-10)
    assert tails._t_quantile(0.975, 1) == pytest.approx(12.706204736174698, rel=1e-9)
    assert tails._t_quantile(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-9)
    assert tails._t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)


def test_bh_q_values_and_nulls(spark):
    p = [0.001, 0.02, None, 0.03, 0.9]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(p)], "f int, i int, p_value double")
    got = {r["i"]: r for r in X.bh_fdr(df, ["f"]).collect()}
    assert got[0]["q_value"] == pytest.approx(0.004) and got[1]["q_value"] == pytest.approx(0.04)
    assert got[3]["q_value"] == pytest.approx(0.04) and got[4]["q_value"] == pytest.approx(0.9)
    assert got[2]["q_value"] is None and got[2]["rank"] is None and not got[2]["significant_bh"]


def test_rank_separation_is_the_pair_probability(spark):
    pdf = scored(spark)
    r = M.rank_separation(spark.createDataFrame(pdf).where("k = 0"), ["k"], "g", "A", "B").first()
    part = pdf[pdf.k == 0]
    a, b = part.prob[part.g == "A"].to_numpy(), part.prob[part.g == "B"].to_numpy()
    d = a[:, None] - b[None, :]
    assert r["prob_a_higher"] == pytest.approx(((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size)
    grid = np.unique(part.prob)
    ks = max(abs((a <= t).mean() - (b <= t).mean()) for t in grid)
    assert r["ks_stat"] == pytest.approx(ks)
    assert 0 <= r["ks_p"] <= 1 and 0 <= r["mwu_p_less"] <= 1
