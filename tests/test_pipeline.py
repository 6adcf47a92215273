import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapscope.functions import recode as R
from gapscope.operators import compare as C
from gapscope.operators import models as L
from gapscope.operators import permute as PM
from gapscope.operators import prep as P
from gapscope.operators import regress as RG
from gapscope.operators import report as RP
from gapscope.operators import resample as RS
from gapscope.operators import splits as S
from gapscope.schema import ContractError, check_columns, sweep_columns
from gapscope.sources import sinks


def encounters(n_patients=300, seed=2):
    """Patients with 1-6 rows; some appear under both groups."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(n_patients):
        risk = rng.uniform(0.1, 0.9)
        group = "A" if rng.uniform() < 0.5 else "B"
        for _ in range(rng.integers(1, 7)):
            if p % 12 == 0:
                group = "A" if rng.uniform() < 0.5 else "B"
            prob = float(np.clip(round(risk + rng.normal(0, 0.1), 2), 0.01, 0.99))
            rows.append((len(rows), p, group, int(rng.uniform() < risk), prob))
    pdf = pd.DataFrame(rows, columns=["row_id", "cluster_id", "g", "y_true", "prob"])
    pdf["pred"] = (pdf.prob >= 0.5).astype(int)
    pdf["k"] = "one"
    return pdf


def test_split_sizes_and_disjointness(spark):
    df = spark.createDataFrame(encounters())
    parts = S.split_stratified(df, ["k"])
    sizes = {(r["y_true"], r["split"]): r["count"] for r in parts.groupBy("y_true", "split").count().collect()}
    for y in (0, 1):
        total = sizes[y, "test"] + sizes[y, "train"]
        assert sizes[y, "test"] == int(np.ceil(0.3 * total))
    again = S.split_stratified(df.repartition(7), ["k"])
    assert parts.exceptAll(again.select(*parts.columns)).count() == 0
    grouped = S.split_grouped(df, ["k"])
    assert S.require_disjoint(grouped.where("split='train'"), grouped.where("split='test'"), ["cluster_id"])
    with pytest.raises(S.IsolationError):
        S.require_disjoint(df, df, ["row_id"])


def test_folds_keep_clusters_whole_and_balanced(spark):
    df = spark.createDataFrame(encounters())
    folded = S.kfold_grouped(df, ["k"])
    assert S.fold_violations(folded, ["k"]).first()["n_spanning"] == 0
    per = [r["count"] for r in folded.select("cluster_id", "fold").distinct().groupBy("fold").count().collect()]
    assert len(per) == 5 and max(per) - min(per) <= 3
    assert S.kfold_stratified(df, []).select("fold").distinct().count() == 5


def test_auxiliary_holdout_needs_two_rows(spark):
    df = spark.createDataFrame([("k", "a", 1, 1), ("k", "c", 2, 0)], "k string, g string, row_id long, y_true int")
    with pytest.raises(Exception, match="too few rows"):
        S.auxiliary_holdout(df, ["k"], "g", ["a"]).collect()


def test_medians_come_from_training_rows_only(spark):
    rows = [(i, "train", None if i == 0 else 1.0, "x") for i in range(50)]
    rows += [(i, "test", None if i == 51 else 100.0, "y") for i in range(50, 100)]
    df = spark.createDataFrame(rows, "row_id long, part string, num double, cat string").withColumn("k", F.lit(1))
    train, spec = df.where("part = 'train'"), P.DesignSpec(["num", "cat"], [P.Categorical("cat", drop_first=False)])
    medians = P.fit_medians(train, ["k"], ["num"])
    assert medians.first()["median"] == 1.0
    categories = P.fit_categories(train, ["k"], spec.categorical)
    out = {r["row_id"]: r for r in P.apply_design(df, ["k"], spec, medians, P.level_lists(categories, spec), ["row_id"]).collect()}
    assert out[51]["num"] == 1.0 and out[51]["cat_x"] == 0.0 and out[0]["cat_x"] == 1.0
    unseen = P.unseen_categories(df, ["k"], spec.categorical, categories).collect()
    assert [(r["category"], r["n_rows"]) for r in unseen] == [("y", 50)]


def test_column_without_values_is_zero_filled_and_bad_specs_fail(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, num double")
    row = P.fit_medians(df, ["k"], ["num"]).first()
    assert row["median"] == 0.0 and row["zero_filled"] and row["n_missing"] == 2
    with pytest.raises(ValueError):
        P.DesignSpec(["num"], [P.Categorical("cat")])
    features, blocks, spec = P.blinded(["race", "Race_x", "age"], {"d": ["race", "age"]}, P.DesignSpec(["race", "age"], [P.Categorical("race")]), "race")
    assert features == ["age"] and blocks == {"d": ["age"]} and spec.categorical == []


def test_recodes_never_turn_missing_into_zero(spark):
    df = spark.createDataFrame([(None, None), (88.0, "x"), (40.0, "y"), (3.0, "Yes")], "v double, s string")
    rows = df.select(
        R.day_count("v").alias("d"), R.flag_if_known("s", "Yes").alias("f"),
        R.in_set("v", [3.0], [3.0, 40.0]).alias("i"), R.mapped("s", {"x": 1}).alias("m"),
        R.numeric_or_null("s").alias("n"),
    ).collect()
    assert [r["d"] for r in rows] == [None, 0.0, None, 3.0]
    assert [r["f"] for r in rows] == [None, 0, 0, 1]
    assert [r["i"] for r in rows] == [None, None, 0, 1]
    assert [r["m"] for r in rows] == [None, 1, None, None]


def brute_bootstrap(pdf, n, cluster, seed=0):
    rng, out = np.random.default_rng(seed), []
    ids = pdf.cluster_id.unique()
    by = {c: np.flatnonzero(pdf.cluster_id.to_numpy() == c) for c in ids}
    g, y, f = pdf.g.to_numpy(), pdf.y_true.to_numpy(), pdf.pred.to_numpy()
    ia, ib = np.flatnonzero(g == "A"), np.flatnonzero(g == "B")
    for _ in range(n):
        idx = (np.concatenate([by[c] for c in rng.choice(ids, len(ids))]) if cluster
               else np.r_[rng.choice(ia, len(ia)), rng.choice(ib, len(ib))])
        s = {}
        for label in "AB":
            here = idx[(g[idx] == label) & (y[idx] == 1)]
            s[label] = f[here].mean()
        out.append(s["A"] - s["B"])
    return np.array(out)


@pytest.mark.parametrize("cluster", [False, True])
def test_bootstrap_has_the_law_of_resampled_rows(spark, cluster):
    pdf = encounters()
    df = spark.createDataFrame(pdf)
    table, _ = RS.bootstrap_comparison(
        df, ["k"], "g", "A", "B", "cluster_id" if cluster else None, n_boot=1500, calibration=False
    )
    r = table.where("block = 'gap' and metric = 'sensitivity'").first()
    ref = brute_bootstrap(pdf, 3000, cluster)
    assert r["point"] == pytest.approx(
        pdf[(pdf.g == "A") & (pdf.y_true == 1)].pred.mean() - pdf[(pdf.g == "B") & (pdf.y_true == 1)].pred.mean()
    )
    width = np.quantile(ref, 0.975) - np.quantile(ref, 0.025)
    assert r["ci_low"] == pytest.approx(np.quantile(ref, 0.025), abs=0.12 * width)
    assert r["ci_high"] == pytest.approx(np.quantile(ref, 0.975), abs=0.12 * width)


def test_replicates_are_independent_of_partitioning(spark):
    df = spark.createDataFrame(encounters())
    one = RS.cluster_count_replicates(df, ["k"], "g", "A", "B", "cluster_id", 20)
    two = RS.cluster_count_replicates(df.repartition(5), ["k"], "g", "A", "B", "cluster_id", 20)
    assert one.exceptAll(two.select(*one.columns)).count() == 0


def test_same_draw_behind_counts_and_scores(spark):
    """The count bootstrap and the score bootstrap use one multiplicity per cluster."""
    df = spark.createDataFrame(encounters())
    counts = RS.cluster_count_replicates(df, ["k"], "g", "A", "B", "cluster_id", 15)
    packed = RS.weighted_cells_by_cluster(df, ["k"], "g", "A", "B", "cluster_id", 15, 42, "y_true", "prob", "pred")
    scores = RS.score_replicates(packed, ["k"], 15).select("k", "replicate", *RS.SIDES)
    assert counts.select("k", "replicate", *RS.SIDES).exceptAll(scores).count() == 0


def test_no_replicates_means_no_limits(spark):
    df = spark.createDataFrame(encounters(40))
    r = RS.bootstrap_gap(df, ["k"], "g", "A", "B", "ppv", n_boot=0).first()
    assert r["point"] is not None and r["ci_low"] is None and r["n_valid_replicates"] == 0


def test_permutation_index_is_a_bijection():
    for size in (1, 2, 17, 1000):
        for key in (1, 99):
            assert sorted(PM.permuted_index(np.arange(size), size, key)) == list(range(size))


def test_permutation_p_value_detects_a_real_gap(spark):
    rows = [("k", "A", 1, int(i < 160)) for i in range(200)] + [("k", "B", 1, int(i < 60)) for i in range(200)]
    rows += [("k", g, 0, int(i < 50)) for g in "AB" for i in range(100)]
    df = spark.createDataFrame(rows, "k string, g string, y_true int, pred int")
    got = {r["metric"]: r for r in RS.permutation_group(df, ["k"], "g", "A", "B", 500).collect()}
    assert got["sensitivity"]["empirical_p"] == 0.0 and got["sensitivity"]["observed_gap"] == pytest.approx(0.5)
    assert abs(got["sensitivity"]["null_mean"]) < 0.02


def model_rows(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    g = np.where(rng.uniform(size=n) < 0.5, "A", "B")
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(1.2 * x1 - 0.5 + 0.4 * (g == "A"))))).astype(int)
    pdf = pd.DataFrame({"row_id": np.arange(n), "x1": x1, "x2": x2, "g": g, "y_true": y})
    pdf["pred"] = (x1 > 0.3).astype(int)
    return pdf


def ridge(x, y, c=1.0):
    d, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.diag(np.r_[0, np.ones(x.shape[1])]) / c
    for _ in range(50):
        mu = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve(d.T @ (d * (mu * (1 - mu))[:, None]) + pen, d.T @ (y - mu) - pen @ b)
    return b


def test_logistic_penalty_matches_a_newton_solve(spark):
    pdf = model_rows()
    fit = RG.fit_logistic(spark.createDataFrame(pdf), ["x1", "x2"], "y_true")
    b = ridge(pdf[["x1", "x2"]].to_numpy(), pdf.y_true.to_numpy())
    assert fit.intercept == pytest.approx(b[0], abs=1e-4)
    assert fit.coefficients["x1"] == pytest.approx(b[1], abs=1e-4)


def test_waterfalls_and_interaction(spark):
    df = spark.createDataFrame(model_rows())
    steps = RG.case_mix_waterfall(df, "g", "A", "B", {"one": ["x1"], "two": ["x2"]}).orderBy("step_no").collect()
    assert [r["n_features"] for r in steps] == [1, 2, 3] and steps[0]["pct_of_raw_gap_explained"] == 0.0
    errors = RG.error_waterfall(df, "g", "A", "B", {"one": ["x2"]}, "fn").orderBy("step_no").collect()
    a, b = errors[0]["error_rate_a"], errors[0]["error_rate_b"]
    assert errors[0]["log_or"] == pytest.approx(np.log(a / (1 - a)) - np.log(b / (1 - b)), abs=1e-6)
    assert errors[0]["or_ci_low"] < errors[0]["odds_ratio"] < errors[0]["or_ci_high"]
    test = RG.interaction_test(df, "g", "A", "B", ["x2"]).first()
    assert test["status"] == "estimable" and test["note"] == ""
    tiny = RG.interaction_test(df.limit(4), "g", "A", "B", ["x2"]).first()
    assert tiny["status"] == "nonestimable" and tiny["interaction_p"] is None
    with pytest.raises(ValueError):
        RG.error_rows(df, "g", "A", "B", "both")


def test_standardised_gap_notes_small_groups(spark):
    df = spark.createDataFrame(model_rows())
    row = RG.standardised_error_gap(df, "g", "A", "B", ["x2"], "fp").first()
    assert row["note"] == "" and abs(row["g_computation_gap"] - row["raw_gap"]) < 0.05
    few = RG.standardised_error_gap(df.where("g = 'B'"), "g", "A", "B", ["x2"]).first()
    assert few["raw_gap"] is None and few["note"]


def test_outcome_permutation_centres_on_chance(spark):
    df = spark.createDataFrame(model_rows(400))
    got = {r["metric"]: r for r in PM.outcome_permutation(df, df, ["x1", "x2"], "g", "A", "B", n_perm=30).collect()}
    assert abs(got["auroc"]["null_mean"] - 0.5) < 0.15 and got["auroc"]["n_perm"] == 30


def test_selection_fails_closed(spark):
    rows = [("k", "logistic_regression", 0.7), ("k", "random_forest", 0.7), ("k", "shallow_tree", None), ("k", "boosted_trees", float("inf"))]
    df = spark.createDataFrame(rows, "k string, family string, mean_auroc double")
    r = L.select_best(df, ["k"]).first()
    assert r["selected_family"] == "logistic_regression" and r["n_ineligible"] == 2
    with pytest.raises(L.SelectionError):
        L.require_selection([{"family": f, "mean_auroc": 0.5} for f in L.FAMILIES])
    with pytest.raises(L.SelectionError):
        L.require_selection([{"family": "shallow_tree", "mean_auroc": 0.9}])


def test_model_round_trip_and_missing_columns(spark, tmp_path):
    df = spark.createDataFrame(model_rows()).withColumn("x2", F.when(F.col("row_id") % 9 > 0, F.col("x2")))
    spec = P.DesignSpec(["x1", "x2", "g"], [P.Categorical("g")])
    fitted = L.fit_family(df, spec, "logistic_regression")
    L.save_fitted(fitted, str(tmp_path))
    loaded = L.load_fitted(str(tmp_path), fitted.family, 1, fitted.required)
    check = L.verify_scoring(fitted.score(df, "prob_calibrated"), loaded.score(df, "prob_calibrated")).first()
    assert check["verified"] and check["n_rows"] == 900
    with pytest.raises(ValueError):
        L.batch_score(loaded, df.drop("x1"), 0.5, "logistic_regression")
    with pytest.raises(ValueError):
        L.fit_family(df, spec, "unknown")


def test_fold_ensemble_is_calibrated(spark):
    df = S.kfold_stratified(spark.createDataFrame(model_rows()), [])
    spec = P.DesignSpec(["x1", "x2"])
    scored = L.isotonic_fold_ensemble(df, spec, "logistic_regression").score(df)
    p, y = scored.agg(F.avg("prob"), F.avg("y_true")).first()
    assert p == pytest.approx(y, abs=0.03)


def test_recalibration_of_an_absent_group_is_null(spark):
    df = spark.createDataFrame(model_rows(300)).withColumn("prob", 1 / (1 + F.exp(-F.col("x1"))))
    out = L.recalibrate(df.where("g = 'A'"), df, "g", "A", "B")
    n = {(r["strategy"], r["g"]): r["n"] for r in out.groupBy("strategy", "g").agg(F.count("recalibrated").alias("n")).collect()}
    assert n["group_platt", "B"] == 0 and n["group_platt", "A"] > 0 and n["pooled_platt", "B"] > 0


def test_contracts(spark, tmp_path):
    with pytest.raises(ContractError, match="missing"):
        check_columns(spark.range(1), ["id", "x"])
    assert len(sweep_columns()) == 23
    part = spark.range(3)
    with pytest.raises(RuntimeError, match="nothing written"):
        sinks.write_all_or_nothing({"a": part, "b": part}, {"a": 3, "b": 4}, str(tmp_path))
    assert not list(tmp_path.iterdir())
    sinks.write_all_or_nothing({"a": part}, {"a": 3}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    row = sinks.strict_json(spark.createDataFrame([(1.0, float("inf"))], "a double, b double")).first()[0]
    assert row == '{"a":1.0,"b":null}'


def test_stability_tie_is_negative_and_field_classes(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, -1, 1, -1)], "k string, gap double")
    r = RP.stability_direction(df, ["k"]).first()
    assert r["majority_direction"] == "negative" and not r["stable"]
    rows = [("operating_threshold", 0.1, 0.1 + 1e-13), ("manuscript_metrics_and_bootstrap_confidence_intervals", 0.1, 0.1 + 1e-13)]
    got = C.field_acceptance(spark.createDataFrame(rows, "c string, a double, b double"), "c", "a", "b").collect()
    assert [r["accepted"] for r in got] == [False, True]
    with pytest.raises(Exception, match="unknown field class"):
        C.field_acceptance(spark.createDataFrame([("x", 1.0, 1.0)], "c string, a double, b double"), "c", "a", "b").collect()


def test_tokens_number_clusters_in_text_order(spark):
    ids = [f"patient-{i}" for i in (5, 50, 500, 7, 7, 12, 3)]
    df = spark.createDataFrame([("k", c) for c in ids], "k string, cluster_id string")
    got = {r["cluster_id"]: r["cluster_token"] for r in S.dense_cluster_token(df, ["k"]).collect()}
    assert got == {c: f"P{i + 1:06d}" for i, c in enumerate(sorted(set(ids)))}


def test_equal_weights_of_schemes(spark):
    df = spark.createDataFrame(model_rows(301)).withColumn("k", F.lit("k"))
    out = S.balanced_training(df, ["k"], "g", "A", "B").toPandas()
    sizes = out[out.w_equal_sample_size.notna()].groupby("g").size()
    assert sizes["A"] == sizes["B"] == min((out.g == "A").sum(), (out.g == "B").sum())
    cases = out[out.w_equal_positive_cases.notna() & (out.y_true == 1)].groupby("g").size()
    assert cases["A"] == cases["B"]
    w = out.groupby("y_true").w_class_balanced_weighting.sum()
    assert w[0] == pytest.approx(w[1])
