"""Keyed regressions, isotonic fits and the model pool against plain formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapscope.operators import irls, isotonic
from gapscope.operators import models as L
from gapscope.operators import pool as PL
from gapscope.operators import prep as P
from gapscope.operators import regress as RG
from gapscope.operators import splits as S
from gapscope.operators import trees as TR


def rows_of(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 40.0, 0.01] + [0, 7, 0]
    p = 1 / (1 + np.exp(-(0.4 + 0.9 * x[:, 0] - 0.02 * x[:, 1])))
    pdf = pd.DataFrame(x, columns=["x1", "x2", "x3"])
    pdf["y"] = (rng.uniform(size=n) < p).astype(int)
    pdf["k"] = np.where(rng.uniform(size=n) < 0.4, "A", "B")
    pdf["w"] = rng.integers(1, 4, n).astype(float)
    pdf["row_id"] = np.arange(n)
    return pdf


def newton(x, y, w=None, ridge=0.0):
    x = np.column_stack([np.ones(len(x)), x])
    w, b, pen = np.ones(len(y)) if w is None else w, np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 0
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ b))
        h = (x * (w * mu * (1 - mu))[:, None]).T @ x + pen
        b = b + np.linalg.solve(h, x.T @ (w * (y - mu)) - pen @ b)
    return b, np.linalg.inv(h)


def test_every_comparison_and_model_in_one_call(spark):
    pdf = rows_of()
    df = spark.createDataFrame(pdf)
    fits = irls.fit_all(df, ["k"], [
        irls.Model("plain", ("x1", "x2"), "y"), irls.Model("ridge", ("x1", "x3"), "y", ridge=1.0), irls.Model("weighted", ("x2",), "y", weight="w"),
        irls.Model("part", ("x1",), "y", where=F.col("x3") > 0), irls.Model("scaled", ("x1", "x2"), "y", standardise=("x2",)),
    ])
    for k in "AB":
        own = pdf[pdf.k == k]
        b, cov = newton(own[["x1", "x2"]].to_numpy(), own.y.to_numpy())
        fit = fits.get((k,), "plain")
        assert fit.status == "ok" and [fit.estimate(), fit.estimate("x1"), fit.estimate("x2")] == pytest.approx(b, rel=1e-7)
        assert fit.error("x2") == pytest.approx(cov[2, 2] ** 0.5, rel=1e-6)
        assert fits.get((k,), "scaled").estimate("x2") == pytest.approx(b[2] * own.x2.std(ddof=0), rel=1e-7)
        b, _ = newton(own[["x1", "x3"]].to_numpy(), own.y.to_numpy(), ridge=1.0)
        assert fits.get((k,), "ridge").estimate("x3") == pytest.approx(b[2], rel=1e-6)
        b, _ = newton(own[["x2"]].to_numpy(), own.y.to_numpy(), own.w.to_numpy())
        assert fits.get((k,), "weighted").estimate("x2") == pytest.approx(b[1], rel=1e-6)
        half = own[own.x3 > 0]
        b, _ = newton(half[["x1"]].to_numpy(), half.y.to_numpy())
        assert fits.get((k,), "part").estimate("x1") == pytest.approx(b[1], rel=1e-6) and fits.get((k,), "part").n == len(half)
    got = fits.scored(df, "plain", "p").where("k = 'A'").orderBy("row_id").toPandas()
    b, _ = newton(pdf[pdf.k == "A"][["x1", "x2"]].to_numpy(), pdf[pdf.k == "A"].y.to_numpy())
    assert got.p.to_numpy() == pytest.approx(1 / (1 + np.exp(-(b[0] + got.x1 * b[1] + got.x2 * b[2]))), rel=1e-6)


def test_the_absolute_penalty_meets_its_conditions(spark):
    pdf = rows_of()
    fit = irls.fit_all(spark.createDataFrame(pdf), [], [irls.Model("l1", ("x1", "x2", "x3"), "y", lasso=12.0, standardise=("x1", "x2", "x3"))]).fits[0]
    z = (pdf[["x1", "x2", "x3"]] - pdf[["x1", "x2", "x3"]].mean()) / pdf[["x1", "x2", "x3"]].std(ddof=0)
    b = np.array([fit.estimate(c) for c in ("x1", "x2", "x3")])
    slope = z.to_numpy().T @ (pdf.y - 1 / (1 + np.exp(-(fit.estimate() + z.to_numpy() @ b)))).to_numpy()
    assert b[2] == 0 and abs(slope[2]) < 12 and slope[:2] == pytest.approx(12 * np.sign(b[:2]), abs=1e-5)


def test_fits_without_a_maximum_have_a_status(spark):
    rows = [(i, float(i % 7), int(i % 7 > 3), 1.0, float("nan") if i == 5 else 1.0 * i, None if i % 2 else float(i % 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "row_id long, x double, y int, one double, bad double, gaps double")
    df = df.withColumn("x2", F.col("x") * 2).withColumn("split", (F.col("row_id") % 7 > 4).cast("double")).withColumn("odd", (F.col("row_id") * 37 % 11 > 4).cast("int"))
    fits = irls.fit_all(df, [], [
        irls.Model("whole", ("x",), "y"), irls.Model("half", ("split",), "y"), irls.Model("twice", ("x", "x2"), "odd"), irls.Model("constant", ("one",), "odd"),
        irls.Model("nan", ("bad",), "odd"), irls.Model("gaps", ("gaps",), "odd"), irls.Model("one", ("x",), "one"), irls.Model("none", ("x",), "odd", where=F.lit(False)),
    ])
    status = {f.model.name: f.status for f in fits.fits}
    assert status == {
        "whole": "separation", "half": "separation", "twice": "singular", "constant": "singular", "nan": "nonfinite_predictor",
        "gaps": "ok", "one": "one_class", "none": "no_rows",
    }
    assert fits.get((), "gaps").n == 35 and fits.get((), "whole").estimate("x") is None
    assert fits.scored(df, "whole", "p").where("p is not null").count() == 0


def test_separated_errors_are_a_status(spark):
    rows = [(i, "A" if i % 2 else "B", 1, int(i % 2), float(i % 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, g string, y_true int, pred int, m double")
    first = RG.error_waterfall(df, "g", "A", "B", {}, "fn").first()
    assert first["status"] == "separation" and first["log_or"] is None and first["p_value"] is None and first["error_rate_b"] == 1.0
    row = RG.interaction_test(df, "g", "A", "B", ["m"]).first()
    assert row["status"] == "nonestimable" and row["warning"] and row["error"] == "" and row["interaction_p"] is None
    empty = RG.error_waterfall(df.limit(0), "g", "A", "B", {}, "fn", keys=["row_id"])
    assert empty.count() == 0 and RG.case_mix_waterfall(df.limit(0), "g", "A", "B", {}).first()["status"] == "no_rows"


def brute_isotonic(x, y):
    s, at = np.unique(x, return_inverse=True)
    w, t = np.bincount(at).astype(float), np.bincount(at, weights=y)
    cw, ct = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(t)))
    return s, np.array([max(min((ct[b + 1] - ct[a]) / (cw[b + 1] - cw[a]) for b in range(i, len(s))) for a in range(i + 1)) for i in range(len(s))])


@pytest.mark.parametrize("range_rows", [200_000, 11])
def test_isotonic_equals_the_min_max_formula(spark, monkeypatch, range_rows):
    monkeypatch.setattr(isotonic, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(isotonic, "FAN", 3)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 900), "x": np.round(rng.uniform(size=900), 2)})
    pdf["y"] = (rng.uniform(size=900) < pdf.x ** 2).astype(int)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, x double, y int").repartition(5)
    blocks = isotonic.fit(df, ["k"], "x", "y")
    grid = [(k, float(v)) for k in ("a", "b", None, "new") for v in np.linspace(-0.1, 1.1, 61)] + [("a", None)]
    got = isotonic.mapped(spark.createDataFrame(grid, "k string, x double"), ["k"], "x", blocks, "v").collect()
    assert len(got) == len(grid)
    for k in ("a", "b", None):
        own = pdf[pdf.k.isna()] if k is None else pdf[pdf.k == k]
        s, v = brute_isotonic(own.x.to_numpy(), own.y.to_numpy())
        mine = sorted((r["x"], r["v"]) for r in got if r["k"] == k and r["x"] is not None)
        assert [m[1] for m in mine] == pytest.approx(np.interp([m[0] for m in mine], s, v), abs=1e-12)
    assert all(r["v"] is None for r in got if r["k"] == "new" or r["x"] is None)
    assert isotonic.fit(df.limit(0), ["k"], "x", "y").count() == 0


SMALL = L.PoolSettings(forest_trees=12, boosted_rounds=15, vote_trees=6, vote_rounds=6, block=4)


def folded(spark, n=600):
    pdf = rows_of(n).rename(columns={"y": "y_true"})
    df = spark.createDataFrame(pdf).withColumn("x2", F.when(F.col("row_id") % 9 > 0, F.col("x2")))
    return S.kfold_stratified(df, [], folds=3)


SPEC = P.DesignSpec(["x1", "x2", "k"], [P.Categorical("k")])


def test_pool_scores_do_not_depend_on_layout(spark):
    df = folded(spark)
    first = L.cross_validated_scores(df, SPEC, folds=3, settings=SMALL).orderBy("family", "row_id").collect()
    again = L.cross_validated_scores(df.repartition(5, "x1"), SPEC, folds=3, settings=SMALL).orderBy("family", "row_id").collect()
    assert len(first) == 6 * 600 and [r["row_id"] for r in first] == [r["row_id"] for r in again]
    assert [r["prob"] for r in first] == pytest.approx([r["prob"] for r in again], abs=1e-9)
    auroc = {r["family"]: r["mean_auroc"] for r in L.cv_auroc(spark.createDataFrame(first)).collect()}
    assert set(auroc) == set(L.FAMILIES) and min(auroc.values()) > 0.65


def test_a_fold_is_not_seen_by_its_model(spark):
    df = folded(spark)
    flipped = df.withColumn("y_true", F.when(F.col("fold") == 1, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    one, two = (
        [r["prob"] for r in L.cross_validated_scores(d, SPEC, folds=3, settings=SMALL).where("fold = 1").orderBy("family", "row_id").collect()]
        for d in (df, flipped)
    )
    assert one == pytest.approx(two, abs=1e-9)


def test_robustness_keeps_a_failed_family_as_an_error(spark):
    df = folded(spark).withColumn("bad", F.lit(float("nan"))).withColumn("pred", F.lit(0))
    spec = P.DesignSpec(["x1", "bad"])
    got = {r["family"]: r for r in L.family_robustness(df, df, spec, "k", "A", "B", folds=3, settings=SMALL).collect()}
    assert got["logistic_regression"]["error"] and got["calibrated_ensemble"]["error"] and got["logistic_regression"]["auroc"] is None
    assert got["random_forest"]["error"] is None and got["boosted_trees"]["auroc"] > 0.6


def test_sampled_cells_still_score_every_row(spark):
    df = folded(spark)
    small = L.PoolSettings(**{**SMALL.__dict__, "max_cells": 60})
    got = L.cross_validated_scores(df, SPEC, ("random_forest",), 3, settings=small)
    assert got.count() == 600 and got.where("prob is null or prob < 0 or prob > 1").count() == 0


@pytest.mark.parametrize("families", [("random_forest", "shallow_tree", "boosted_trees")])
def test_trees_are_fitted_on_all_cells(spark, families):
    """More cells than are packed together are no sample: every family is the one of all cells."""
    df = folded(spark)
    packed = L.PoolSettings(**{**SMALL.__dict__, "max_cells": 100})
    whole, parted = (
        {(r["row_id"], r["family"]): r["prob"] for r in L.cross_validated_scores(df, SPEC, families, 3, settings=s).collect()}
        for s in (SMALL, packed)
    )
    assert len(whole) == 600 * len(families) and whole.keys() == parted.keys()
    assert all(parted[k] == pytest.approx(p, abs=1e-12) for k, p in whole.items())


def test_cells_hold_every_row(spark):
    rows = folded(spark).select("fold", "y_true", F.expr("cast(floor(10 * x1) as int)").alias("a"), F.expr("cast(row_id % 7 as int)").alias("b"))
    parts = PL.counted_cells(rows, [F.col("a"), F.col("b")], [0, 1, 2], F.col("fold"), "y_true", 20)
    cells, counts = PL.gathered(parts, 2, 3)
    want = rows.groupBy("a", "b", "fold", "y_true").count().collect()
    at = {tuple(c): n for c, n in zip(cells.tolist(), counts)}
    assert parts.count() > 1 and list(at) == sorted(at) and counts.sum() == 600 and len(at) == len({(r["a"], r["b"]) for r in want})
    assert all(at[r["a"], r["b"]][r["fold"], r["y_true"]] == r["count"] for r in want)


def test_robustness_is_fitted_on_all_cells(spark):
    df = folded(spark).withColumn("pred", F.lit(0))
    families = ("shallow_tree", "boosted_trees")
    whole, parted = (
        {r["family"]: (r["auroc"], r["brier"]) for r in L.family_robustness(df, df, SPEC, "k", "A", "B", families, 3, settings=s).collect()}
        for s in (SMALL, L.PoolSettings(**{**SMALL.__dict__, "max_cells": 100}))
    )
    assert set(whole) == set(families) and all(parted[f] == pytest.approx(v, abs=1e-12) for f, v in whole.items())


def test_trees_split_as_counted_by_hand():
    bins = np.array([[0, 1], [1, 0], [2, 1], [3, 0]], dtype=np.int16)
    neg, pos = np.array([9.0, 9, 1, 0]), np.array([1.0, 0, 9, 9])
    tree = TR.single_tree(bins, np.array([4, 2]), neg, pos, 1, 1)[0]
    assert tree.feature[0] == 0 and tree.cut[0] == 1 and list(tree.leaf_values(bins)) == pytest.approx([1 / 19] * 2 + [18 / 19] * 2)
    assert len(TR.single_tree(bins, np.array([4, 2]), neg, pos, 5, 40)[0].feature) == 1
    base, trees = TR.boosted(bins, np.array([4, 2]), neg, pos, 1, 1, 0.1, 1.0, 1.0, (1,))
    assert base == pytest.approx(0.0, abs=1e-12) and trees[0].leaf_values(bins)[0] == pytest.approx(-0.1 * 8.5 / (19 * 0.25 + 1))
    both = TR.unpacked(TR.packed([tree, *trees]))
    assert (TR.value_sums(both, bins) == tree.leaf_values(bins) + trees[0].leaf_values(bins)).all()


def test_a_missing_score_is_a_status_of_its_group(spark):
    from gapscope.operators.resample import calibration_fit

    rng = np.random.default_rng(2)
    rows = [(k, float(p), int(rng.uniform() < p)) for k in ("good", "null", "nan") for p in rng.uniform(0.05, 0.95, 200)]
    rows += [("null", None, 1), ("nan", float("nan"), 0), ("flat", 0.4, 1), ("flat", 0.4, 0)]
    got = {r["k"]: r for r in calibration_fit(spark.createDataFrame(rows, "k string, prob double, y_true int"), ["k"]).collect()}
    assert {k: r["calib_status"] for k, r in got.items()} == {
        "good": "ok", "null": "nonfinite_predictor", "nan": "nonfinite_predictor", "flat": "degenerate_predictor",
    }
    assert got["null"]["calib_slope"] is None and got["good"]["calib_slope"] > 0


def test_blocks_of_trees_meet_sets_of_cells(spark, monkeypatch):
    """A task holds one block and a few sets of cells; scores do not depend on how cells are dealt."""
    df = folded(spark)
    families = ("random_forest", "boosted_trees")
    pool = L.fit_pool(df, SPEC, families, "y_true", "fold", 3, SMALL)
    whole = {(r["row_id"], r["family"], r["model"]): r["prob"] for r in pool.all_models(df, ["row_id"]).collect()}
    assert pool.trees.count() == pool.trees.rdd.getNumPartitions() == 3 * (3 + 1)
    monkeypatch.setattr(PL, "SCORED", 40)
    monkeypatch.setattr(PL, "SETS", 2)
    dealt = {(r["row_id"], r["family"], r["model"]): r["prob"] for r in pool.all_models(df, ["row_id"]).collect()}
    assert len(whole) == 600 * 3 * 2 and dealt.keys() == whole.keys()
    assert all(dealt[k] == pytest.approx(p, abs=1e-12) for k, p in whole.items())


def test_split_seeds_are_the_ensemble_of_each_seed(spark, monkeypatch):
    pdf = rows_of(700).rename(columns={"y": "y_true"})
    pdf["c"] = [f"c{i // 3}" for i in range(700)]
    df = spark.createDataFrame(pdf)
    spec = P.DesignSpec(["x1", "x2"])
    sides = S.split_grouped(df, [], "c", 3).persist()
    train = S.kfold_grouped(sides.where("split = 'train'"), [], "y_true", "c", 3, 3).persist()
    scored = L.isotonic_fold_ensemble(train, spec, "logistic_regression", 3).score(sides.where("split = 'test'"), "prob").toPandas()
    scored = scored[scored.y_true == 1]
    hit = scored.prob >= train.agg(F.avg("y_true")).first()[0]
    want = hit[scored.k == "A"].mean() - hit[scored.k == "B"].mean()
    monkeypatch.setattr(L, "fit_family", None)  # one fit a fold after the other is what took too long
    got = L.repeated_splits(df, spec, "k", "A", "B", [3, 4], 3, cluster="c", settings=SMALL).orderBy("seed").collect()
    assert [r["seed"] for r in got] == [3, 4] and got[0]["gap"] == pytest.approx(want, abs=1e-9) and got[1]["gap"] is not None
