"""Model families, cross-validated selection, isotonic fold ensembles, scoring.

A fitted model is a Spark ML ``PipelineModel`` that takes raw predictor columns:
its first stage holds the medians, indicators and z-scores learned from its own
training rows, so every fold is isolated and a saved model is self-contained.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clipped_logit, hash_uniform
from ..session import ensure_checkpoint_dir
from . import gaps as G
from . import irls, isotonic
from . import metrics as M
from .pool import FAMILIES, LINEAR, PoolSettings, calibrated_scores, fit_pool
from .prep import (
    DesignSpec,
    design_columns,
    fit_categories,
    fit_medians,
    level_lists,
    training_folds,
)
from .thresholds import equal_sensitivity_threshold

ENSEMBLE_MEMBERS = ("logistic_regression", "random_forest", "boosted_trees")


class SelectionError(RuntimeError):
    """No family can be selected."""


@dataclass(frozen=True)
class Fitted:
    """One or more pipelines whose mean probability is the score."""

    family: str
    members: list[PipelineModel]
    required: list[str] = field(default_factory=list)

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"input lacks predictor columns: {missing}")
        out, parts = df, []
        for i, m in enumerate(self.members):
            scored = m.transform(out)
            added = [c for c in scored.columns if c not in out.columns and c != "probability"]
            out = scored.withColumn(f"_p{i}", vector_to_array("probability")[1]).drop(
                "probability", *added
            )
            parts.append(F.col(f"_p{i}"))
        mean = reduce(lambda a, b: a + b, parts) / float(len(parts))
        return out.withColumn(name, mean).drop(*[f"_p{i}" for i in range(len(parts))])


def _quoted(c: str) -> str:
    return f"`{c}`"


@dataclass(frozen=True)
class Preparation:
    """Preprocessing stages learned from one set of training rows."""

    stages: list
    names: list[str]


def prepare(train: DataFrame, spec: DesignSpec, part: str | None = None) -> dict:
    """Preprocessing learned from ``train``, one per value of ``part`` if given.

    Medians and categories of all parts come from the same two grouped jobs.
    """
    if part is None:
        # a constant that the optimiser does not fold, so joins on it stay equi-joins
        text = F.col(spec.features[0]).cast("string")
        train, part = train.withColumn("_part", F.coalesce(F.substring(text, 1, 0), F.lit(""))), "_part"
    medians: dict = {}
    if spec.numeric:
        for r in fit_medians(train, [part], spec.numeric).collect():
            medians.setdefault(r[part], {})[r["column"]] = r["median"]
    levels: dict = {}
    if spec.categorical:
        levels = level_lists(fit_categories(train, [part], spec.categorical), spec, part)
    parts = list(medians or levels)
    stats = _part_moments(train, spec, part, medians, levels)
    return {v: _stages(spec, medians.get(v, {}), levels.get(v, {}), stats[v]) for v in parts}


def fold_states(train: DataFrame, spec: DesignSpec, folds: int, fold: str = "fold") -> dict:
    """Preprocessing of every fold's training half, from one set of grouped jobs."""
    return prepare(training_folds(train, folds, fold), spec, "train_fold")


def _part_moments(train: DataFrame, spec: DesignSpec, part: str, medians: dict, levels: dict) -> dict:
    """Mean and population sd of every design column, all parts in one grouped job."""
    columns = {}
    for f in spec.numeric:
        fill = F.create_map(*[F.lit(x) for v, m in medians.items() for x in (v, m[f])])
        columns[f"f_{f}"] = F.coalesce(F.col(f).try_cast("double"), F.try_element_at(fill, F.col(part)))
    for c in spec.categorical:
        for v in sorted({v for known in levels.values() for v in known[c.source]}):
            hit = F.coalesce(F.col(c.source).cast("string") == F.lit(v), F.lit(False))
            columns[f"f_{c.stem}_{v}"] = hit.cast("double")
    names = list(columns)
    rows = train.groupBy(part).agg(
        *[F.avg(columns[n]).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(columns[n]).alias(f"s{i}") for i, n in enumerate(names)],
    ).collect()
    return {
        r[part]: {n: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, n in enumerate(names)} for r in rows
    }


def _stages(spec: DesignSpec, medians: dict, levels: dict, stats: dict) -> Preparation:
    by_source = {c.source: c for c in spec.categorical}
    parts = []
    for f in spec.features:
        if f in by_source:
            c = by_source[f]
            for v in levels[f][1:] if c.drop_first else levels[f]:
                text = v.replace("\\", "\\\\").replace("'", "\\'")
                parts.append(
                    f"CAST(coalesce(CAST({_quoted(f)} AS STRING) = '{text}', false) AS DOUBLE)"
                    f" AS {_quoted('f_' + c.stem + '_' + v)}"
                )
        else:
            parts.append(
                f"coalesce(try_cast({_quoted(f)} AS DOUBLE), {medians[f]!r}D) AS {_quoted('f_' + f)}"
            )
    names = [f"f_{c}" for c in design_columns(spec, levels)]
    impute = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    scaled = [
        f"({_quoted(n)} - {stats[n][0]!r}D) / {stats[n][1]!r}D AS {_quoted('z' + n)}" for n in names
    ]
    scale = SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")
    vectors = [
        VectorAssembler(inputCols=names, outputCol="_x"),
        VectorAssembler(inputCols=["z" + n for n in names], outputCol="_z"),
    ]
    return Preparation([impute, scale, *vectors], names)


def _estimator(family: str, n: float, s: PoolSettings):
    shared = dict(labelCol="_label", probabilityCol="probability", seed=s.seed)
    if family == "logistic_regression":
        return LogisticRegression(
            featuresCol="_z", labelCol="_label", regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-9
        )
    if family == "l1_logistic_regression":
        return LogisticRegression(
            featuresCol="_z", labelCol="_label", regParam=1.0 / (0.5 * n), elasticNetParam=1.0,
            standardization=False, maxIter=500, tol=1e-9,
        )
    if family == "random_forest":
        return RandomForestClassifier(
            featuresCol="_x", numTrees=s.forest_trees, maxDepth=s.forest_depth, minInstancesPerNode=5, **shared
        )
    if family == "shallow_tree":
        return DecisionTreeClassifier(featuresCol="_x", maxDepth=3, minInstancesPerNode=20, **shared)
    if family == "boosted_trees":
        boosted = dict(shared)
        boosted.pop("probabilityCol")
        return GBTClassifier(
            featuresCol="_x", maxIter=s.boosted_rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", **boosted,
        )
    raise ValueError(f"unknown family {family!r}; expected one of {FAMILIES}")


def fit_family(
    train: DataFrame, spec: DesignSpec, family: str, y: str = "y_true",
    settings: PoolSettings = PoolSettings(), weight: str | None = None,
    prepared: Preparation | None = None,
) -> Fitted:
    """Fit preprocessing (unless ``prepared`` on the same rows) and one family."""
    if prepared is None:
        prepared = next(iter(prepare(train, spec).values()))
    if family == "calibrated_ensemble":
        members = [
            fit_family(train, spec, f, y, settings, weight, prepared).members[0] for f in ENSEMBLE_MEMBERS
        ]
        return Fitted(family, members, list(spec.features))
    rows = train
    for stage in prepared.stages:
        rows = stage.transform(rows)
    rows = rows.withColumn("_label", F.col(y).cast("double"))
    n = float(rows.agg(F.count("*") if weight is None else F.sum(weight)).first()[0])
    estimator = _estimator(family, n, settings)
    if weight is not None:
        estimator = estimator.setWeightCol(weight)
    return Fitted(family, [PipelineModel([*prepared.stages, estimator.fit(rows)])], list(spec.features))


def _compact(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """Cache training rows in tasks sized by their number, since fits are iterative."""
    kept = df.persist()
    return kept.coalesce(int(kept.count() // rows_per_task) + 1)


def _settled(scores: DataFrame) -> DataFrame:
    """Score once and cut the lineage, so later jobs do not carry the fitted models."""
    ensure_checkpoint_dir(scores.sparkSession)
    return scores.checkpoint()


def in_parallel(jobs: list[Callable], width: int) -> list:
    """Run independent fits from a few driver threads; each fit is its own Spark job."""
    with ThreadPool(max(1, min(width, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs)


def cross_validated_scores(
    train: DataFrame, spec: DesignSpec, families: tuple[str, ...] = FAMILIES, folds: int = 5,
    y: str = "y_true", fold: str = "fold", row_id: str = "row_id",
    settings: PoolSettings = PoolSettings(),
) -> DataFrame:
    """Out-of-fold scores of every family, one row per (row, family); all folds are fitted together.

    A family one of whose folds has no fit has NULL scores.
    """
    pool = fit_pool(train, spec, families, y, fold, folds, settings)
    scores = pool.held_out(train, [fold, row_id, y], fold).drop("model")
    for f in pool.failed:
        scores = scores.unionByName(train.select(fold, row_id, y, F.lit(f).alias("family"), F.lit(None).cast("double").alias("prob")))
    return _settled(scores)


def cv_auroc(scores: DataFrame, y: str = "y_true", fold: str = "fold") -> DataFrame:
    """Mean and sample sd over folds of the exact AUROC, per family, in one job."""
    per_fold = M.discrimination(scores, ["family", fold], y, "prob")
    out = per_fold.groupBy("family").agg(
        F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("mean_auroc"),
        F.stddev_samp("auroc").alias("sd_auroc"), F.count("*").alias("folds"),
    )
    status = (
        F.when(F.col("mean_auroc").isNull(), "invalid")
        .when(F.col("mean_auroc") > 0.5, "eligible").otherwise("ineligible")
    )
    return out.withColumn("status", status)


def select_best(
    scores: DataFrame, keys: list[str], name: str = "family", score: str = "mean_auroc",
    order: list[str] = list(FAMILIES),
) -> DataFrame:
    """Best finite score above one half; ties go to the first declared name."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
    s = F.col(score)
    eligible = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & (s > 0.5)
    best = F.max_by(name, F.when(eligible, F.struct(s, -place)))
    return scores.groupBy(*keys).agg(
        best.alias("selected_family"), F.max(F.when(eligible, s)).alias("selected_score"),
        F.count_if(~F.coalesce(eligible, F.lit(False))).alias("n_ineligible"),
    )


def require_selection(scores: list, expected: tuple[str, ...] = FAMILIES) -> str:
    """Name of the selected family, or an error listing every family's state."""
    found = {r["family"]: r["mean_auroc"] for r in scores}
    absent = [f for f in expected if found.get(f) is None]
    if absent:
        raise SelectionError(f"families without a complete cross-validation: {absent}")
    good = {f: v for f, v in found.items() if 0.5 < v < float("inf")}
    if not good:
        raise SelectionError(f"no family above one half: {found}")
    return max(expected, key=lambda f: good.get(f, 0.0))


# --- isotonic fold ensemble ---------------------------------------------------------


def fit_isotonic(df: DataFrame, score: str, y: str):
    """Isotonic map of score to outcome, fitted on score totals instead of rows."""
    totals = df.groupBy(score).agg(F.avg(F.col(y).cast("double")).alias("_label"), F.count("*").cast("double").alias("_w"))
    return IsotonicRegression(
        featuresCol=score, labelCol="_label", weightCol="_w", predictionCol="_iso", isotonic=True
    ).fit(totals)


@dataclass(frozen=True)
class FoldEnsemble:
    """Pairs of (base model, isotonic map), one per fold; scores are averaged."""

    family: str
    pairs: list

    def score(self, df: DataFrame, name: str = "prob") -> DataFrame:
        out = df
        for i, (base, iso) in enumerate(self.pairs):
            out = _margin(base.score(out, "_raw"), self.family)
            out = iso.transform(out).withColumnRenamed("_iso", f"_c{i}").drop("_raw", "_m")
        total = reduce(lambda a, b: a + b, [F.col(f"_c{i}") for i in range(len(self.pairs))])
        return out.withColumn(name, total / float(len(self.pairs))).drop(
            *[f"_c{i}" for i in range(len(self.pairs))]
        )


def _margin(df: DataFrame, family: str) -> DataFrame:
    """Calibration input: log-odds for linear families, probability for the others."""
    p = F.col("_raw")
    return df.withColumn("_m", F.ln(p / (1.0 - p)) if family in LINEAR else p)


def isotonic_fold_ensemble(
    train: DataFrame, spec: DesignSpec, family: str, folds: int = 5, y: str = "y_true",
    fold: str = "fold", settings: PoolSettings = PoolSettings(), states: dict | None = None,
) -> FoldEnsemble:
    """Per fold: base model on the other folds, isotonic map on the fold itself.

    ``states`` are the folds' preprocessings when they are already known.
    """
    rows = _compact(train)
    if states is None:
        states = fold_states(rows, spec, folds, fold)

    def job(k: int):
        def run():
            base = fit_family(rows.where(F.col(fold) != k), spec, family, y, settings, None, states[k])
            held = _margin(base.score(rows.where(F.col(fold) == k), "_raw"), family)
            return base, fit_isotonic(held, "_m", y)
        return run

    return FoldEnsemble(family, in_parallel([job(k) for k in range(folds)], settings.parallelism))


# --- recalibration ---------------------------------------------------------------------

STRATEGIES = ("uncalibrated", "pooled_isotonic", "pooled_platt", "group_isotonic", "group_platt")


def recalibrate(
    train: DataFrame, test: DataFrame, group: str, a, b, y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Test rows under five recalibration strategies (column ``strategy``).

    The pooled rows and each group are units of one isotonic job and of one set of Platt fits. A
    group absent from training gets NULL from the group-wise strategies.
    """
    pooled = F.struct(F.lit(True).alias("pooled"), F.lit(None).cast(train.schema[group].dataType).alias("member"))
    own = F.struct(F.lit(False).alias("pooled"), F.col(group).alias("member"))

    def units(df: DataFrame) -> DataFrame:
        both = F.when(F.col(group).isin([a, b]), F.array(pooled, own)).otherwise(F.array(pooled))
        return df.withColumn("_u", F.explode(both)).select(
            *df.columns, F.col("_u.pooled").alias("_pooled"), F.col("_u.member").alias("_member"), clipped_logit(prob).alias("_logit")
        )

    keys = ["_pooled", "_member"]
    known = units(train).persist()
    blocks = isotonic.fit(known, keys, prob, y)
    platt = irls.fit_all(known, keys, [irls.Model("platt", ("_logit",), y, ridge=1.0)])
    known.unpersist()
    scored = platt.scored(isotonic.mapped(units(test), keys, prob, blocks, "_isotonic"), "platt", "_platt")
    names = {True: ("pooled_isotonic", "pooled_platt"), False: ("group_isotonic", "group_platt")}
    cells = lambda p: [
        F.struct(F.lit(n).alias("strategy"), F.col(c).alias("recalibrated")) for n, c in zip(names[p], ("_isotonic", "_platt"))
    ]
    first = F.struct(F.lit("uncalibrated").alias("strategy"), F.col(prob).cast("double").alias("recalibrated"))
    long = scored.withColumn("_c", F.explode(F.when(F.col("_pooled"), F.array(first, *cells(True))).otherwise(F.array(*cells(False)))))
    return long.select(*test.columns, F.col("_c.recalibrated").alias("recalibrated"), F.col("_c.strategy").alias("strategy"))


def recalibration_table(
    recalibrated: DataFrame, group: str, a, b, y: str = "y_true", threshold: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Per-group metrics and gap rows of every strategy; null scores are left out."""
    rows = recalibrated.where(F.col("recalibrated").isNotNull() & F.col(group).isin([a, b])).withColumn(
        "pred", (F.col("recalibrated") >= threshold).cast("int")
    )
    metrics = M.subgroup_metrics(rows, ["strategy", group], y, "recalibrated", "pred")
    gaps = G.gap_row(rows, ["strategy"], group, a, b, y, "recalibrated", "pred")
    return metrics, gaps


# --- scoring -----------------------------------------------------------------------------


def batch_score(model, df: DataFrame, threshold: float, family: str) -> DataFrame:
    """Probability, thresholded prediction, threshold and family for new rows."""
    return model.score(df, "prob_calibrated").withColumn(
        "y_pred_at_threshold", (F.col("prob_calibrated") >= threshold).cast("int")
    ).withColumn("operating_threshold", F.lit(float(threshold))).withColumn(
        "selected_family", F.lit(family)
    )


def save_fitted(model: Fitted, folder: str) -> None:
    for i, m in enumerate(model.members):
        m.write().overwrite().save(f"{folder}/{model.family}/member_{i}")


def load_fitted(folder: str, family: str, members: int, required: list[str]) -> Fitted:
    loaded = [PipelineModel.load(f"{folder}/{family}/member_{i}") for i in range(members)]
    return Fitted(family, loaded, required)


def verify_scoring(
    stored: DataFrame, rescored: DataFrame, row_id: str = "row_id", prob: str = "prob_calibrated"
) -> DataFrame:
    """Largest deviation between stored and recomputed scores, and unmatched rows."""
    other = rescored.select(row_id, F.col(prob).alias("_again"))
    joined = stored.select(row_id, F.col(prob).alias("_stored")).join(other, row_id, "full_outer")
    worst = F.max(F.abs(F.col("_stored") - F.col("_again")))
    unmatched = F.count_if(F.col("_stored").isNull() | F.col("_again").isNull())
    return joined.agg(
        F.count("*").alias("n_rows"), worst.alias("max_abs_deviation"), unmatched.alias("n_unmatched"),
        ((worst <= 1e-12) & (unmatched == 0)).alias("verified"),
    )


# --- robustness analyses -------------------------------------------------------------------


def null_models(
    train: DataFrame, test: DataFrame, group: str, a, b, single: str, block: list[str],
    y: str = "y_true", row_id: str = "row_id", seed: int = 42, threshold: float = 0.5, keys: list[str] = [],
) -> DataFrame:
    """Gap rows of trivial baselines: constant, one feature, random, a small block.

    A comparison that is absent from training has no scores but random ones.
    """
    models = [
        irls.Model("intercept_only", (), y), irls.Model("single_feature", (single,), y, ridge=1.0),
        irls.Model("simple_baseline", tuple(block), y, ridge=1.0),
    ]
    fits = irls.fit_all(train, keys, models)
    scored = test
    for m in models:
        scored = fits.scored(scored, m.name, f"_p_{m.name}")
    scores = {m.name: F.col(f"_p_{m.name}") for m in models}
    scores["random_score"] = hash_uniform([row_id], seed)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), s.alias("prob")) for n, s in scores.items()]))
    long = scored.select(*keys, group, y, cells.alias("_c")).select(*keys, group, y, "_c.*").where("prob is not null").withColumn(
        "pred", (F.col("prob") >= threshold).cast("int")
    )
    return G.gap_row(long, [*keys, "model"], group, a, b, y, "prob", "pred")


def family_robustness(
    train: DataFrame, test: DataFrame, spec: DesignSpec, group: str, a, b,
    families: tuple[str, ...] = FAMILIES, folds: int = 5, y: str = "y_true",
    threshold: float = 0.5, settings: PoolSettings = PoolSettings(), row_id: str = "row_id",
) -> DataFrame:
    """Gap row of every family after isotonic fold calibration; a failure is an error row."""
    pool = fit_pool(train, spec, families, y, "fold", folds, settings)
    errors = test.sparkSession.createDataFrame(list(pool.failed.items()), "family string, error string")
    if len(pool.failed) == len(families):
        return errors
    rows = _settled(calibrated_scores(train, test, pool, [group, y], row_id, y)).withColumn(
        "pred", (F.col("prob") >= threshold).cast("int")
    )
    table = G.gap_row(rows, ["family"], group, a, b, y, "prob", "pred")
    return table.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


INCLUSION = ("excludes_group", "includes_group", "group_calibration", "group_threshold", "separate_models")


def attribute_inclusion(
    train: DataFrame, test: DataFrame, features: list[str], group: str, a, b,
    y: str = "y_true", threshold: float = 0.5,
) -> DataFrame:
    """Five ways of treating the protected attribute, all with logistic regression.

    Thresholds of the group-threshold strategy come from training scores. Each
    strategy is one more value of the key ``strategy`` in a single metric job.
    """
    keep = [F.col(group).isin([a, b])]
    flag = (F.col(group) == F.lit(a)).cast("double")
    tr = train.where(*keep).withColumn("in_a", flag).persist()
    te = test.where(*keep).withColumn("in_a", flag)
    z = tuple(features)
    fits = irls.fit_all(tr, [], [
        irls.Model("blind", z, y, ridge=1.0, standardise=z),
        irls.Model("aware", (*z, "in_a"), y, ridge=1.0, standardise=(*z, "in_a")),
        irls.Model("a", z, y, where=F.col("in_a") == 1, ridge=1.0, standardise=z),
        irls.Model("b", z, y, where=F.col("in_a") == 0, ridge=1.0, standardise=z),
    ])
    keepcols = [group, y, "prob"]
    base_tr, base_te = fits.scored(tr, "blind", "prob"), fits.scored(te, "blind", "prob")
    both = fits.scored(fits.scored(te, "a", "_a"), "b", "_b")
    blocks = isotonic.fit(base_tr, [group], "prob", y)
    out = {
        "excludes_group": base_te.select(*keepcols),
        "includes_group": fits.scored(te, "aware", "prob").select(*keepcols),
        "group_calibration": isotonic.mapped(base_te.select(*keepcols), [group], "prob", blocks, "_c").select(group, y, F.col("_c").alias("prob")),
        "separate_models": both.withColumn("prob", F.when(F.col("in_a") == 1, F.col("_a")).otherwise(F.col("_b"))).select(*keepcols),
    }
    plain = reduce(
        DataFrame.unionByName,
        [df.withColumn("strategy", F.lit(s)) for s, df in out.items()],
    ).withColumn("pred", (F.col("prob") >= threshold).cast("int"))
    target = M.threshold_metrics(
        base_tr.withColumn("pred", (F.col("prob") >= threshold).cast("int")).withColumn("_k", F.lit(a).cast("string")),
        ["_k"], y, "pred",
    ).first()["sensitivity"]
    cut = {
        r[group]: r["threshold"]
        for r in equal_sensitivity_threshold(base_tr, [group], float(target), y, "prob").collect()
    }
    limit = F.when(F.col(group) == F.lit(a), F.lit(cut[a])).otherwise(F.lit(cut[b]))
    moved = base_te.select(*keepcols).withColumn("strategy", F.lit("group_threshold")).withColumn(
        "pred", (F.col("prob") >= limit).cast("int")
    )
    rows = plain.unionByName(moved.select(*plain.columns))
    table = G.gap_row(rows, ["strategy"], group, a, b, y, "prob", "pred")
    is_moved = F.col("strategy") == "group_threshold"
    return table.withColumn("brier", F.when(~is_moved, F.col("brier"))).withColumn(
        "ece", F.when(~is_moved, F.col("ece"))
    ).withColumn("threshold_a", F.when(is_moved, F.lit(cut[a]))).withColumn(
        "threshold_b", F.when(is_moved, F.lit(cut[b]))
    )


def repeated_splits(
    df: DataFrame, spec: DesignSpec, group: str, a, b, seeds: list[int], folds: int = 5,
    y: str = "y_true", row_id: str = "row_id", cluster: str | None = None,
    settings: PoolSettings = PoolSettings(),
) -> DataFrame:
    """Sensitivity gap of a logistic + isotonic ensemble on one new split per seed.

    The folds of a seed are fitted in the same passes over the rows and mapped by one isotonic job;
    ``settings.parallelism`` seeds run at a time.
    """
    from .splits import kfold_grouped, kfold_stratified, split_grouped, split_stratified

    kept = df.where(F.col(group).isin([a, b])).select(*dict.fromkeys([row_id, group, y, *spec.features, *([cluster] if cluster else [])])).persist()
    kept.count()

    def job(seed: int):
        def run() -> DataFrame:
            if cluster is None:
                sides = split_stratified(kept, [], y, row_id, seed)
                train = kfold_stratified(sides.where("split = 'train'"), [], y, row_id, seed, folds)
            else:
                sides = split_grouped(kept, [], cluster, seed)
                train = kfold_grouped(sides.where("split = 'train'"), [], y, cluster, seed, folds)
            train = train.persist()
            threshold = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
            pool = fit_pool(train, spec, ("logistic_regression",), y, "fold", folds, settings)
            scored = calibrated_scores(train, sides.where("split = 'test'"), pool, [group, y], row_id, y)
            pred = (F.col("prob") >= threshold).cast("int")
            pairs = G.pair_counts(scored, [], group, a, b, y, pred).withColumn("seed", F.lit(seed)).checkpoint()
            train.unpersist()
            return pairs

        return run

    ensure_checkpoint_dir(df.sparkSession)
    pairs = reduce(DataFrame.unionByName, in_parallel([job(s) for s in seeds], settings.parallelism))
    kept.unpersist()
    return G.with_side_rates(pairs, ("sensitivity",)).select("seed", G.gap("sensitivity").alias("gap"))
