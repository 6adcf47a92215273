"""Threshold curves, searches, policies and the two-threshold trade-off grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    COUNTS,
    count_where,
    double_array,
    grid_index,
    linspace,
    threshold_rates,
)
from ..schema import SWEEP_METRICS, check_columns, sweep_columns
from ..session import null_safe_join, sized_broadcast
from . import gaps as G
from . import metrics as M
from .ranking import exact_quantiles, value_at_rank

SWEEP_GRID = linspace(0.01, 0.99, 99)
SEARCH_GRID = linspace(0.001, 0.999, 999)
COST_GRID = linspace(0.01, 0.99, 199)


def threshold_curve(
    df: DataFrame, keys: list[str], grid: list[float], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Confusion counts at every grid threshold from one scan.

    Rows are counted by the number of grid points they reach; running totals
    over that histogram (at most ``len(grid) + 1`` rows per group) give the
    counts at each threshold.
    """
    hist = (
        df.where(F.col(prob).isNotNull())
        .groupBy(*keys, grid_index(prob, grid).alias("reached"))
        .agg(count_where(F.col(y) == 1).alias("pos"), count_where(F.col(y) == 0).alias("neg"))
    )
    spine = (
        hist.select(*keys).distinct()
        .withColumn("reached", F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
    )
    full = null_safe_join(spine, hist, [*keys, "reached"], "left")
    w = Window.partitionBy(*keys).orderBy(F.col("reached").desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    group = Window.partitionBy(*keys)
    filled = full.fillna(0, ["pos", "neg"]).select(
        *keys, "reached",
        F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
        F.sum("pos").over(group).alias("_p"), F.sum("neg").over(group).alias("_n"),
    )
    points = double_array(grid)
    return filled.where(F.col("reached") > 0).select(
        *keys,
        F.col("reached").alias("step"),
        F.get(points, F.col("reached") - 1).alias("threshold"),
        "tp", "fp",
        (F.col("_n") - F.col("fp")).alias("tn"),
        (F.col("_p") - F.col("tp")).alias("fn"),
    )


def threshold_sweep(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Seven rates of A and B, their gaps and the impact ratio at 99 thresholds."""
    curve = threshold_curve(
        df.where(F.col(group).isin([a, b])), [*keys, group], SWEEP_GRID, y, prob
    )
    pairs = G.pair_table(curve, [*keys, "step", "threshold"], group, a, b)
    wide = G.with_side_rates(pairs, SWEEP_METRICS)
    cols = []
    for m in SWEEP_METRICS:
        cols += [
            F.col(f"{m}_a").alias(f"{m}_A"), F.col(f"{m}_b").alias(f"{m}_B"),
            G.gap(m).alias(f"{m}_gap"),
        ]
    di = F.try_divide(F.col("predicted_positive_rate_a"), F.col("predicted_positive_rate_b"))
    out = wide.select(
        *keys, F.round("threshold", 4).alias("threshold"), *cols,
        di.alias("disparate_impact_ratio"),
    )
    return check_columns(out, [*keys, *sweep_columns()])


def nearest_threshold(
    curve: DataFrame, keys: list[str], metric: str, target: Column, name: str = "threshold"
) -> DataFrame:
    """First grid threshold whose metric is closest to the target; 0.5 if undefined everywhere."""
    value = threshold_rates(*[F.col(c) for c in COUNTS])[metric]
    scored = curve.withColumn("_d", F.abs(value - target))
    best = F.min_by(
        "threshold",
        F.when(F.col("_d").isNotNull(), F.struct(F.col("_d"), F.col("threshold"))),
    )
    return scored.groupBy(*keys).agg(F.coalesce(best, F.lit(0.5)).alias(name))


def find_threshold_for_metric(
    df: DataFrame, keys: list[str], metric: str, target: float, y: str = "y_true",
    prob: str = "prob",
) -> DataFrame:
    curve = threshold_curve(df, keys, SEARCH_GRID, y, prob)
    return nearest_threshold(curve, keys, metric, F.lit(float(target)))


def with_thresholds(
    df: DataFrame, thresholds: DataFrame, keys: list[str], prob: str = "prob",
    name: str = "pred", threshold: str = "threshold",
) -> DataFrame:
    """Predictions under a per-key threshold table (its size is checked before broadcasting)."""
    joined = null_safe_join(df.drop(name), sized_broadcast(thresholds), keys)
    return joined.withColumn(name, (F.col(prob) >= F.col(threshold)).cast("int"))


def equal_metric_thresholds(
    df: DataFrame, keys: list[str], group: str, a, b, metric: str, shared: float,
    y: str = "y_true", prob: str = "prob",
) -> DataFrame:
    """Group thresholds matching the pooled metric; gaps before and after.

    Everything is read off two grids counted in the same scans: the counts at
    the shared threshold and the search grid's counts at the chosen points.
    """
    kept = df.where(F.col(group).isin([a, b]))
    shared_pred = (F.col(prob) >= F.lit(float(shared))).cast("int")
    before = G.pair_counts(kept, keys, group, a, b, y, shared_pred)
    target = before.select(*keys, G.pooled_rates()[metric].alias("target_value"))
    curve = null_safe_join(
        threshold_curve(kept, [*keys, group], SEARCH_GRID, y, prob), target, keys
    )
    chosen = nearest_threshold(curve, [*keys, group], metric, F.col("target_value"))
    at = null_safe_join(
        curve.select(*keys, group, "threshold", *COUNTS), chosen, [*keys, group, "threshold"]
    )
    fallback = null_safe_join(
        chosen, at.select(*keys, group), [*keys, group], "left_anti"
    )
    rest = null_safe_join(kept.select(*keys, group, y, prob), fallback, [*keys, group])
    rest_counts = rest.withColumn("_p", (F.col(prob) >= F.col("threshold")).cast("int")).groupBy(
        *keys, group, "threshold"
    ).agg(*M.count_columns(y, "_p"))
    after_rows = at.unionByName(rest_counts)
    after = null_safe_join(
        G.pair_table(after_rows, keys, group, a, b),
        after_rows.groupBy(*keys).agg(
            F.max(F.when(F.col(group) == F.lit(a), F.col("threshold"))).alias("threshold_a"),
            F.max(F.when(F.col(group) == F.lit(b), F.col("threshold"))).alias("threshold_b"),
        ),
        keys,
    )
    names = ("sensitivity", "fnr", "specificity", "fpr", "ppv", "npv", "predicted_positive_rate")
    first = G.with_side_rates(before, names).select(
        *keys, *[F.col(f"{m}_{s}").alias(f"before_{m}_{s}") for m in names for s in "ab"]
    )
    second = G.with_side_rates(after, names).select(
        *keys, "threshold_a", "threshold_b",
        *[F.col(f"{m}_{s}").alias(f"after_{m}_{s}") for m in names for s in "ab"],
    )
    wide = null_safe_join(null_safe_join(first, second, keys), target, keys)
    rows = []
    for m in names:
        g0 = F.col(f"before_{m}_a") - F.col(f"before_{m}_b")
        g1 = F.col(f"after_{m}_a") - F.col(f"after_{m}_b")
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"before_{m}_a").alias("before_a"), F.col(f"before_{m}_b").alias("before_b"),
                g0.alias("gap_before"),
                F.col(f"after_{m}_a").alias("after_a"), F.col(f"after_{m}_b").alias("after_b"),
                g1.alias("gap_after"), (g1 - g0).alias("gap_change"),
            )
        )
    ppr = "predicted_positive_rate"
    return wide.select(
        *keys, "target_value", "threshold_a", "threshold_b",
        F.try_divide(F.col(f"before_{ppr}_a"), F.col(f"before_{ppr}_b")).alias("dir_before"),
        F.try_divide(F.col(f"after_{ppr}_a"), F.col(f"after_{ppr}_b")).alias("dir_after"),
        F.explode(F.array(*rows)).alias("_r"),
    ).select(
        *keys, "target_value", "threshold_a", "threshold_b", "_r.*", "dir_before", "dir_after"
    )


def check_target(target: float) -> float:
    if not math.isfinite(target) or not 0.0 <= target <= 1.0:
        raise ValueError("target sensitivity must be a finite value in [0, 1]")
    return float(target)


def equal_sensitivity_threshold(
    df: DataFrame, keys: list[str], target: float | Column, y: str = "y_true",
    prob: str = "prob",
) -> DataFrame:
    """Score of the k-th best positive, k = ceil(target x positives); infinity when k is 0.

    ``target`` may be a column over ``keys`` that are present in the rows.
    """
    t = F.lit(check_target(target)) if isinstance(target, (int, float)) else target
    k = F.ceil(t * F.col("_total"))
    found = value_at_rank(df.where(F.col(y) == 1), keys, prob, k, "threshold", descending=True)
    everyone = df.groupBy(*keys).agg(count_where(F.col(y) == 1).alias("_p"))
    out = null_safe_join(everyone, found, keys, "left")
    return out.select(
        *keys,
        F.when(F.col("_p") == 0, F.raise_error(F.lit("a group has no positive observations")))
        .otherwise(F.coalesce(F.col("threshold"), F.lit(float("inf"))))
        .cast("double")
        .alias("threshold"),
    )


def equal_sensitivity_analysis(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob",
    pred: str = "pred",
) -> DataFrame:
    """Gaps at the shared threshold beside gaps at equal-sensitivity thresholds.

    Exploratory by construction: thresholds and gaps use the same outcomes.
    """
    kept = df.where(F.col(group).isin([a, b]))
    shared = G.pair_counts(kept, keys, group, a, b, y, pred)
    target = shared.select(*keys, G.pooled_rates()["sensitivity"].alias("target_sensitivity"))
    withtarget = null_safe_join(kept, sized_broadcast(target), keys)
    thresholds = equal_sensitivity_threshold(
        withtarget, [*keys, "target_sensitivity", group], F.col("target_sensitivity"), y, prob
    ).drop("target_sensitivity")
    moved = with_thresholds(kept, thresholds, [*keys, group], prob, "_eq")
    equal = G.pair_counts(moved, keys, group, a, b, y, "_eq")
    names = [
        "equal_opportunity_diff", "equalized_odds_diff", "demographic_parity_diff",
        "disparate_impact_ratio", "ppv_diff", "npv_diff", "fnr_diff",
    ]
    first, second = G.fairness_gaps(shared, keys), G.fairness_gaps(equal, keys)
    joined = null_safe_join(
        first.select(*keys, *[F.col(n).alias(f"s_{n}") for n in names]),
        second.select(*keys, *[F.col(n).alias(f"e_{n}") for n in names]),
        keys,
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("gap"), F.col(f"s_{n}").alias("shared_threshold"),
                    F.col(f"e_{n}").alias("equal_sensitivity"),
                )
                for n in names
            ]
        )
    )
    return joined.select(*keys, rows.alias("_r")).select(
        *keys, "_r.*", F.lit("exploratory_descriptive").alias("analysis_status")
    )


def top_k_threshold(
    df: DataFrame, keys: list[str], share: float = 0.20, prob: str = "prob"
) -> DataFrame:
    """Threshold flagging the top share of scores (linear interpolation)."""
    return exact_quantiles(df, keys, prob, {"threshold": 1.0 - share})


def youden_threshold(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Score maximising tpr - fpr, the highest such score; infinity if never positive."""
    points = M.roc_points(df, keys, y, prob).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = points.groupBy(*keys).agg(F.max(F.struct("j", "threshold")).alias("_b"))
    return best.select(
        *keys,
        F.when(F.col("_b.j") > 0, F.col("_b.threshold"))
        .otherwise(F.lit(float("inf")))
        .alias("threshold"),
    )


def cost_threshold(
    df: DataFrame, keys: list[str], cost_fn: float = 5.0, cost_fp: float = 1.0,
    y: str = "y_true", prob: str = "prob",
) -> DataFrame:
    """First of 199 grid thresholds with the smallest misclassification cost."""
    cost = F.lit(cost_fn) * F.col("fn") + F.lit(cost_fp) * F.col("fp")
    return threshold_curve(df, keys, COST_GRID, y, prob).groupBy(*keys).agg(
        F.min(F.struct(cost.alias("c"), F.col("threshold").alias("t")))["t"].alias("threshold")
    )


POLICIES = (
    "fixed_050", "prevalence", "youden", "fixed_sensitivity", "fixed_specificity", "top_k",
    "cost_sensitive",
)


def policy_thresholds(
    train: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """One column per policy, derived from training scores only."""
    curve = threshold_curve(train, keys, SEARCH_GRID, y, prob)
    base = train.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("t_prevalence"))
    base = base.withColumn("t_fixed_050", F.lit(0.5))
    parts = {
        "youden": youden_threshold(train, keys, y, prob),
        "fixed_sensitivity": nearest_threshold(curve, keys, "sensitivity", F.lit(0.80)),
        "fixed_specificity": nearest_threshold(curve, keys, "specificity", F.lit(0.80)),
        "top_k": top_k_threshold(train, keys, 0.20, prob),
        "cost_sensitive": cost_threshold(train, keys, 5.0, 1.0, y, prob),
    }
    for name, table in parts.items():
        base = null_safe_join(base, table.withColumnRenamed("threshold", f"t_{name}"), keys)
    return base.select(*keys, *[f"t_{p}" for p in POLICIES])


def threshold_policies(
    train: DataFrame, test: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true",
    prob: str = "prob",
) -> DataFrame:
    """Gap row of the fixed test scores under each of the seven policies.

    Policies are columns of a small joined table, so test rows are read once
    and never multiplied by the number of policies.
    """
    kept = test.where(F.col(group).isin([a, b]))
    wide = null_safe_join(kept, sized_broadcast(policy_thresholds(train, keys, y, prob)), keys)
    aggregates = []
    for p in POLICIES:
        flag, t = F.col(prob) >= F.col(f"t_{p}"), F.col(y)
        for s, label in (("a", a), ("b", b)):
            here = F.col(group) == F.lit(label)
            aggregates += [
                count_where(here & flag & (t == 1)).alias(f"{p}_tp_{s}"),
                count_where(here & flag & (t == 0)).alias(f"{p}_fp_{s}"),
                count_where(here & ~flag & (t == 0)).alias(f"{p}_tn_{s}"),
                count_where(here & ~flag & (t == 1)).alias(f"{p}_fn_{s}"),
            ]
        aggregates.append(F.max(f"t_{p}").alias(f"{p}_threshold"))
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("policy"), F.col(f"{p}_threshold").alias("threshold"),
                    *[F.col(f"{p}_{c}_{s}").alias(f"{c}_{s}") for c in COUNTS for s in "ab"],
                )
                for p in POLICIES
            ]
        )
    )
    pairs = wide.groupBy(*keys).agg(*aggregates).select(*keys, rows.alias("_r")).select(*keys, "_r.*")
    full = G.gap_row_of_pairs(pairs, [*keys, "policy"], ["threshold"])
    return null_safe_join(full, G.pooled_scores(kept, keys, y, prob), keys)


def two_threshold_grid(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob",
    size: int = 25,
) -> DataFrame:
    """Violations and utility at every pair of group thresholds (size x size per comparison)."""
    grid = linspace(0.01, 0.99, size)
    curve = threshold_curve(df.where(F.col(group).isin([a, b])), [*keys, group], grid, y, prob)

    def side(label, s: str) -> DataFrame:
        rates = threshold_rates(*[F.col(c) for c in COUNTS])
        names = ("n_pos", "n_neg", "sensitivity", "specificity", "ppv", "npv",
                 "predicted_positive_rate")
        return curve.where(F.col(group) == F.lit(label)).groupBy(*keys).agg(
            F.collect_list(
                F.struct(
                    F.col("threshold"),
                    *[rates[n].alias(n) for n in names],
                )
            ).alias(f"_{s}")
        )

    both = null_safe_join(side(a, "a"), side(b, "b"), keys)
    points = both.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    pos, neg = F.col("_a.n_pos") + F.col("_b.n_pos"), F.col("_a.n_neg") + F.col("_b.n_neg")

    def pooled(m: str, w: str, total: Column) -> Column:
        return F.try_divide(
            F.col(f"_a.{m}") * F.col(f"_a.{w}") + F.col(f"_b.{m}") * F.col(f"_b.{w}"),
            total.cast("double"),
        )

    sens, spec = pooled("sensitivity", "n_pos", pos), pooled("specificity", "n_neg", neg)
    both_known = F.when(sens.isNotNull() & spec.isNotNull(), (sens + spec) / 2.0)
    diff = lambda m: F.abs(F.col(f"_a.{m}") - F.col(f"_b.{m}"))
    return points.select(
        *keys,
        F.col("_a.threshold").alias("threshold_a"), F.col("_b.threshold").alias("threshold_b"),
        diff("sensitivity").alias("eo_violation"),
        diff("predicted_positive_rate").alias("dp_violation"),
        diff("ppv").alias("ppv_violation"), diff("npv").alias("npv_violation"),
        F.coalesce(both_known, sens, spec).alias("utility"),
    ).where(F.col("ppv_violation").isNotNull() & F.col("npv_violation").isNotNull())


AXES = ("eo_violation", "dp_violation", "ppv_violation", "npv_violation")


def non_dominated(points: DataFrame, keys: list[str], name: str = "pareto_optimal") -> DataFrame:
    """Flag points that no other point of the same comparison dominates.

    Domination needs <= on four violations, >= on utility and one strict
    inequality. The join is an equi-join on ``keys`` with the inequalities as a
    residual condition; a comparison has at most one row per pair of grid
    thresholds, and equal metric vectors are collapsed first.
    """
    measures = [*AXES, "utility"]
    distinct = points.select(*keys, *measures).distinct()
    other = distinct.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(m).alias(f"_o_{m}") for m in measures]
    )
    no_worse, strict = F.col("_o_utility") >= F.col("utility"), F.col("_o_utility") > F.col("utility")
    for m in AXES:
        no_worse = no_worse & (F.col(f"_o_{m}") <= F.col(m))
        strict = strict | (F.col(f"_o_{m}") < F.col(m))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    best = distinct.join(other, same & no_worse & strict, "left_anti").withColumn(name, F.lit(True))
    flagged = null_safe_join(points, best, [*keys, *measures], "left")
    return flagged.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def pareto_grid(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob",
    size: int = 25,
) -> DataFrame:
    return non_dominated(two_threshold_grid(df, keys, group, a, b, y, prob, size), keys)


def train_prevalence_threshold(
    train: DataFrame, keys: list[str], y: str = "y_true"
) -> DataFrame:
    """Operating threshold: the outcome prevalence of the training rows."""
    return train.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("threshold"))


def fixed_threshold(value: float, allow_nonprimary: bool = False) -> float:
    """A numeric threshold is accepted only for a labelled secondary analysis."""
    if not allow_nonprimary:
        raise ValueError("primary analyses use the training prevalence as threshold")
    if not math.isfinite(value) or not 0.0 <= value <= 1.0:
        raise ValueError("a numeric threshold must be finite and in [0, 1]")
    return float(value)
