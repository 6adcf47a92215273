"""A minus B comparisons built on one row of paired counts per comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    COUNTS,
    PREVALENCE_SENSITIVE,
    at_prevalence,
    attenuation,
    count_where,
    double_array,
    linspace,
    ratio,
    threshold_rates,
)
from ..session import null_safe_join
from . import metrics as M


def pair_counts(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true",
    pred: Column | str = "pred",
) -> DataFrame:
    """tp/fp/tn/fn of A and B on one row: a single pass of conditional counts."""
    p = F.col(pred) if isinstance(pred, str) else pred
    t, g = F.col(y), F.col(group)
    cols = []
    for side, label in (("a", a), ("b", b)):
        here = g == F.lit(label)
        cols += [
            count_where(here & (p == 1) & (t == 1)).alias(f"tp_{side}"),
            count_where(here & (p == 1) & (t == 0)).alias(f"fp_{side}"),
            count_where(here & (p == 0) & (t == 0)).alias(f"tn_{side}"),
            count_where(here & (p == 0) & (t == 1)).alias(f"fn_{side}"),
        ]
    return df.where(g.isin([a, b])).groupBy(*keys).agg(*cols)


def pair_table(counts: DataFrame, keys: list[str], group: str, a, b) -> DataFrame:
    """Same shape as :func:`pair_counts` from an already aggregated count table."""
    cols = [
        F.coalesce(F.sum(F.when(F.col(group) == F.lit(label), F.col(c))), F.lit(0))
        .cast("bigint")
        .alias(f"{c}_{side}")
        for side, label in (("a", a), ("b", b))
        for c in COUNTS
    ]
    return counts.where(F.col(group).isin([a, b])).groupBy(*keys).agg(*cols)


def side_rates(side: str) -> dict[str, Column]:
    return threshold_rates(*[F.col(f"{c}_{side}") for c in COUNTS])


def pooled_rates() -> dict[str, Column]:
    return threshold_rates(*[F.col(f"{c}_a") + F.col(f"{c}_b") for c in COUNTS])


def with_side_rates(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Append ``<name>_a`` and ``<name>_b`` so later expressions reuse them."""
    rates = {s: side_rates(s) for s in ("a", "b")}
    return pairs.select("*", *[rates[s][n].alias(f"{n}_{s}") for s in ("a", "b") for n in names])


CORE = (
    "n", "n_pos", "n_neg", "prevalence", "predicted_positive_rate", "sensitivity",
    "specificity", "fpr", "fnr", "ppv", "npv",
)


def gap(name: str) -> Column:
    return F.col(f"{name}_a") - F.col(f"{name}_b")


def fairness_gaps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps used as group-fairness criteria (AUROC's is added by the caller's join)."""
    wide = with_side_rates(pairs, CORE)
    return wide.select(
        *keys,
        gap("sensitivity").alias("equal_opportunity_diff"),
        F.greatest(F.abs(gap("sensitivity")), F.abs(gap("fpr"))).alias("equalized_odds_diff"),
        gap("predicted_positive_rate").alias("demographic_parity_diff"),
        F.try_divide(
            F.col("predicted_positive_rate_a"), F.col("predicted_positive_rate_b")
        ).alias("disparate_impact_ratio"),
        gap("ppv").alias("ppv_diff"),
        gap("npv").alias("npv_diff"),
        gap("fnr").alias("fnr_diff"),
    )


def auroc_gap(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    per_side = M.discrimination(df.where(F.col(group).isin([a, b])), [*keys, group], y, prob)
    pick = lambda label: F.max(F.when(F.col(group) == F.lit(label), F.col("auroc")))
    return per_side.groupBy(*keys).agg((pick(a) - pick(b)).alias("auroc_diff"))


def target_prevalence() -> Column:
    return ratio(F.col("n_pos_a") + F.col("n_pos_b"), F.col("n_a") + F.col("n_b"))


def with_adjusted(wide: DataFrame, target: Column | None = None) -> DataFrame:
    """Append the shared target prevalence and both sides' Bayes-adjusted rates."""
    out = wide.withColumn("target_prevalence", target_prevalence() if target is None else target)
    cols = []
    for s in ("a", "b"):
        adj = at_prevalence(
            F.col(f"sensitivity_{s}"), F.col(f"specificity_{s}"), F.col("target_prevalence")
        )
        cols += [adj[m].alias(f"{m}_adj_{s}") for m in PREVALENCE_SENSITIVE]
    return out.select("*", *cols)


def bayes_at_prevalence(metrics: DataFrame, keys: list[str], prevalence: Column) -> DataFrame:
    adj = at_prevalence(F.col("sensitivity"), F.col("specificity"), prevalence)
    return metrics.select(
        *keys, prevalence.alias("at_prevalence"), *[c.alias(n) for n, c in adj.items()]
    )


def prevalence_adjusted_gap(
    pairs: DataFrame, keys: list[str], target: Column | None = None
) -> DataFrame:
    """Raw and prevalence-standardised gaps of PPV, NPV and predicted-positive rate."""
    wide = with_adjusted(with_side_rates(pairs, CORE), target)
    rows = []
    for m in PREVALENCE_SENSITIVE:
        raw = F.col(f"{m}_a") - F.col(f"{m}_b")
        adj = F.col(f"{m}_adj_a") - F.col(f"{m}_adj_b")
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_a").alias("raw_a"), F.col(f"{m}_b").alias("raw_b"),
                raw.alias("raw_gap"),
                F.col(f"{m}_adj_a").alias("adjusted_a"), F.col(f"{m}_adj_b").alias("adjusted_b"),
                adj.alias("adjusted_gap"),
                attenuation(raw, adj).alias("attenuation_pct"),
            )
        )
    raw_di = F.try_divide(F.col("predicted_positive_rate_a"), F.col("predicted_positive_rate_b"))
    adj_di = F.try_divide(
        F.col("predicted_positive_rate_adj_a"), F.col("predicted_positive_rate_adj_b")
    )
    return wide.select(
        *keys, "target_prevalence", raw_di.alias("disparate_impact_raw"),
        adj_di.alias("disparate_impact_adjusted"), F.explode(F.array(*rows)).alias("_r"),
    ).select(
        *keys, "target_prevalence", "_r.*", "disparate_impact_raw", "disparate_impact_adjusted"
    )


def ipw_prevalence(
    pairs: DataFrame, keys: list[str], target: Column | None = None
) -> DataFrame:
    """Weight cases to a shared prevalence and compare with the Bayes adjustment.

    Weights depend on the outcome only, so the weighted sums are the weighted
    confusion counts and no second pass over rows is needed.
    """
    wide = with_adjusted(with_side_rates(pairs, CORE), target)
    t = F.col("target_prevalence")
    weighted: dict[str, dict[str, Column]] = {}
    for s in ("a", "b"):
        prev = F.col(f"prevalence_{s}")
        w1 = F.when(prev > 0, F.try_divide(t, prev)).otherwise(1.0)
        w0 = F.when(prev < 1, F.try_divide(1.0 - t, 1.0 - prev)).otherwise(1.0)
        tp, fn = F.col(f"tp_{s}") * w1, F.col(f"fn_{s}") * w1
        fp, tn = F.col(f"fp_{s}") * w0, F.col(f"tn_{s}") * w0
        weighted[s] = {
            "ppv": F.try_divide(tp, tp + fp),
            "npv": F.try_divide(tn, tn + fn),
            "predicted_positive_rate": F.try_divide(tp + fp, tp + fp + tn + fn),
        }
    rows = []
    for m in PREVALENCE_SENSITIVE:
        bayes = F.col(f"{m}_adj_a") - F.col(f"{m}_adj_b")
        ipw = weighted["a"][m] - weighted["b"][m]
        rows.append(
            F.struct(
                F.lit(m).alias("metric"), bayes.alias("bayes_adj_gap"), ipw.alias("ipw_adj_gap"),
                F.abs(bayes - ipw).alias("absolute_diff"),
            )
        )
    return wide.select(
        *keys, "target_prevalence", F.explode(F.array(*rows)).alias("_r")
    ).select(*keys, "target_prevalence", "_r.*")


def prevalence_sweep(
    pairs: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.50, steps: int = 50
) -> DataFrame:
    """Bayes-adjusted gaps over a grid of shared prevalences (grid size is fixed)."""
    wide = with_side_rates(pairs, ("sensitivity", "specificity"))
    grid = double_array(linspace(low, high, steps))
    long = wide.select(
        *keys, "sensitivity_a", "specificity_a", "sensitivity_b", "specificity_b",
        F.explode(grid).alias("target_prevalence"),
    )
    t = F.col("target_prevalence")
    adj = {
        s: at_prevalence(F.col(f"sensitivity_{s}"), F.col(f"specificity_{s}"), t)
        for s in ("a", "b")
    }
    out = []
    for m, short in (("ppv", "ppv"), ("npv", "npv"), ("predicted_positive_rate", "ppr")):
        out += [
            adj["a"][m].alias(f"{short}_a"), adj["b"][m].alias(f"{short}_b"),
            (adj["a"][m] - adj["b"][m]).alias(f"{short}_gap"),
        ]
    di = F.try_divide(
        adj["a"]["predicted_positive_rate"], adj["b"]["predicted_positive_rate"]
    ).alias("disparate_impact_ratio")
    return long.select(*keys, "target_prevalence", *out, di)


def shapley_gap(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact three-input Shapley split of the PPV, NPV and PPR gaps.

    With three players the Shapley value is a weighted sum over the eight
    corners of the cube (inputs of A or of B): weight 1/3 with no or both other
    inputs switched, 1/6 with exactly one.
    """
    wide = with_side_rates(pairs, ("sensitivity", "specificity", "prevalence"))
    inputs = ("sensitivity", "specificity", "prevalence")
    corner = {}
    for i in "ab":
        for j in "ab":
            for k in "ab":
                corner[i + j + k] = at_prevalence(
                    F.col(f"sensitivity_{i}"), F.col(f"specificity_{j}"), F.col(f"prevalence_{k}")
                )

    def share(player: int, metric: str) -> Column:
        total = F.lit(0.0)
        others = [p for p in range(3) if p != player]
        for x in "ab":
            for z in "ab":
                name = [""] * 3
                name[others[0]], name[others[1]] = x, z
                name[player] = "a"
                on = corner["".join(name)][metric]
                name[player] = "b"
                off = corner["".join(name)][metric]
                total = total + (on - off) / (F.lit(3.0) if x == z else F.lit(6.0))
        return total

    rows = []
    for m in PREVALENCE_SENSITIVE:
        parts = {p: share(i, m) for i, p in enumerate(inputs)}
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                (corner["aaa"][m] - corner["bbb"][m]).alias("raw_gap"),
                *[c.alias(f"shapley_{p}") for p, c in parts.items()],
            )
        )
    long = wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")
    return long.withColumn(
        "check_sum",
        F.col("shapley_prevalence") + F.col("shapley_sensitivity") + F.col("shapley_specificity"),
    )


def gap_columns() -> list[Column]:
    """The gap part of a comparison row, over columns of :func:`with_adjusted`."""
    raw = {m: F.col(f"{m}_a") - F.col(f"{m}_b") for m in ("ppv", "npv")}
    adj = {m: F.col(f"{m}_adj_a") - F.col(f"{m}_adj_b") for m in ("ppv", "npv")}
    return [
        gap("sensitivity").alias("sensitivity_gap"),
        gap("fnr").alias("fnr_gap"),
        gap("specificity").alias("specificity_gap"),
        gap("fpr").alias("fpr_gap"),
        gap("predicted_positive_rate").alias("ppr_gap"),
        F.try_divide(
            F.col("predicted_positive_rate_a"), F.col("predicted_positive_rate_b")
        ).alias("disparate_impact_ratio"),
        raw["ppv"].alias("ppv_gap_raw"), adj["ppv"].alias("ppv_gap_adj"),
        attenuation(raw["ppv"], adj["ppv"]).alias("ppv_attenuation_pct"),
        raw["npv"].alias("npv_gap_raw"), adj["npv"].alias("npv_gap_adj"),
        attenuation(raw["npv"], adj["npv"]).alias("npv_attenuation_pct"),
    ]


def gap_row_of_pairs(pairs: DataFrame, keys: list[str], extra: list[str] = []) -> DataFrame:
    wide = with_adjusted(with_side_rates(pairs, CORE))
    return wide.select(
        *keys, *extra, F.col("sensitivity_a").alias("sensitivity_A"),
        F.col("sensitivity_b").alias("sensitivity_B"), *gap_columns(),
    )


def pooled_scores(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """AUROC, AUPRC, Brier and ECE of all rows of a comparison."""
    sums = M.from_bins(
        M.binned(df, keys, y, prob, pred=F.lit(0)), keys
    ).select(*keys, "brier", "ece")
    return null_safe_join(M.discrimination(df, keys, y, prob), sums, keys)


def gap_row(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob",
    pred: Column | str = "pred",
) -> DataFrame:
    """Pooled discrimination and calibration beside every raw and adjusted gap."""
    kept = df.where(F.col(group).isin([a, b]))
    pairs = pair_counts(kept, keys, group, a, b, y, pred)
    return null_safe_join(
        pooled_scores(kept, keys, y, prob), gap_row_of_pairs(pairs, keys), keys
    )


def stratum_gaps(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true", prob: str = "prob",
    pred: str = "pred", smallest: int = 10,
) -> DataFrame:
    """A minus B inside every stratum in ``keys``; tiny strata keep counts and a note."""
    kept = df.where(F.col(group).isin([a, b]))
    pairs = with_adjusted(with_side_rates(pair_counts(kept, keys, group, a, b, y, pred), CORE))
    rows = pairs.select(
        *keys, F.col("n_a"), F.col("n_b"),
        F.col("sensitivity_a").alias("sensitivity_A"),
        F.col("sensitivity_b").alias("sensitivity_B"), *gap_columns(),
    )
    full = null_safe_join(rows, pooled_scores(kept, keys, y, prob), keys)
    enough = (F.col("n_a") >= smallest) & (F.col("n_b") >= smallest)
    values = [c for c in full.columns if c not in (*keys, "n_a", "n_b")]
    return full.select(
        *keys, "n_a", "n_b",
        *[F.when(enough, F.col(c)).alias(c) for c in values],
        F.when(enough, F.lit("")).otherwise(F.lit("insufficient sample size")).alias("note"),
    )


def additional_attributes(
    df: DataFrame, keys: list[str], attributes: dict[str, tuple], y: str = "y_true",
    prob: str = "prob", pred: str = "pred",
) -> DataFrame:
    """Gap rows of several other attributes from the same predictions, in one job."""
    pieces = F.array(
        *[
            F.struct(
                F.lit(name).alias("attribute"),
                F.when(F.col(name) == F.lit(a), F.lit("A"))
                .when(F.col(name) == F.lit(b), F.lit("B"))
                .alias("_side"),
            )
            for name, (a, b) in attributes.items()
        ]
    )
    long = df.select(
        *keys, y, prob, pred, F.explode(F.filter(pieces, lambda s: s["_side"].isNotNull())).alias("_x")
    ).select(*keys, y, prob, pred, "_x.*")
    return stratum_gaps(long, [*keys, "attribute"], "_side", "A", "B", y, prob, pred)
