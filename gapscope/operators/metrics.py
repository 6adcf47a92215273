"""Confusion-matrix, discrimination and calibration metrics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    COUNTS,
    RATES,
    count_where,
    equal_width_bin,
    is_clipped,
    linspace,
    ratio,
    score_lattice,
    threshold_rates,
)
from ..session import null_safe_join
from .ranking import exact_quantiles, prefix_sums

OVERALL = "overall"


def count_columns(y: str, pred: Column | str) -> list[Column]:
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(y)
    return [
        count_where((p == 1) & (t == 1)).alias("tp"),
        count_where((p == 1) & (t == 0)).alias("fp"),
        count_where((p == 0) & (t == 0)).alias("tn"),
        count_where((p == 0) & (t == 1)).alias("fn"),
    ]


def group_counts(df: DataFrame, keys: list[str], y: str = "y_true") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.col(y)).cast("bigint").alias("n_pos"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )


def confusion_counts(
    df: DataFrame, keys: list[str], y: str = "y_true", pred: str = "pred"
) -> DataFrame:
    return df.groupBy(*keys).agg(*count_columns(y, pred))


def confusion_table(
    df: DataFrame, keys: list[str], y: str = "y_true", pred: str = "pred"
) -> DataFrame:
    """Counts with their margins, one row per labelled group."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    return confusion_counts(df, keys, y, pred).select(
        *keys, *COUNTS,
        (tp + fn).alias("n_pos"), (fp + tn).alias("n_neg"), (tp + fp + tn + fn).alias("n"),
    )


def with_rates(counts: DataFrame, keys: list[str]) -> DataFrame:
    rates = threshold_rates(*[F.col(c) for c in COUNTS])
    extra = [c for c in counts.columns if c not in (*keys, *COUNTS)]
    return counts.select(
        *keys, *[c.alias(n) for n, c in rates.items()], *COUNTS, *extra
    )


def threshold_metrics(
    df: DataFrame, keys: list[str], y: str = "y_true", pred: str = "pred"
) -> DataFrame:
    return with_rates(confusion_counts(df, keys, y, pred), keys)


def score_cells(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Positives and negatives per distinct score: the sufficient table for ranking."""
    return (
        df.where(F.col(prob).isNotNull())
        .groupBy(*keys, F.col(prob).alias("prob"))
        .agg(
            count_where(F.col(y) == 1).alias("pos"),
            count_where(F.col(y) == 0).alias("neg"),
        )
        .withColumn("bucket", score_lattice("prob"))
    )


def ranked_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return prefix_sums(cells, keys, "bucket", "prob", ["pos", "neg"])


def discrimination_of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exact AUROC (half credit for ties) and step-wise average precision."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    both = F.col("_p") * F.col("_n")
    return (
        ranked_cells(cells, keys)
        .groupBy(*keys)
        .agg(
            F.sum(neg * (tp - pos / 2.0)).alias("_u"),
            F.sum(pos * F.try_divide(tp, tp + fp)).alias("_a"),
            F.max(F.col("tot_pos").cast("double")).alias("_p"),
            F.max(F.col("tot_neg").cast("double")).alias("_n"),
        )
        .select(
            *keys,
            F.try_divide(F.col("_u"), both).alias("auroc"),
            F.when(both > 0, F.try_divide(F.col("_a"), F.col("_p"))).alias("auprc"),
        )
    )


def discrimination(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    return discrimination_of_cells(score_cells(df, keys, y, prob), keys)


def roc_points(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """One ROC point per distinct score: counts and rates at ``score >= threshold``."""
    return ranked_cells(score_cells(df, keys, y, prob), keys).select(
        *keys,
        F.col("prob").alias("threshold"),
        F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        ratio(F.col("cum_pos"), F.col("tot_pos")).alias("tpr"),
        ratio(F.col("cum_neg"), F.col("tot_neg")).alias("fpr"),
    )


def binned(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob",
    pred: Column | str = "pred", bins: int = 10,
) -> DataFrame:
    """Additive per-bin sums from which counts, Brier and ECE all follow."""
    p, t = F.col(prob), F.col(y).cast("double")
    return (
        df.where(p.isNotNull())
        .groupBy(*keys, equal_width_bin(prob, bins).alias("bin"))
        .agg(
            *count_columns(y, pred),
            F.count("*").alias("bin_n"),
            F.sum(p).alias("sum_prob"),
            F.sum(t).alias("sum_y"),
            F.sum((p - t) * (p - t)).alias("sum_sq"),
            count_where(is_clipped(prob)).alias("n_clipped"),
        )
    )


def from_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, Brier score, ECE and clipped count from :func:`binned`."""
    return (
        bins.groupBy(*keys)
        .agg(
            *[F.sum(c).cast("bigint").alias(c) for c in COUNTS],
            F.sum("bin_n").alias("_n"),
            F.sum("sum_sq").alias("_sq"),
            F.sum(F.abs(F.col("sum_prob") - F.col("sum_y"))).alias("_ece"),
            F.sum("n_clipped").cast("bigint").alias("calib_n_clipped"),
        )
        .select(
            *keys, *COUNTS,
            ratio(F.col("_sq"), F.col("_n")).alias("brier"),
            ratio(F.col("_ece"), F.col("_n")).alias("ece"),
            "calib_n_clipped",
        )
    )


def brier(df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob") -> DataFrame:
    d = F.col(prob) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier"))


def ece(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob", bins: int = 10
) -> DataFrame:
    per_bin = df.groupBy(*keys, equal_width_bin(prob, bins).alias("bin")).agg(
        F.count("*").alias("_n"), F.sum(F.col(prob) - F.col(y)).alias("_d")
    )
    return per_bin.groupBy(*keys).agg(
        F.try_divide(F.sum(F.abs("_d")), F.sum("_n").cast("double")).alias("ece")
    )


def subgroup_metrics(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob",
    pred: Column | str = "pred",
) -> DataFrame:
    """Threshold, discrimination and calibration summary: two scans, small joins."""
    sums = with_rates(from_bins(binned(df, keys, y, prob, pred), keys), keys)
    return null_safe_join(sums, discrimination(df, keys, y, prob), keys)


def overall_and_subgroup(
    df: DataFrame, keys: list[str], group: str = "subgroup", y: str = "y_true",
    prob: str = "prob", pred: str = "pred",
) -> DataFrame:
    """Metrics of every subgroup plus the pooled row, from the same two scans.

    The pooled row is rolled up from the already aggregated bins and score
    cells, so raw rows are not duplicated as GROUPING SETS would.
    """
    both = F.explode(F.array(F.col(group).cast("string"), F.lit(OVERALL)))
    per_bin = binned(df, [*keys, group], y, prob, pred)
    sums = ["bin_n", *COUNTS, "sum_prob", "sum_y", "sum_sq", "n_clipped"]
    bins = (
        per_bin.withColumn("_g", both)
        .groupBy(*keys, F.col("_g").alias(group), "bin")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    cells = (
        score_cells(df, [*keys, group], y, prob)
        .withColumn("_g", both)
        .groupBy(*keys, F.col("_g").alias(group), "prob", "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    wide = [*keys, group]
    return null_safe_join(
        with_rates(from_bins(bins, wide), wide), discrimination_of_cells(cells, wide), wide
    )


def calibration_curve(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob", bins: int = 10
) -> DataFrame:
    """Mean prediction and observed rate of every bin; empty bins stay with NULLs."""
    filled = df.groupBy(*keys, equal_width_bin(prob, bins).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(prob).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"),
    )
    spine = filled.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    return null_safe_join(spine, filled, [*keys, "bin"], "left").select(
        *keys, "bin",
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        "mean_predicted", "observed_rate",
    )


def risk_decile_table(
    df: DataFrame, keys: list[str], group: str = "subgroup", y: str = "y_true",
    prob: str = "prob", pred: str = "pred", parts: int = 10,
) -> DataFrame:
    """Error table per score decile and group; edges are pooled over the groups."""
    edges = exact_quantiles(
        df, keys, prob, {f"e{i}": i / parts for i in range(parts + 1)}
    ).select(*keys, F.array_distinct(F.array(*[f"e{i}" for i in range(parts + 1)])).alias("_e"))
    from ..session import sized_broadcast

    labelled = null_safe_join(df, sized_broadcast(edges), keys).withColumn(
        "decile",
        F.greatest(
            F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(prob)))
        ).cast("int"),
    )
    wide = [*keys, "decile", group]
    counts = labelled.groupBy(*wide).agg(
        *count_columns(y, pred),
        F.min(prob).alias("score_range_low"),
        F.max(prob).alias("score_range_high"),
        F.avg(prob).alias("mean_predicted_score"),
    )
    return with_rates(counts, wide).select(
        *wide, "score_range_low", "score_range_high", "n", "n_pos", "n_neg",
        F.col("prevalence").alias("observed_prevalence"), "mean_predicted_score",
        "sensitivity", "fnr", "specificity", "fpr", "ppv", "npv",
    )


def score_distribution(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob", outcome: int = 1
) -> DataFrame:
    """Moments and exact quartiles of the score among positives or negatives."""
    part = df.where(F.col(y) == outcome)
    moments = part.groupBy(*keys).agg(
        F.count(prob).alias("n"),
        F.avg(prob).alias("mean"),
        F.stddev_pop(prob).alias("sd"),
    )
    quartiles = exact_quantiles(part, keys, prob, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return null_safe_join(moments, quartiles, keys)


def covariate_balance(
    df: DataFrame, keys: list[str], covariates: list[str], group: str, a, b
) -> DataFrame:
    """Mean, sample sd and n per group with the standardised mean difference."""
    aggregates = []
    for i, c in enumerate(covariates):
        x = F.col(c).try_cast("double")
        for side, label in (("a", a), ("b", b)):
            v = F.when(F.col(group) == F.lit(label), x)
            aggregates += [
                F.avg(v).alias(f"m{i}_{side}"),
                F.stddev_samp(v).alias(f"s{i}_{side}"),
                F.count(v).alias(f"n{i}_{side}"),
            ]
    wide = df.where(F.col(group).isin([a, b])).groupBy(*keys).agg(*aggregates)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("covariate"),
                    F.col(f"m{i}_a").alias("mean_a"), F.col(f"s{i}_a").alias("sd_a"),
                    F.col(f"n{i}_a").alias("n_a"),
                    F.col(f"m{i}_b").alias("mean_b"), F.col(f"s{i}_b").alias("sd_b"),
                    F.col(f"n{i}_b").alias("n_b"),
                )
                for i, c in enumerate(covariates)
            ]
        )
    )
    pooled = F.sqrt((F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")) / 2.0)
    long = wide.select(*keys, rows.alias("_r")).select(*keys, "_r.*")
    return long.withColumn(
        "smd", F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)
    ).withColumn("meaningful_imbalance", F.coalesce(F.abs("smd") > 0.1, F.lit(False)))


def all_groups_metrics(
    df: DataFrame, keys: list[str], group: str, primary: list[str],
    y: str = "y_true", pred: str = "pred",
) -> DataFrame:
    """Metrics of every level, labelled by the partition it was evaluated on."""
    label = F.when(F.col(group).isin(primary), F.lit("primary_heldout_test")).otherwise(
        F.lit("independent_nonprimary_holdout")
    )
    names = (
        "n", "n_pos", "prevalence", "sensitivity", "specificity", "fnr", "fpr", "ppv", "npv",
        "predicted_positive_rate",
    )
    return threshold_metrics(df, [*keys, group], y, pred).select(
        *keys, group, label.alias("evaluation_partition"),
        F.lit("|".join(primary)).alias("model_training_groups"), *names,
    )


def metric_denominators(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Numerator and denominator behind each reported rate, one row per metric."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    parts = {
        "prevalence": (tp + fn, tp + fp + tn + fn),
        "sensitivity": (tp, tp + fn),
        "specificity": (tn, tn + fp),
        "ppv": (tp, tp + fp),
        "npv": (tn, tn + fn),
    }
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    num.cast("bigint").alias("numerator"),
                    den.cast("bigint").alias("denominator"),
                )
                for m, (num, den) in parts.items()
            ]
        )
    )
    return counts.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def missing_data_flow(
    raw: DataFrame, kept: DataFrame, keys: list[str], predictors: list[str]
) -> DataFrame:
    """Row and missing-cell accounting before and after loading rules."""

    def nulls(columns: list[str]) -> Column:
        total = F.lit(0)
        for c in columns:
            total = total + F.col(c).isNull().cast("bigint")
        return F.sum(total).cast("bigint")

    before = raw.groupBy(*keys).agg(
        F.count("*").alias("raw_rows"),
        nulls([c for c in raw.columns if c not in keys]).alias("raw_missing_cells"),
    )
    after = kept.groupBy(*keys).agg(
        F.count("*").alias("analysis_rows"),
        nulls([c for c in kept.columns if c not in keys]).alias("analysis_missing_cells"),
        nulls(predictors).alias("predictor_missing_cells"),
    )
    joined = null_safe_join(before, after, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return joined.select(
        *keys, "raw_rows", zero("analysis_rows").alias("analysis_rows"),
        (F.col("raw_rows") - zero("analysis_rows")).alias("rows_excluded"),
        "raw_missing_cells",
        zero("analysis_missing_cells").alias("analysis_missing_cells"),
        zero("predictor_missing_cells").alias("predictor_missing_cells"),
    )


def rank_separation(
    df: DataFrame, keys: list[str], group: str, a, b, prob: str = "prob"
) -> DataFrame:
    """Two-sample KS statistic and Mann-Whitney U of A against B.

    ``prob_a_higher`` is U / (n_a n_b) = P(A > B) + half the ties; its p-value is
    for the alternative that A scores lower.
    """
    from ..functions.tails import kolmogorov_sf, normal_sf

    cells = (
        df.where(F.col(group).isin([a, b]) & F.col(prob).isNotNull())
        .groupBy(*keys, F.col(prob).alias("prob"))
        .agg(
            count_where(F.col(group) == F.lit(a)).alias("in_a"),
            count_where(F.col(group) == F.lit(b)).alias("in_b"),
        )
        .withColumn("bucket", score_lattice("prob"))
    )
    ranked = prefix_sums(cells, keys, "bucket", "prob", ["in_a", "in_b"], descending=False)
    d = lambda c: F.col(c).cast("double")
    ties = d("in_a") + d("in_b")
    stats = ranked.groupBy(*keys).agg(
        F.max(
            F.abs(F.try_divide(d("cum_in_a"), d("tot_in_a")) - F.try_divide(d("cum_in_b"), d("tot_in_b")))
        ).alias("ks_stat"),
        F.sum(d("in_a") * (d("cum_in_b") - d("in_b") / 2.0)).alias("u_stat"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
        F.max(F.col("tot_in_a")).cast("bigint").alias("n_a"),
        F.max(F.col("tot_in_b")).cast("bigint").alias("n_b"),
    )
    na, nb = d("n_a"), d("n_b")
    n = na + nb
    variance = na * nb / 12.0 * ((n + 1.0) - F.try_divide(F.col("_ties"), n * (n - 1.0)))
    z = F.try_divide(F.col("u_stat") - na * nb / 2.0 + 0.5, F.sqrt(variance))
    return stats.select(
        *keys, "n_a", "n_b", "ks_stat",
        kolmogorov_sf(F.sqrt(F.try_divide(na * nb, n)) * F.col("ks_stat")).alias("ks_p"),
        "u_stat",
        F.try_divide(F.col("u_stat"), na * nb).alias("prob_a_higher"),
        (1.0 - normal_sf(z)).alias("mwu_p_less"),
    )
