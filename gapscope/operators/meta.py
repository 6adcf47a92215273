"""Random-effects pooling over studies and multiple-testing control.

Input tables hold one row per study or test; they are results, not data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import Z975, chi2_sf, t_quantile_975
from ..session import null_safe_join


def _pool(studies: DataFrame, keys: list[str], est: str, se: str) -> DataFrame:
    """DerSimonian-Laird pooling per key from power sums of the fixed weights.

    Q = sum(w e^2) - (sum w e)^2 / sum(w), so a single aggregate yields tau^2;
    a second one over the same rows gives the random-effects mean.
    """
    w = 1.0 / (F.col(se) * F.col(se))
    weighted = studies.withColumn("_w", w)
    first = weighted.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sww"),
        F.sum(F.col("_w") * F.col(est)).alias("_swe"),
    )
    centred = null_safe_join(weighted, first, keys).withColumn(
        "_q", F.col("_w") * F.pow(F.col(est) - F.col("_swe") / F.col("_sw"), F.lit(2.0))
    )
    second = centred.groupBy(*keys).agg(
        F.first("k").alias("k"), F.first("_sw").alias("_sw"),
        F.first("_sww").alias("_sww"), F.sum("_q").alias("q"),
    )
    c = F.col("_sw") - F.col("_sww") / F.col("_sw")
    tau2 = F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0)
    spread = second.select(*keys, "k", "q", tau2.alias("tau2"), F.col("_sw").alias("_fixed_total"))
    return null_safe_join(weighted, spread, keys).withColumn(
        "_wr", 1.0 / (F.col(se) * F.col(se) + F.col("tau2"))
    )


def _pooled_rows(pool: DataFrame, keys: list[str], est: str) -> DataFrame:
    return pool.groupBy(*keys).agg(
        F.first("k").alias("k"), F.first("q").alias("q"), F.first("tau2").alias("tau2"),
        (F.sum(F.col("_wr") * F.col(est)) / F.sum("_wr")).alias("pooled_estimate"),
        F.sqrt(1.0 / F.sum("_wr")).alias("pooled_se"),
    )


def random_effects(
    studies: DataFrame, keys: list[str], est: str = "estimate", se: str = "se",
    tails: bool = True,
) -> DataFrame:
    """Pooled estimate, heterogeneity and, with ``tails``, Q's p-value and prediction interval."""
    rows = _pooled_rows(_pool(studies, keys, est, se), keys, est)
    df = F.col("k") - 1
    out = rows.select(
        *keys, "k", "pooled_estimate", "pooled_se",
        (F.col("pooled_estimate") - F.lit(Z975) * F.col("pooled_se")).alias("pooled_ci_low"),
        (F.col("pooled_estimate") + F.lit(Z975) * F.col("pooled_se")).alias("pooled_ci_high"),
        "tau2", "q", df.cast("bigint").alias("q_df"),
        F.when(
            (df > 0) & (F.col("q") > 0),
            F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q")) * 100.0,
        ).otherwise(0.0).alias("i2"),
    )
    if not tails:
        return out
    t = t_quantile_975((F.col("k") - 2).cast("double"))
    half = t * F.sqrt(F.col("pooled_se") * F.col("pooled_se") + F.col("tau2"))
    return out.select(
        "*",
        F.when(F.col("q_df") > 0, chi2_sf(F.col("q"), F.col("q_df").cast("double"))).alias("q_pvalue"),
        F.when(F.col("k") > 2, F.col("pooled_estimate") - half).alias("prediction_interval_low"),
        F.when(F.col("k") > 2, F.col("pooled_estimate") + half).alias("prediction_interval_high"),
    )


def study_weights(
    studies: DataFrame, keys: list[str], study: str, est: str = "estimate", se: str = "se"
) -> DataFrame:
    """Fixed- and random-effects weights of every study, in per cent."""
    pool = _pool(studies, keys, est, se)
    totals = pool.groupBy(*keys).agg(F.sum("_w").alias("_tw"), F.sum("_wr").alias("_twr"))
    return null_safe_join(pool, totals, keys).select(
        *keys, study, est, se,
        (100.0 * F.col("_w") / F.col("_tw")).alias("weight_fixed_pct"),
        (100.0 * F.col("_wr") / F.col("_twr")).alias("weight_random_pct"),
    )


def leave_one_out(
    studies: DataFrame, keys: list[str], study: str, est: str = "estimate", se: str = "se"
) -> DataFrame:
    """Re-pool without each study in turn; needs two remaining studies."""
    names = studies.select(*keys, F.col(study).alias("excluded"))
    others = null_safe_join(studies, names, keys).where(F.col(study) != F.col("excluded"))
    rows = _pooled_rows(_pool(others, [*keys, "excluded"], est, se), [*keys, "excluded"], est)
    return rows.where(F.col("k") >= 2).select(
        *keys, "excluded", "pooled_estimate", "pooled_se",
        (F.col("pooled_estimate") - F.lit(Z975) * F.col("pooled_se")).alias("ci_low"),
        (F.col("pooled_estimate") + F.lit(Z975) * F.col("pooled_se")).alias("ci_high"),
        "tau2",
    )


def analysis_sets(
    studies: DataFrame, exploratory: Column, all_name: str = "all_studies",
    confirmatory: str = "excluding_exploratory",
) -> DataFrame:
    """Assign each study to the pooled analyses it belongs to."""
    sets = F.array_compact(F.array(F.lit(all_name), F.when(~exploratory, F.lit(confirmatory))))
    return studies.withColumn("analysis", F.explode(sets))


def bh_fdr(
    tests: DataFrame, keys: list[str], p: str = "p_value", tie: list[str] = [], alpha: float = 0.05
) -> DataFrame:
    """Benjamini-Hochberg ranks, critical values and q-values within each family ``keys``."""
    family = Window.partitionBy(*keys, "_known")
    order = family.orderBy(F.col(p), *tie)
    tail = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = tests.withColumn("_known", F.col(p).isNotNull())
    n = F.sum(F.col("_known").cast("int")).over(family)
    ranked = known.withColumn("rank", F.when(F.col("_known"), F.row_number().over(order)))
    ranked = ranked.withColumn("_n", n)
    raw = F.col(p) * F.col("_n") / F.col("rank")
    critical = F.col("rank") / F.col("_n") * F.lit(alpha)
    return ranked.select(
        *tests.columns, "rank",
        critical.alias("bh_critical_value"),
        F.when(
            F.col("_known"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(raw).over(tail)))
        ).alias("q_value"),
        F.coalesce(F.col(p) <= critical, F.lit(False)).alias("significant_bh"),
    )
