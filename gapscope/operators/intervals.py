"""Closed-form intervals and interval-based decisions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.tails import Z95, Z975
from .metrics import metric_denominators


def wilson_bounds(num: Column, den: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; NULL without trials."""
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    n, p = den.cast("double"), ratio(num, den)
    scale = 1.0 + F.try_divide(F.lit(z * z), n)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z), 2.0 * n), scale)
    spread = F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z * z), 4.0 * n * n)
    radius = F.try_divide(F.lit(z) * F.sqrt(spread), scale)
    known = den > 0
    return (
        F.when(known, F.greatest(F.lit(0.0), centre - radius)),
        F.when(known, F.least(F.lit(1.0), centre + radius)),
    )


def wilson_ci(counts: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Five reportable rates per group with Wilson limits."""
    long = metric_denominators(counts, keys)
    low, high = wilson_bounds(F.col("numerator"), F.col("denominator"), level)
    return long.select(
        *keys, "metric", ratio(F.col("numerator"), F.col("denominator")).alias("point"),
        low.alias("ci_low"), high.alias("ci_high"), F.lit("wilson").alias("method"),
        "numerator", "denominator",
    )


def ci_to_se(low: Column, high: Column) -> Column:
    """Standard error implied by a symmetric 95 % interval."""
    return (high - low) / F.lit(2 * Z975)


def difference_interval(
    pa: Column, na: Column, pb: Column, nb: Column, z: float = Z975
) -> tuple[Column, Column]:
    """Normal-approximation limits of a difference of two proportions."""
    se = F.sqrt(F.try_divide(pa * (1.0 - pa), na) + F.try_divide(pb * (1.0 - pb), nb))
    gap = pa - pb
    return gap - F.lit(z) * se, gap + F.lit(z) * se


def equivalence(
    df: DataFrame, estimate: str, low: str, high: str, margin: float = 0.02
) -> DataFrame:
    """Two one-sided tests: the 90 % interval must lie inside plus or minus the margin."""
    e, lo, hi = F.col(estimate), F.col(low), F.col(high)
    se = ci_to_se(lo, hi)
    t_low, t_high = e - F.lit(Z95) * se, e + F.lit(Z95) * se
    inside = (t_low > -margin) & (t_high < margin)
    text = (
        F.when(se.isNull(), F.lit("insufficient information (no SE)"))
        .when(inside, F.lit(f"statistically equivalent to zero within +/-{margin}"))
        .when(
            (F.abs(e) <= 1e-12) & (hi - lo > 2 * margin),
            F.lit("non-significant but underpowered -- not equivalence"),
        )
        .otherwise(F.lit(f"not equivalent to zero within +/-{margin}"))
    )
    return df.select(
        "*", se.alias("se"), t_low.alias("tost_ci_low"), t_high.alias("tost_ci_high"),
        F.lit(float(margin)).alias("margin"),
        F.coalesce(inside, F.lit(False)).alias("equivalent"), text.alias("interpretation"),
    )


def percentile_interval(
    replicates: DataFrame, keys: list[str], value: str, n_boot: int, level: float = 0.95
) -> DataFrame:
    """Percentile limits with the number of usable and failed replicates.

    The number of replicates per group is the fixed ``n_boot``, so the exact
    percentile state is bounded. Without replicates the limits are NULL.
    """
    alpha = (1.0 - level) / 2.0
    return replicates.groupBy(*keys).agg(
        F.percentile(value, F.lit(alpha)).alias("ci_low"),
        F.percentile(value, F.lit(1.0 - alpha)).alias("ci_high"),
        F.count(value).alias("n_valid_replicates"),
        (F.lit(n_boot) - F.count(value)).cast("bigint").alias("n_failed_replicates"),
    )
