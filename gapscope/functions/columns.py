"""Column expressions shared by the operators.

Undefined ratios are NULL, never NaN, so that averages and percentiles skip
them without special treatment.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the metric definitions.
LOGIT_EPS = 1e-6
COUNTS = ("tp", "fp", "tn", "fn")
RATES = (
    "prevalence", "predicted_positive_rate", "sensitivity", "specificity",
    "fpr", "fnr", "ppv", "npv", "f1",
)
PREVALENCE_SENSITIVE = ("ppv", "npv", "predicted_positive_rate")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def predicted(prob: Column | str, threshold: Column | float) -> Column:
    """1 when the probability reaches the threshold (a tie is positive)."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (as_col(prob) >= t).cast("int")


def threshold_rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Every rate that follows from the four confusion counts."""
    n_pos, n_neg = tp + fn, tn + fp
    n = n_pos + n_neg
    sens, spec = ratio(tp, n_pos), ratio(tn, n_neg)
    ppv, npv = ratio(tp, tp + fp), ratio(tn, tn + fn)
    return {
        "n": n.cast("bigint"),
        "n_pos": n_pos.cast("bigint"),
        "n_neg": n_neg.cast("bigint"),
        "prevalence": ratio(n_pos, n),
        "predicted_positive_rate": ratio(tp + fp, n),
        "sensitivity": sens,
        "specificity": spec,
        "fpr": F.lit(1.0) - spec,
        "fnr": F.lit(1.0) - sens,
        "ppv": ppv,
        "npv": npv,
        "f1": F.when(ppv + sens > 0, F.lit(2.0) * ppv * sens / (ppv + sens)),
    }


def at_prevalence(sens: Column, spec: Column, prev: Column) -> dict[str, Column]:
    """PPV, NPV and predicted-positive rate by Bayes' rule at a given prevalence."""
    hit, false_alarm = sens * prev, (1.0 - spec) * (1.0 - prev)
    rest, miss = spec * (1.0 - prev), (1.0 - sens) * prev
    return {
        "ppv": F.when(hit + false_alarm > 0, F.try_divide(hit, hit + false_alarm)),
        "npv": F.when(rest + miss > 0, F.try_divide(rest, rest + miss)),
        "predicted_positive_rate": hit + false_alarm,
    }


def attenuation(raw: Column, adjusted: Column) -> Column:
    """Signed per cent of the raw gap that disappears; above 100 the sign flips."""
    return F.try_divide(100.0 * (raw - adjusted), raw)


def clipped_logit(p: Column | str) -> Column:
    c = F.least(F.greatest(as_col(p), F.lit(LOGIT_EPS)), F.lit(1.0 - LOGIT_EPS))
    return F.ln(c / (1.0 - c))


def is_clipped(p: Column | str) -> Column:
    p = as_col(p)
    return (p <= LOGIT_EPS) | (p >= 1.0 - LOGIT_EPS)


def score_lattice(p: Column | str, per_unit: int = 4096) -> Column:
    """Monotone integer bucket of a probability on the log-odds scale.

    Scores spread out on this scale, so even one comparison with a very large
    number of distinct scores is split over many buckets. The value depends on
    the score alone, hence every attempt of a task computes the same bucket.
    """
    eps = 1e-12
    c = F.least(F.greatest(as_col(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.floor(F.ln(c / (1.0 - c)) * F.lit(float(per_unit))).cast("int")


def value_lattice(x: Column | str, per_unit: int = 4096) -> Column:
    """Monotone integer bucket of any finite number (signed logarithmic steps)."""
    x = as_col(x)
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1024.0) * float(per_unit)).cast("bigint")


def linspace(start: float, stop: float, num: int) -> list[float]:
    return [float(v) for v in np.linspace(start, stop, num)]


def double_array(values: list[float]) -> Column:
    """Constant array of doubles, parsed once instead of built literal by literal."""
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def grid_index(p: Column | str, grid: list[float]) -> Column:
    """Number of points of an evenly spaced grid that are <= p.

    The arithmetic guess can be off by one next to a grid point, so it is
    corrected against the stored doubles: constant work whatever the grid size.
    """
    p, size = as_col(p), len(grid)
    step = (grid[-1] - grid[0]) / (size - 1)
    points = double_array(grid)
    guess = F.floor((p - F.lit(grid[0])) / F.lit(step)).cast("int") + 1
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(size))
    too_high = (guess >= 1) & (F.get(points, guess - 1) > p)
    too_low = (guess < size) & (F.get(points, guess) <= p)
    return F.when(too_high, guess - 1).when(too_low, guess + 1).otherwise(guess)


def equal_width_bin(p: Column | str, bins: int = 10) -> Column:
    """Bin 0..bins-1 of [0, 1]; bins are closed on the left, the last on both sides."""
    idx = grid_index(p, linspace(0.0, 1.0, bins + 1)) - 1
    return F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1))


def hash_text(ids: list[str], seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly, identically in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def hash_uniform(ids: list[str], seed: int) -> Column:
    """Uniform number in [0, 1) from the digest's first 52 bits."""
    digits = F.conv(F.substring(hash_text(ids, seed), 1, 13), 16, 10).cast("double")
    return digits / F.lit(float(2**52))


def slug(c: Column | str) -> Column:
    """Lower case, runs of other characters become one underscore, ends trimmed."""
    return F.btrim(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def excludes_zero(low: Column, high: Column) -> Column:
    return F.when((low > 0) | (high < 0), F.lit("significant")).otherwise(F.lit("not_significant"))


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)
