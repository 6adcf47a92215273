"""Tail probabilities that Spark SQL lacks, applied to result rows only.

These are scalar special functions evaluated on a handful of rows per
comparison, wrapped as Arrow-batched UDFs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z975 = 1.959963984540054
Z95 = 1.6448536269514722


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _chi2_sf(x: float, df: int) -> float:
    """Survival function for whole degrees of freedom by the finite series."""
    if df <= 0 or x is None:
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for j in range(1, df // 2):
            term *= half / j
            total += term
        return math.exp(-half) * total
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
    for j in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (j + 0.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


def _t_cdf_upper_half(t: float, df: int) -> float:
    """P(T <= t) for t >= 0 and whole degrees of freedom, by the angle series."""
    theta = math.atan2(t, math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2 == 1:
        total, term = 0.0, c
        for j in range((df - 1) // 2):
            total += term
            term *= c * c * (2 * j + 2) / (2 * j + 3)
        return 0.5 + (theta + s * total) / math.pi
    total, term = 0.0, 1.0
    for j in range(df // 2):
        total += term
        term *= c * c * (2 * j + 1) / (2 * j + 2)
    return 0.5 + 0.5 * s * total


def _t_quantile(p: float, df: int) -> float:
    if df <= 0:
        return math.nan
    low, high = 0.0, 2.0
    while _t_cdf_upper_half(high, df) < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if _t_cdf_upper_half(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def _clean(value: float):
    return None if value is None or math.isnan(value) else value


@F.pandas_udf(T.DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda v: None if pd.isna(v) else _normal_sf(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X > x) for a chi-square with whole degrees of freedom."""
    return pd.Series(
        [None if pd.isna(a) or b <= 0 else _chi2_sf(a, int(b)) for a, b in zip(x, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    """The 0.975 quantile of Student's t."""
    known = {int(k): _t_quantile(0.975, int(k)) for k in df.dropna().unique() if k > 0}
    return df.map(lambda k: None if pd.isna(k) else known.get(int(k))).astype("float64")


def kolmogorov_sf(z):
    """Limit law of the two-sample Kolmogorov-Smirnov statistic, as a column."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(z < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series))
    )
