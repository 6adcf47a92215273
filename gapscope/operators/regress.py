"""Regressions behind case-mix and error analyses.

Every function takes ``keys``: the steps, moderators or outcomes of all comparisons are fitted
together by :mod:`.irls`, one pass over the rows per Newton step for all of them. A fit without a
finite maximum gives its status and NULL estimates, never a number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import ArithmeticException, IllegalArgumentException, UnsupportedOperationException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import null_safe_join
from .irls import Model, fit_all

SMALLEST_GROUP = 5
SMALLEST_SAMPLE = 20
#: Failures of a fit itself (singular, no rows, overflow); a failed job is raised.
NUMERICAL = (IllegalArgumentException, ArithmeticException, UnsupportedOperationException, ArithmeticError, ValueError)


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd of each column; a constant column gets sd 1."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def with_zscores(df: DataFrame, columns: list[str], stats: dict | None = None) -> DataFrame:
    """Add ``z_<column>`` for every column, by default with the rows' own moments."""
    stats = moments(df, columns) if stats is None else stats
    return df.select(
        "*", *[((F.col(c) - stats[c][0]) / stats[c][1]).alias(f"z_{c}") for c in columns]
    )


@dataclass(frozen=True)
class Linear:
    """A fitted logistic model as plain numbers."""

    intercept: float
    coefficients: dict[str, float]

    def link(self, replaced: dict[str, Column] | None = None) -> Column:
        out = F.lit(self.intercept)
        for name, b in self.coefficients.items():
            x = (replaced or {}).get(name, F.col(name))
            out = out + F.lit(b) * x
        return out

    def probability(self, replaced: dict[str, Column] | None = None) -> Column:
        return 1.0 / (1.0 + F.exp(-self.link(replaced)))


def fit_logistic(
    df: DataFrame, features: list[str], label: str, c: float = 1.0, l1: float = 0.0,
    weight: str | None = None,
) -> Linear:
    """Logistic regression minimising c * total loss + penalty (intercept not penalised)."""
    total = df.agg((F.count("*") if weight is None else F.sum(weight)).alias("n")).first()["n"]
    if not total:
        raise ValueError("no rows to fit")
    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(
        df.withColumn("_label", F.col(label).cast("double"))
    )
    lr = LogisticRegression(
        featuresCol="_x", labelCol="_label", regParam=1.0 / (c * float(total)),
        elasticNetParam=l1, standardization=False, maxIter=500, tol=1e-9,
    )
    if weight is not None:
        lr = lr.setWeightCol(weight)
    model = lr.fit(assembled)
    return Linear(
        float(model.intercept), dict(zip(features, [float(b) for b in model.coefficients]))
    )


def _finite(v):
    return None if v is None or not math.isfinite(v) else float(v)


def _exp(v: float | None) -> float | None:
    try:
        return None if v is None else _finite(math.exp(v))
    except OverflowError:
        return None


def two_groups(df: DataFrame, group: str, a, b) -> DataFrame:
    """Rows of A and B with the indicator ``in_a``."""
    return df.where(F.col(group).isin([a, b])).withColumn(
        "in_a", (F.col(group) == F.lit(a)).cast("double")
    )


def error_rows(
    df: DataFrame, group: str, a, b, kind: str, y: str = "y_true", pred: str = "pred"
) -> DataFrame:
    """Positives with the indicator of a miss, or negatives with that of a false alarm."""
    if kind not in ("fn", "fp"):
        raise ValueError("kind must be 'fn' or 'fp'")
    kept = two_groups(df, group, a, b).where(F.col(y) == (1 if kind == "fn" else 0))
    return kept.withColumn("error", (F.col(pred) == (0 if kind == "fn" else 1)).cast("int"))


def _schema(df: DataFrame, keys: list[str], fields: str) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(fields).fields])


def _by_key(table: DataFrame, keys: list[str]) -> dict[tuple, object]:
    """A grouped summary on the driver, one row per comparison."""
    return {tuple(r[k] for k in keys): r for r in table.collect()}


def steps_of(blocks: dict[str, list[str]], available: list[str], first: str):
    """(step, cumulative columns), starting with no covariates."""
    out, seen = [(first, [])], []
    for name, columns in blocks.items():
        seen = seen + [c for c in columns if c in available and c not in seen]
        out.append((name, list(seen)))
    return out


def _explained(raw: float | None, value: float | None) -> float | None:
    return 100.0 * (raw - value) / raw if raw and value is not None else None


WATERFALL = (
    "step_no int, step string, n_features int, group_coef_logodds double, pct_of_raw_gap_explained double, "
    "status string"
)


def case_mix_waterfall(
    df: DataFrame, group: str, a, b, blocks: dict[str, list[str]], y: str = "y_true", keys: list[str] = [],
) -> DataFrame:
    """Group coefficient on the outcome as covariate blocks accumulate (ridge, unscaled)."""
    rows = two_groups(df, group, a, b).persist()
    steps = steps_of(blocks, df.columns, "raw (group only)")
    fits = fit_all(rows, keys, [Model(step, ("in_a", *cs), y, ridge=1.0) for step, cs in steps])
    out = []
    for key in fits.comparisons:
        raw = fits.get(key, steps[0][0]).estimate("in_a")
        for i, (step, cs) in enumerate(steps):
            fit = fits.get(key, step)
            coef = fit.estimate("in_a")
            out.append((*key, i, step, len(cs) + 1, coef, _explained(raw, coef), fit.status))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, _schema(df, keys, WATERFALL))


ERRORS = (
    "step_no int, step string, n_obs long, n_error long, error_rate_a double, error_rate_b double, log_or double, "
    "odds_ratio double, or_ci_low double, or_ci_high double, p_value double, n_features int, "
    "pct_of_raw_coef_explained double, status string"
)


def error_waterfall(
    df: DataFrame, group: str, a, b, blocks: dict[str, list[str]], kind: str,
    y: str = "y_true", pred: str = "pred", keys: list[str] = [],
) -> DataFrame:
    """Odds ratio of an error for A against B as standardised blocks accumulate.

    A step whose errors are split without exception (by the group or by a block) has the status
    ``separation`` and no estimate.
    """
    rows = error_rows(df, group, a, b, kind, y, pred).persist()
    in_a = F.col("in_a") == 1
    heads = _by_key(rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("error").alias("e"),
        F.avg(F.when(in_a, F.col("error"))).alias("ra"), F.avg(F.when(~in_a, F.col("error"))).alias("rb"),
    ), keys)
    steps = steps_of(blocks, df.columns, "raw (group only)")
    fits = fit_all(rows, keys, [Model(step, ("in_a", *cs), "error", standardise=tuple(cs)) for step, cs in steps])
    out = []
    for key, head in heads.items():
        raw = fits.get(key, steps[0][0]).estimate("in_a") if (key, steps[0][0]) in fits.found else None
        for i, (step, cs) in enumerate(steps):
            fit = fits.found.get((key, step))
            coef, low, high, p = fit.wald("in_a") if fit else (None,) * 4
            out.append((
                *key, i, step, head["n"], head["e"] or 0, head["ra"], head["rb"], coef, _exp(coef), _exp(low), _exp(high), p,
                len(cs) + 1, _explained(raw, coef), fit.status if fit else "no_rows",
            ))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, _schema(df, keys, ERRORS))


INTERACTION_VALUES = (
    "interaction_log_or", "interaction_or", "interaction_or_ci_low", "interaction_or_ci_high",
    "interaction_p", "group_or", "moderator_or",
)
#: What a fit without estimates says in ``warning`` (an attempt that ran) or ``error`` (one that could not).
FIT_WARNINGS = {
    "separation": "the errors are split without exception", "not_converged": "optimizer did not converge",
}
FIT_ERRORS = {
    "singular": "terms depend on each other", "one_class": "all rows or none are errors",
    "nonfinite_predictor": "a predictor is not finite", "no_rows": "no complete row",
}


def interaction_test(
    df: DataFrame, group: str, a, b, moderators: list[str], kind: str = "fn",
    adjusters: list[str] = [], y: str = "y_true", pred: str = "pred", keys: list[str] = [],
) -> DataFrame:
    """Does the group effect on errors vary with a moderator? One row per comparison and moderator.

    Too few rows (under 20, or under 5 errors or rows of A), fits that fail, do not converge or are
    not finite are kept as ``nonestimable`` rows with the reason in ``note``, ``warning``, ``error``.
    """
    used = list(dict.fromkeys([*moderators, *adjusters]))
    errors = error_rows(df, group, a, b, kind, y, pred)
    known = {m: F.col(m).isNotNull() for m in moderators}
    for m in moderators:
        errors = errors.withColumn(f"_z_{m}", F.col(m).cast("double"))
    # z-scores of the moderator over its own rows, so that the product is formed on that scale
    heads = errors.groupBy(*keys).agg(*[
        x for m in moderators for x in (
            F.count_if(known[m]).alias(f"n_{m}"), F.sum(F.when(known[m], F.col("error"))).alias(f"e_{m}"),
            F.sum(F.when(known[m], F.col("in_a"))).alias(f"a_{m}"), F.avg(f"_z_{m}").alias(f"m_{m}"),
            F.coalesce(F.expr(f"nullif(stddev_pop(`_z_{m}`), 0)"), F.lit(1.0)).alias(f"s_{m}"),
        )
    ])
    found = _by_key(heads, keys)
    moments_of = [c for m in moderators for c in (f"m_{m}", f"s_{m}")]
    if keys:
        joined = null_safe_join(errors, F.broadcast(heads.select(*keys, *moments_of)), keys)
    else:
        joined = errors.withColumns({c: F.lit(found[()][c]).cast("double") for c in moments_of})
    rows = joined.select(
        *keys, "error", "in_a", *used,
        *[((F.col(f"_z_{m}") - F.col(f"m_{m}")) / F.col(f"s_{m}")).alias(f"z_{m}") for m in moderators],
        *[(F.col("in_a") * (F.col(f"_z_{m}") - F.col(f"m_{m}")) / F.col(f"s_{m}")).alias(f"product_{m}") for m in moderators],
    ).persist()
    fits = fit_all(rows, keys, [
        Model(m, ("in_a", f"z_{m}", f"product_{m}", *adjusters), "error", standardise=tuple(adjusters)) for m in moderators
    ])
    out, empty = [], [None] * len(INTERACTION_VALUES)
    for key, head in found.items():
        for m in moderators:
            n, e, na = head[f"n_{m}"], head[f"e_{m}"] or 0, head[f"a_{m}"] or 0
            fit = fits.found.get((key, m))
            if n < SMALLEST_SAMPLE or e < SMALLEST_GROUP or na < SMALLEST_GROUP:
                out.append((*key, m, "nonestimable", *empty, n, e, "", "", "insufficient sample size"))
                continue
            status = fit.status if fit else "no_rows"
            if status != "ok":
                warning, error = FIT_WARNINGS.get(status, ""), FIT_ERRORS.get(status, "")
                note = "fit failed" if error else "fit emitted warning" if status == "separation" else warning
                out.append((*key, m, "nonestimable", *empty, n, e, warning, error, note))
                continue
            term, low, high, p = fit.wald(f"product_{m}")
            values = [
                _finite(term), _exp(term), _exp(low), _exp(high), _finite(p), _exp(fit.estimate("in_a")),
                _exp(fit.estimate(f"z_{m}")),
            ]
            if any(v is None for v in values):
                out.append((*key, m, "nonestimable", *empty, n, e, "", "", "inferential values were nonfinite"))
            else:
                out.append((*key, m, "estimable", *values, n, e, "", "", ""))
    rows.unpersist()
    fields = ", ".join(["moderator string", "status string", *[f"{v} double" for v in INTERACTION_VALUES]])
    return df.sparkSession.createDataFrame(
        out, _schema(df, keys, f"{fields}, n_obs long, n_error long, warning string, error string, note string")
    )


STANDARDISED = (
    "error_type string, raw_gap double, g_computation_gap double, ipw_gap double, attenuation_pct double, "
    "n_a long, n_b long, note string"
)


def standardised_error_gap(
    df: DataFrame, group: str, a, b, covariates: list[str], kind: str = "fn",
    y: str = "y_true", pred: str = "pred", keys: list[str] = [],
) -> DataFrame:
    """Error-rate gap with covariates balanced by g-computation and by propensity weights.

    A comparison with fewer than five rows in a group, or a model without a fit, has NULL gaps.
    """
    rows = error_rows(df, group, a, b, kind, y, pred).persist()
    in_a = F.col("in_a") == 1
    heads = _by_key(rows.groupBy(*keys).agg(
        F.count_if(in_a).alias("n_a"), F.count_if(~in_a).alias("n_b"),
        (F.avg(F.when(in_a, F.col("error"))) - F.avg(F.when(~in_a, F.col("error")))).alias("raw"),
    ), keys)
    z = tuple(covariates)
    fits = fit_all(rows, keys, [
        Model("outcome", ("in_a", *z), "error", ridge=1.0, standardise=z), Model("propensity", z, "in_a", ridge=1.0, standardise=z),
    ])
    scored = fits.scored(rows, "outcome", "_as_a", {"in_a": F.lit(1.0)})
    scored = fits.scored(scored, "outcome", "_as_b", {"in_a": F.lit(0.0)})
    scored = fits.scored(scored, "propensity", "_own").withColumn("_p", F.least(F.greatest("_own", F.lit(0.01)), F.lit(0.99)))
    # the stabilising shares are common factors of a group's weights and cancel in its mean
    weighted = scored.withColumn("_w", F.when(F.col("_own").isNotNull(), F.when(in_a, 1.0 / F.col("_p")).otherwise(1.0 / (1.0 - F.col("_p")))))
    mean = lambda cond: F.sum(F.when(cond, F.col("_w") * F.col("error"))) / F.sum(F.when(cond, F.col("_w")))
    gaps = _by_key(weighted.groupBy(*keys).agg(
        (F.avg("_as_a") - F.avg("_as_b")).alias("g"), (mean(in_a) - mean(~in_a)).alias("ipw")
    ), keys)
    out = []
    for key, head in heads.items():
        if head["n_a"] < SMALLEST_GROUP or head["n_b"] < SMALLEST_GROUP:
            out.append((*key, kind, None, None, None, None, head["n_a"], head["n_b"], "insufficient sample size in one subgroup"))
            continue
        g, ipw = gaps[key]["g"], gaps[key]["ipw"]
        out.append((*key, kind, head["raw"], g, ipw, _explained(head["raw"], g), head["n_a"], head["n_b"], ""))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, _schema(df, keys, STANDARDISED))
