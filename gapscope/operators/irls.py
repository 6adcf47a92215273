"""Many logistic regressions at once, keyed by comparison and model.

A pass over the rows sums, for every (comparison, model), the gradient and the Gram matrix of the
current coefficients as ordinary grouped sums; the few numbers of each fit take a Newton step and
travel back as a small table that the next pass joins. All fits advance together, whatever their
number, and those that are done leave the pass. Models may differ in label, rows, weights, terms,
penalty and scaling, so the steps of a waterfall or the folds of a cross-validation are models of one
call: rows carry masks instead of being copied into filtered tables.

A fit ends with a status: ``ok``; ``separation``, when coefficients keep growing because the label is
split without error; ``singular``, when terms depend on each other; ``one_class``; ``no_rows``;
``nonfinite_predictor``, when a term is NaN or infinite in one of its rows; ``not_converged``. Only
``ok`` fits have estimates; of the others all are NULL. A row whose label or one of whose terms is
NULL (and is not filled) takes no part in a model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import Z975

#: Fits a call may hold at most, since their coefficients meet on the driver between passes.
MAX_FITS = 20_000
MAX_STEPS = 40
#: From this step on a fit whose coefficients still grow is separated (Newton's steps add about one log-odds each).
GROWING_STEPS = 18
TOLERANCE = 1e-9
#: A Gram matrix (scaled to a unit diagonal) of a larger condition number is singular.
WORST_CONDITION = 1e12


@dataclass(frozen=True)
class Model:
    """One regression: ``label`` on an intercept and ``terms``, minimising loss + penalties.

    The penalties are ``ridge / 2 * sum(b^2)`` and ``lasso * sum(|b|)`` without the intercept.
    ``standardise`` names the terms that are z-scored with the moments of the fit's own rows;
    ``fill`` replaces a NULL of a term.
    """

    name: str
    terms: tuple[str, ...]
    label: str
    where: Column | None = None
    weight: str | None = None
    ridge: float = 0.0
    lasso: float = 0.0
    standardise: tuple[str, ...] = ()
    fill: dict[str, float] = field(default_factory=dict)


@dataclass
class Fit:
    """State and result of one model in one comparison; arrays begin with the intercept."""

    key: tuple
    model: Model
    columns: list[str]
    n: int = 0
    events: float = 0.0
    status: str = "running"
    spread: np.ndarray = None  # population sd of each column over the fit's rows
    shift: np.ndarray = None
    scale: np.ndarray = None
    beta: np.ndarray = None
    before: np.ndarray | None = None
    value: float = -math.inf
    covariance: np.ndarray | None = None
    moved: float = math.inf
    steps: int = 0

    @property
    def active(self) -> np.ndarray:
        return np.array([0, *[1 + self.columns.index(t) for t in self.model.terms]])

    @property
    def ok(self) -> bool:
        return self.status == "ok"

    def estimate(self, term: str | None = None) -> float | None:
        """Coefficient of a term (of the intercept without one), on the scale it was fitted on."""
        return float(self.beta[0 if term is None else 1 + self.columns.index(term)]) if self.ok else None

    def error(self, term: str) -> float | None:
        """Wald standard error; None without one."""
        if not self.ok or self.covariance is None:
            return None
        v = self.covariance[1 + self.model.terms.index(term)][1 + self.model.terms.index(term)]
        return math.sqrt(v) if v > 0 else None

    def wald(self, term: str) -> tuple[float | None, float | None, float | None, float | None]:
        """Estimate, its 95 % limits and two-sided p."""
        b, se = self.estimate(term), self.error(term)
        if b is None or se is None:
            return b, None, None, None
        return b, b - Z975 * se, b + Z975 * se, math.erfc(abs(b / se) / math.sqrt(2.0))

    # --- steps ---

    def penalty(self, beta: np.ndarray) -> float:
        b = beta[self.active][1:]
        return 0.5 * self.model.ridge * float(b @ b) + self.model.lasso * float(np.abs(b).sum())

    def advance(self, gradient: np.ndarray, gram: np.ndarray, likelihood: float) -> None:
        """One Newton step from the sums at the present coefficients; ends the fit where it is done."""
        self.steps += 1
        at = self.active
        value = likelihood - self.penalty(self.beta)
        if not (math.isfinite(value) and np.isfinite(gram).all() and np.isfinite(gradient).all()):
            self.status = "nonfinite_predictor" if self.before is None else "not_converged"
            return
        if self.before is not None and value < self.value - 1e-9 * abs(self.value) - 1e-12:
            self.beta = self.before + 0.5 * (self.beta - self.before)  # the last step went too far
            if self.steps >= MAX_STEPS:
                self.status = "not_converged"
            return
        g, h = gradient[at], gram[np.ix_(at, at)]
        ridge = np.full(len(at), self.model.ridge)
        ridge[0] = 0.0
        g, h = g - ridge * self.beta[at], h + np.diag(ridge)
        size = np.sqrt(np.maximum(np.diag(h), 1e-300))
        even = h / np.outer(size, size)
        if np.diag(h).min() <= 0 or np.linalg.cond(even) > WORST_CONDITION:
            self.status = "separation" if self.growing else "singular"
            return
        if self.model.lasso:
            step = self._lasso_step(g, h, self.beta[at])
        else:
            step = np.linalg.solve(even, g / size) / size
        self.before, self.value = self.beta.copy(), value
        self.beta = self.beta.copy()
        self.beta[at] += step
        self.moved = float(np.abs(step).max() / (1.0 + np.abs(self.beta[at]).max()))
        if self.moved <= TOLERANCE:
            self.status = "ok"
            if not self.model.lasso and not self.model.ridge:
                self.covariance = np.linalg.inv(even) / np.outer(size, size)
        elif self.growing and self.steps >= GROWING_STEPS:
            self.status = "separation"
        elif self.steps >= MAX_STEPS:
            self.status = "not_converged"

    @property
    def growing(self) -> bool:
        """Whether coefficients still move when a finite maximum would long have been met."""
        return self.steps > 12 and self.moved > 1e-3

    def _lasso_step(self, g: np.ndarray, h: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Minimiser of the quadratic model with the absolute penalty, by coordinates."""
        new = beta.copy()
        for _ in range(1000):
            worst = 0.0
            for j in range(len(new)):
                slope = g[j] - h[j] @ (new - beta) + h[j, j] * new[j]
                target = slope / h[j, j] if j == 0 else math.copysign(max(abs(slope) - self.model.lasso, 0.0), slope) / h[j, j]
                worst = max(worst, abs(target - new[j]) * math.sqrt(h[j, j]))
                new[j] = target
            if worst < 1e-12:
                break
        return new - beta


class Fits:
    """The fits of a call, by comparison and model."""

    def __init__(self, keys: list[str], key_fields: list[T.StructField], fits: list[Fit]):
        self.keys, self.key_fields, self.fits = keys, key_fields, fits
        self.found = {(f.key, f.model.name): f for f in fits}
        self.comparisons = list(dict.fromkeys(f.key for f in fits))

    def get(self, key: tuple, name: str) -> Fit:
        return self.found[key, name]

    def scored(
        self, df: DataFrame, name: str, out: str, replaced: dict[str, Column] | None = None
    ) -> DataFrame:
        """``df`` with the model's probability (NULL without an ok fit for the row's comparison)."""
        fits = [f for f in self.fits if f.model.name == name]
        if not fits:
            return df.withColumn(out, F.lit(None).cast("double"))
        model, columns = fits[0].model, fits[0].columns
        rows = [(*f.key, f.beta.tolist(), f.shift.tolist(), f.scale.tolist()) for f in fits if f.ok]
        arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_beta", "_shift", "_scale")]
        renamed = [T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(self.key_fields)]
        small = F.broadcast(df.sparkSession.createDataFrame(rows, T.StructType([*renamed, *arrays])))
        if self.keys:
            match = F.lit(True)
            for i, k in enumerate(self.keys):
                match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            joined = df.join(small, match, "left")
        elif rows:
            values = {c: F.array(*[F.lit(v) for v in rows[0][i]]) for i, c in enumerate(("_beta", "_shift", "_scale"))}
            joined = df.withColumns(values)
        else:
            return df.withColumn(out, F.lit(None).cast("double"))
        link = F.col("_beta")[0]
        for t in model.terms:
            i = 1 + columns.index(t)
            x = (replaced or {}).get(t, F.col(t).cast("double"))
            if t in model.fill:
                x = F.coalesce(x, F.lit(float(model.fill[t])))
            link = link + F.col("_beta")[i] * ((x - F.col("_shift")[i]) / F.col("_scale")[i])
        names = [f"_k{i}" for i in range(len(self.keys))]
        return joined.withColumn(out, 1.0 / (1.0 + F.exp(-link))).drop("_beta", "_shift", "_scale", *names)


def _fan_out(df: DataFrame, keys: list[str], models: list[Model], columns: list[str]) -> DataFrame:
    """A row per usable (row, model): keys, _m, _y, _w and the filled terms _x1, _x2 ..."""
    usable = []
    for i, m in enumerate(models):
        ok = F.col(m.label).isNotNull()
        if m.where is not None:
            ok = ok & m.where
        if m.weight is not None:
            ok = ok & (F.col(m.weight) > 0)
        for t in m.terms:
            if t not in m.fill:
                ok = ok & F.col(t).isNotNull()
        usable.append(F.when(ok, F.lit(i)))
    pick = lambda values: values[0] if len(set(map(str, values))) == 1 else F.element_at(F.array(*values), F.col("_m") + 1)
    chosen = df.withColumn("_m", F.explode(F.array_compact(F.array(*usable))))
    terms = []
    for i, c in enumerate(columns, 1):
        x = F.col(c).cast("double")
        if any(c in m.fill for m in models):
            x = F.coalesce(x, pick([F.lit(float(m.fill.get(c, math.nan))) for m in models]))
        terms.append(x.alias(f"_x{i}"))
    return chosen.select(
        *keys, "_m", pick([F.col(m.label).cast("double") for m in models]).alias("_y"),
        pick([F.lit(1.0) if m.weight is None else F.col(m.weight).cast("double") for m in models]).alias("_w"), *terms,
    )


def _starts(rows: DataFrame, keys: list[str], models: list[Model], columns: list[str]) -> list[Fit]:
    """Counts and moments of every fit, from one grouped pass."""
    found = rows.groupBy(*keys, "_m").agg(
        F.count("*").alias("_n"), F.sum("_w").alias("_total"), F.sum(F.col("_y") * F.col("_w")).alias("_events"),
        *[F.avg(f"_x{i}").alias(f"_mean{i}") for i in range(1, len(columns) + 1)],
        *[F.stddev_pop(f"_x{i}").alias(f"_sd{i}") for i in range(1, len(columns) + 1)],
    )
    taken = found.limit(MAX_FITS + 1).collect()
    if len(taken) > MAX_FITS:
        raise ValueError(f"more than {MAX_FITS} fits in one call; split the comparisons")
    fits = []
    for r in taken:
        model = models[r["_m"]]
        fit = Fit(tuple(r[k] for k in keys), model, columns, r["_n"], r["_events"] or 0.0)
        size = len(columns) + 1
        fit.shift, fit.scale, fit.beta = np.zeros(size), np.ones(size), np.zeros(size)
        fit.spread = np.array([0.0, *[r[f"_sd{i}"] if r[f"_sd{i}"] is not None else math.nan for i in range(1, size)]])
        for i, c in enumerate(columns, 1):
            if c in model.standardise:
                fit.shift[i], fit.scale[i] = r[f"_mean{i}"] or 0.0, r[f"_sd{i}"] or 1.0
        moments = [r[f"_mean{1 + columns.index(t)}"] for t in model.terms]
        if not r["_total"] or fit.events <= 0 or fit.events >= r["_total"]:
            fit.status = "one_class"
        elif not all(m is not None and math.isfinite(m) for m in moments):
            fit.status = "nonfinite_predictor"
        else:
            share = fit.events / r["_total"]
            fit.beta[0] = math.log(share / (1.0 - share))
        fits.append(fit)
    return fits


def _sums(rows: DataFrame, keys: list[str], fits: list[Fit], models: list[Model], columns: list[str], fields) -> list:
    """Gradient, Gram matrix and log-likelihood of every given fit at its coefficients."""
    size = len(columns) + 1
    index = {id(m): i for i, m in enumerate(models)}
    state = []
    for f in fits:
        slope = np.zeros(size)
        slope[f.active] = 1.0 / f.scale[f.active]
        state.append((*f.key, index[id(f.model)], f.beta.tolist(), f.shift.tolist(), slope.tolist()))
    schema = T.StructType(
        [T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("_fit", T.IntegerType())]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_beta", "_shift", "_slope")]
    )
    small = F.broadcast(rows.sparkSession.createDataFrame(state, schema))
    match = F.col("_m") == F.col("_fit")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    z = ["_w", *[f"_z{i}" for i in range(1, size)]]
    scaled = rows.join(small, match).select(
        *keys, "_m", "_y", "_w", "_beta",
        *[F.when(F.col("_slope")[i] == 0, 0.0).otherwise((F.col(f"_x{i}") - F.col("_shift")[i]) * F.col("_slope")[i]).alias(z[i])
          for i in range(1, size)],
    )
    link = F.col("_beta")[0]
    for i in range(1, size):
        link = link + F.col("_beta")[i] * F.col(z[i])
    eta, mu = F.col("_eta"), F.col("_mu")
    ready = (
        scaled.withColumn("_eta", link).withColumn("_mu", 1.0 / (1.0 + F.exp(-eta)))
        .withColumns({"_r": F.col("_w") * (F.col("_y") - mu), "_h": F.col("_w") * mu * (1.0 - mu)})
    )
    one = lambda i: F.lit(1.0) if i == 0 else F.col(z[i])
    likelihood = F.col("_w") * (F.col("_y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
    return ready.groupBy(*keys, "_m").agg(
        F.sum(likelihood).alias("_ll"),
        *[F.sum(F.col("_r") * one(i)).alias(f"_g{i}") for i in range(size)],
        *[F.sum(F.col("_h") * one(i) * one(j)).alias(f"_h{i}_{j}") for i in range(size) for j in range(i, size)],
    ).collect()


def fit_all(df: DataFrame, keys: list[str], models: list[Model]) -> Fits:
    """Fit every model in every comparison (combination of ``keys``)."""
    columns = list(dict.fromkeys(t for m in models for t in m.terms))
    rows = _fan_out(df, keys, models, columns)
    fields = [rows.schema[k] for k in keys]
    fits = _starts(rows, keys, models, columns)
    by = {(f.key, f.model.name): f for f in fits}
    for key in dict.fromkeys(f.key for f in fits) if keys else [()]:
        for m in models:
            if (key, m.name) not in by:
                size = len(columns) + 1
                empty = Fit(key, m, columns, status="no_rows", shift=np.zeros(size), scale=np.ones(size), beta=np.zeros(size))
                fits.append(empty)
    size = len(columns) + 1
    while running := [f for f in fits if f.status == "running"]:
        found = {(tuple(r[k] for k in keys), r["_m"]): r for r in _sums(rows, keys, running, models, columns, fields)}
        index = {id(m): i for i, m in enumerate(models)}
        for f in running:
            r = found[f.key, index[id(f.model)]]
            gram = np.zeros((size, size))
            for i in range(size):
                for j in range(i, size):
                    gram[i, j] = gram[j, i] = r[f"_h{i}_{j}"]
            f.advance(np.array([r[f"_g{i}"] for i in range(size)]), gram, r["_ll"])
    return Fits(keys, fields, fits)
