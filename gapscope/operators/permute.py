"""Outcome permutation with refits: every shuffled model is fitted in the same passes.

Rows get a dense index once. A keyed permutation of the index range decides, per
replicate, which rows carry the positive labels, so a shuffle moves no data and
keeps the number of positives exactly. One Newton step for all replicates is one
pass over the rows; the state is replicates x features numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hash_text
from . import gaps as G
from .ranking import prefix_sums
from .resample import PERMUTED, SIDES, null_distribution

_U = np.uint64
#: Test rows whose scores under one replicate are ranked in one task.
RANGE_ROWS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser used as the round function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def permuted_index(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Bijection of 0..size-1: a balanced Feistel network, re-applied until in range."""
    half = max(1, (max(1, int(size - 1).bit_length()) + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = _mix(np.arange(1, 7, dtype=np.uint64) + _U((key * 0x9E3779B97F4A7C15) & (2**64 - 1)))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> _U(half), v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return (left << _U(half)) | right

    out = once(index.astype(np.uint64))
    while True:
        outside = out >= size
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def dense_index(df: DataFrame, row_id: str, seed: int, name: str = "_i") -> DataFrame:
    """Number the rows 0..n-1 by hash bucket and hash, without a global sort."""
    rows = df.withColumn("_h", hash_text([row_id], seed)).withColumn(
        "_b", F.substring("_h", 1, 3)
    ).withColumn("_k", F.substring("_h", 1, 0)).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(rows, ["_k"], "_b", "_h", ["_one"], descending=False)
    return ranked.select(*df.columns, (F.col("cum__one") - 1).alias(name))


def _solved(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The Newton move, or NaN where there is none."""
    try:
        return np.linalg.solve(matrix, vector)
    except np.linalg.LinAlgError:
        return np.full_like(vector, np.nan)


def replicate_auroc(rows: DataFrame, probabilities, replicates: np.ndarray, y: str) -> DataFrame:
    """Exact AUROC (ties count half) of every replicate's scores of the same rows.

    A replicate's scores are cut into ranges at quantiles of a sample; a row is one number in its
    range, negative for a row without the outcome, packed by batch. Ranges are sorted in tasks of their
    own and put together by their counts; the sample decides only how large the ranges are.
    """
    n = rows.persist(StorageLevel.MEMORY_AND_DISK).count()
    ranges = max(1, -(-n // RANGE_ROWS))
    look = rows.sample(min(1.0, 200.0 * ranges / max(n, 1)), seed=1).limit(1000 * ranges).toPandas() if ranges > 1 and len(replicates) else None
    inner = np.arange(1, ranges) / ranges
    cuts = np.zeros((0, len(replicates))) if look is None or not len(look) else np.quantile(probabilities(look), inner, axis=0, method="lower")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prob, positive = probabilities(pdf), (pdf[y] == 1).to_numpy()
            found = []
            for j, r in enumerate(replicates.tolist()):
                order = np.argsort(prob[:, j])
                value = prob[order, j]
                signed = np.where(positive[order], value, -value)
                edges = [0, *np.searchsorted(value, cuts[:, j], side="right").tolist(), len(value)]
                found += [(r, i, signed[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
            yield pd.DataFrame(found, columns=["replicate", "_range", "_v"])

    def rank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        signed = np.frombuffer(b"".join(pdf["_v"]))
        other = np.signbit(signed)  # a zero keeps its sign
        pos, neg = signed[~other], np.sort(-signed[other])
        below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
        won = (below.sum() + upto.sum()) / 2.0
        return pd.DataFrame({"replicate": [key[0]], "_range": [key[1]], "_pos": [len(pos)], "_neg": [len(neg)], "_u": [won]})

    parts = rows.mapInPandas(deal, "replicate int, _range int, _v binary").groupBy("replicate", "_range").applyInPandas(
        rank, "replicate int, _range int, _pos long, _neg long, _u double"
    )
    lower = Window.partitionBy("replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    crossed = parts.withColumn("_x", F.col("_pos").cast("double") * F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    return crossed.groupBy("replicate").agg(
        F.try_divide(F.sum("_u") + F.sum("_x"), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("auroc")
    )


def outcome_permutation(
    train: DataFrame, test: DataFrame, features: list[str], group: str, a, b,
    n_perm: int = 200, seed: int = 42, threshold: float = 0.5, y: str = "y_true",
    row_id: str = "row_id", steps: int = 25,
) -> DataFrame:
    """Null distribution of AUROC and five gaps when training outcomes are shuffled.

    Replicates whose fit has not converged after ``steps`` are counted, and their values are null.
    """
    spark = train.sparkSession
    rows = dense_index(train.select(row_id, y, *features), row_id, seed).select(
        "_i", *[F.col(c).cast("double").alias(c) for c in features]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    size, positives = train.agg(F.count("*"), F.sum(y)).first()
    p = len(features) + 1
    # Working scale only: the ridge term below is expressed in original units.
    scale = np.array(
        [1.0] + [float(v or 1.0) for v in train.agg(*[F.max(F.abs(F.col(c).cast("double"))) for c in features]).first()]
    )
    scale[scale == 0] = 1.0
    ridge = np.r_[0.0, 1.0 / scale[1:] ** 2]
    grad_size, hess = n_perm * p, n_perm * p * p
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def slots(values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"slot": np.arange(len(values), dtype=np.int32), "value": values})

    def summed(partial) -> np.ndarray:
        sums = rows.mapInPandas(partial, schema).groupBy("slot").agg(F.sum("value").alias("value"))
        return sums.toPandas().sort_values("slot")["value"].to_numpy()

    def design(pdf: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)]) / scale

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the features over each shuffle's positive rows: all that a step needs of the labels."""
        total = np.zeros((p, n_perm))
        for pdf in batches:
            x, index = design(pdf), pdf["_i"].to_numpy()
            for r in range(n_perm):
                total[:, r] += x[permuted_index(index, size, seed * 1_000_003 + r) < positives].sum(axis=0)
        yield slots(total.ravel())

    target = summed(labelled).reshape(p, n_perm) if size else np.zeros((p, n_perm))
    beta, converged = np.zeros((p, n_perm)), np.zeros(n_perm, dtype=bool)
    for _ in range(steps):
        current = beta.copy()

        def partial(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            g, h = np.zeros((p, n_perm)), np.zeros((p * p, n_perm))
            for pdf in batches:
                x = design(pdf)
                mu = 1.0 / (1.0 + np.exp(-np.clip(x @ current, -700, 700)))
                g += x.T @ mu
                outer = (x[:, :, None] * x[:, None, :]).reshape(len(pdf), p * p)
                h += outer.T @ (mu * (1.0 - mu))
            yield slots(np.concatenate([g.ravel(), h.ravel()]))

        got = summed(partial)
        g = target - got[:grad_size].reshape(p, n_perm) - ridge[:, None] * beta
        h = got[grad_size:].reshape(p, p, n_perm)
        move = np.column_stack(
            [_solved(h[:, :, r] + np.diag(ridge), g[:, r]) for r in range(n_perm)]
        )
        beta = beta + move
        converged = np.abs(move).max(axis=0) < 1e-8
        if converged.all():
            break
    kept = np.flatnonzero(converged).astype(np.int32)
    coef = (beta / scale[:, None])[:, kept]
    held = test.where(F.col(group).isin([a, b])).select(
        (F.col(group) == F.lit(a)).cast("int").alias("_a"), F.col(y).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]
    )
    for c in features:  # a row without a score takes no part
        held = held.where(F.col(c).isNotNull() & ~F.isnan(c))

    def probabilities(pdf: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ coef, -700, 700)))

    def confusion(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(SIDES), len(kept)), dtype=np.int64)
        for pdf in batches:
            hit = probabilities(pdf) >= threshold
            for i, name in enumerate(SIDES):
                own = (pdf["_a"] == (name[-1] == "a")).to_numpy() & (pdf["_y"] == (name[:2] in ("tp", "fn"))).to_numpy()
                called = hit[own].sum(axis=0)
                total[i] += called if name[:2] in ("tp", "fp") else own.sum() - called
        out = pd.DataFrame(total.T, columns=list(SIDES))
        out.insert(0, "replicate", kept)
        yield out

    counts = held.mapInPandas(confusion, "replicate int, " + ", ".join(f"{c} long" for c in SIDES))
    pairs = G.with_side_rates(counts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in SIDES]), PERMUTED)
    area = replicate_auroc(held, probabilities, kept, "_y").select("replicate", F.lit("auroc").alias("metric"), F.col("auroc").alias("value"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), G.gap(m).alias("value")) for m in PERMUTED]))
    gaps = pairs.select("replicate", cells.alias("_c")).select("replicate", "_c.*")
    missing = spark.createDataFrame(
        [(int(r), m, None) for r in np.flatnonzero(~converged) for m in ("auroc", *PERMUTED)],
        "replicate int, metric string, value double",
    )
    null = area.unionByName(gaps).unionByName(missing).withColumn("observed_gap", F.lit(None).cast("double"))
    return null_distribution(null, ["metric"], n_perm).withColumn("n_unconverged", F.lit(n_perm - len(kept)))
