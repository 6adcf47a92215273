"""Bootstrap and permutation replicates as grouped Spark jobs.

Drawing n rows with replacement matters only through how often each distinct
kind of row (or each cluster) is drawn, so replicates are multinomial counts.
Large multinomials are split in two exact levels: first how many draws fall
into each bucket of kinds, then the draws inside a bucket, so no task ever
holds more than one bucket. Generators are seeded by (seed, comparison,
bucket): retries and other partitionings repeat the same numbers.
Replicate 0 is always the observed data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    COUNTS,
    LOGIT_EPS,
    PREVALENCE_SENSITIVE,
    clipped_logit,
    ratio,
)
from ..session import ensure_checkpoint_dir, null_safe_join, sized_broadcast
from . import gaps as G
from .intervals import percentile_interval
from .irls import Model, fit_all
from .ranking import in_ranges, prefix_sums

SIDES = tuple(f"{c}_{s}" for s in "ab" for c in COUNTS)
BUCKET_MEMBERS = 2048
#: Parts of a node of the split tree.
FAN_OUT = 256
#: Distinct scores ranked in one task, and cells of clusters weighted in one task.
RANKED, WEIGHTED = 50_000, 50_000
#: Distinct cells whose weight vectors a task may hold together, and tasks whose vectors meet in one.
HELD, MERGED = 8192, 8
MAX_BROADCAST_FITS = 64
RATE_GAPS = (
    "sensitivity", "specificity", "fpr", "fnr", "ppv", "npv", "predicted_positive_rate",
    "prevalence",
)


def _rng(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng([seed, *[zlib.crc32(repr(p).encode()) for p in parts]])


def _key_schema(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


# --- replicates of confusion counts -------------------------------------------------


def row_count_replicates(
    pairs: DataFrame, keys: list[str], n_boot: int, seed: int = 42, joint: bool = False
) -> DataFrame:
    """Row bootstrap of the eight counts, straight from the eight counts.

    Each group keeps its size; with ``joint`` the rows of both groups are drawn
    from one urn. Cost does not depend on the number of rows.
    """
    schema = T.StructType(
        [*_key_schema(pairs, keys), T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in SIDES]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                rng = _rng(seed, key)
                counts = np.array([getattr(row, c) for c in SIDES], dtype=np.int64)
                blocks = [slice(0, 8)] if joint else [slice(0, 4), slice(4, 8)]
                drawn = np.zeros((n_boot, 8), dtype=np.int64)
                for b in blocks:
                    total = counts[b].sum()
                    if total:
                        drawn[:, b] = rng.multinomial(total, counts[b] / total, size=n_boot)
                out = pd.DataFrame(np.vstack([counts, drawn]), columns=list(SIDES))
                out.insert(0, "replicate", np.arange(n_boot + 1, dtype=np.int32))
                for i, k in enumerate(keys):
                    out.insert(i, k, key[i])
                yield out

    return pairs.select(*keys, *SIDES).mapInPandas(draw, schema)


def _bucket_draws(
    masses: DataFrame, keys: list[str], bucket: str, mass: str, n_boot: int, seed: int
) -> DataFrame:
    """How many of the draws of each replicate fall into each bucket.

    The draws run down a split tree: the root deals them to at most ``FAN_OUT`` ranges of buckets by
    their masses, and every range to its own parts, down to single buckets. A task holds one node's
    parts, so any number of buckets may take part; the law of the counts is the multinomial's.
    """
    kind = masses.schema[bucket].dataType
    schema = T.StructType(
        [*_key_schema(masses, keys), T.StructField("_node", T.LongType()), T.StructField("_mass", T.LongType())]
        + [T.StructField("_draws", T.ArrayType(T.LongType()))]
    )
    levels = [masses.select(*keys, F.col(bucket).cast("long").alias("_node"), F.col(mass).cast("long").alias("_mass"))]
    last = levels[0].agg(F.max("_node")).first()[0] or 0
    while last >= FAN_OUT:
        last //= FAN_OUT
        levels.append(levels[-1].groupBy(*keys, _parent()).agg(F.sum("_mass").alias("_mass")))

    def deal(pdf: pd.DataFrame, rng: np.random.Generator, draws) -> pd.DataFrame:
        pdf = pdf.sort_values("_node")
        sizes = pdf["_mass"].to_numpy(dtype=np.int64)
        total = sizes.sum()
        drawn = rng.multinomial(total if draws is None else draws, sizes / total, size=n_boot if draws is None else None)
        out = pdf[[*keys, "_node", "_mass"]].copy()
        out["_draws"] = list(drawn.T)
        return out

    def root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return deal(pdf, _rng(seed, "buckets", key), None)

    def node(level: int):
        def split(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            draws = np.asarray(above["_draws"].iloc[0], dtype=np.int64)
            return deal(pdf, _rng(seed, "buckets", level, key), draws)

        return split

    drawn = levels[-1].groupBy(*keys).applyInPandas(root, schema)
    for level in range(len(levels) - 2, -1, -1):
        parts = levels[level].withColumn("_up", _parent())
        drawn = (
            parts.groupBy(*keys, "_up").cogroup(drawn.withColumnRenamed("_node", "_up").groupBy(*keys, "_up"))
            .applyInPandas(node(level), schema)
        )
    return drawn.withColumn(bucket, F.col("_node").cast(kind)).select(*keys, bucket, "_mass", "_draws")


def _parent() -> Column:
    """Node above a node of the split tree."""
    return F.floor(F.col("_node") / F.lit(FAN_OUT)).cast("long").alias("_node")


def _cluster_bucket(clusters: DataFrame, keys: list[str], cluster: str) -> Column:
    """Hash bucket of a cluster, small enough that one task can hold a bucket's weight matrix."""
    largest = clusters.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    buckets = max(1, -(-int(largest) // BUCKET_MEMBERS))
    return F.pmod(F.xxhash64(F.col(cluster).cast("string")), F.lit(buckets)).cast("int")


def _cluster_draws(
    clusters: DataFrame, keys: list[str], cluster: str, n_boot: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Clusters (one row each) with their bucket, and the draws per bucket."""
    marked = clusters.withColumn("_cb", _cluster_bucket(clusters, keys, cluster))
    masses = marked.groupBy(*keys, "_cb").agg(F.count("*").alias("_m"))
    return marked, _bucket_draws(masses, keys, "_cb", "_m", n_boot, seed)


def _weights(draws: pd.DataFrame, size: int, key: tuple, seed: int) -> np.ndarray:
    """Multiplicities, replicates x clusters, for the clusters of one bucket."""
    n = np.asarray(draws["_draws"].iloc[0], dtype=np.int64)
    picked = _rng(seed, "clusters", key).integers(0, size, int(n.sum()))
    row = np.repeat(np.arange(len(n)), n)
    return np.bincount(row * size + picked, minlength=len(n) * size).reshape(len(n), size)


def cluster_count_replicates(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str, n_boot: int,
    seed: int = 42, y: str = "y_true", pred: Column | str = "pred",
) -> DataFrame:
    """Cluster bootstrap of the eight counts.

    A cluster is drawn once per replicate and its multiplicity applies to all
    its rows in both groups.
    """
    per_cluster = G.pair_counts(df, [*keys, cluster], group, a, b, y, pred).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    marked, draws = _cluster_draws(per_cluster, keys, cluster, n_boot, seed)
    schema = T.StructType(
        [*_key_schema(df, keys), T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in SIDES]
    )

    def draw(key: tuple, pdf: pd.DataFrame, drawn_to: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        counts = pdf[list(SIDES)].to_numpy(dtype=np.int64)
        drawn = _weights(drawn_to, len(pdf), key, seed) @ counts
        out = pd.DataFrame(np.vstack([counts.sum(axis=0), drawn]), columns=list(SIDES))
        out.insert(0, "replicate", np.arange(n_boot + 1, dtype=np.int32))
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    parts = (
        marked.groupBy(*keys, "_cb").cogroup(draws.groupBy(*keys, "_cb")).applyInPandas(draw, schema)
    )
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in SIDES])


def kind_count_replicates(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str, n_boot: int,
    seed: int = 42, y: str = "y_true", pred: Column | str = "pred",
) -> DataFrame:
    """Cluster bootstrap of the eight counts, drawn by kind of cluster.

    Clusters with the same eight counts are alike to a replicate, so their multiplicities together
    are one multinomial draw over the distinct counts: the law of :func:`cluster_count_replicates`,
    with work that grows with the kinds of clusters and not with their number.
    """
    per_cluster = G.pair_counts(df, [*keys, cluster], group, a, b, y, pred)
    kinds = per_cluster.groupBy(*keys, *SIDES).agg(F.count("*").alias("_m")).persist(StorageLevel.MEMORY_AND_DISK)
    largest = kinds.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    buckets = max(1, -(-int(largest) // BUCKET_MEMBERS))
    marked = kinds.withColumn("_cb", F.pmod(F.xxhash64(*SIDES), F.lit(buckets)).cast("int"))
    masses = marked.groupBy(*keys, "_cb").agg(F.sum("_m").alias("_mass"))
    draws = _bucket_draws(masses, keys, "_cb", "_mass", n_boot, seed)
    schema = T.StructType(
        [*_key_schema(df, keys), T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in SIDES]
    )

    def draw(key: tuple, pdf: pd.DataFrame, drawn_to: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(SIDES))
        counts, members = pdf[list(SIDES)].to_numpy(dtype=np.int64), pdf["_m"].to_numpy(dtype=np.int64)
        n = np.asarray(drawn_to["_draws"].iloc[0], dtype=np.int64)
        drawn = _rng(seed, "kinds", key).multinomial(n, members / members.sum()) @ counts
        out = pd.DataFrame(np.vstack([members @ counts, drawn]), columns=list(SIDES))
        out.insert(0, "replicate", np.arange(n_boot + 1, dtype=np.int32))
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    parts = marked.groupBy(*keys, "_cb").cogroup(draws.groupBy(*keys, "_cb")).applyInPandas(draw, schema)
    return parts.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in SIDES])


def count_statistics(reps: DataFrame, keys: list[str], target: float | None = None) -> DataFrame:
    """Rates of both groups, their gaps and the prevalence-adjusted gaps per replicate."""
    names = tuple(dict.fromkeys((*RATE_GAPS, "n", "n_pos")))
    wide = G.with_adjusted(
        G.with_side_rates(reps, names), None if target is None else F.lit(float(target))
    )
    cols = []
    for m in RATE_GAPS:
        cols += [
            F.col(f"{m}_a").alias(f"subgroup_a__{m}"), F.col(f"{m}_b").alias(f"subgroup_b__{m}"),
            G.gap(m).alias(f"gap__{m}"),
        ]
    for m in PREVALENCE_SENSITIVE:
        cols.append((F.col(f"{m}_adj_a") - F.col(f"{m}_adj_b")).alias(f"adjusted_gap__{m}"))
    extra = [c for c in reps.columns if c not in (*keys, "replicate", *SIDES)]
    return wide.select(*keys, "replicate", *cols, *extra)


def summarise(stats: DataFrame, keys: list[str], n_boot: int, level: float = 0.95) -> DataFrame:
    """Long table (block, metric, point, limits, valid and failed replicates).

    Statistic columns are named ``block__metric``.
    """
    names = [c for c in stats.columns if "__" in c]
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n.split("__")[0]).alias("block"), F.lit(n.split("__")[1]).alias("metric"),
                    F.col(n).cast("double").alias("value"),
                )
                for n in names
            ]
        )
    )
    long = stats.select(*keys, "replicate", cells.alias("_c")).select(*keys, "replicate", "_c.*")
    value = F.when(F.col("replicate") > 0, F.col("value"))
    marked = long.withColumn("_v", F.when(F.isnan(value), None).otherwise(value))
    wide = [*keys, "block", "metric"]
    limits = percentile_interval(marked, wide, "_v", n_boot, level)
    points = long.where("replicate = 0").select(*wide, F.col("value").alias("point"))
    return null_safe_join(points, limits, wide)


def bootstrap_gap(
    df: DataFrame, keys: list[str], group: str, a, b, metric: str, n_boot: int = 1000,
    seed: int = 42, adjust: bool = False, target: float | None = None, y: str = "y_true",
    pred: str = "pred",
) -> DataFrame:
    """Row-bootstrap interval of one gap, raw or prevalence-adjusted."""
    pairs = G.pair_counts(df, keys, group, a, b, y, pred)
    stats = count_statistics(row_count_replicates(pairs, keys, n_boot, seed), keys, target)
    name = f"{'adjusted_gap' if adjust else 'gap'}__{metric}"
    return summarise(stats.select(*keys, "replicate", name), keys, n_boot)


def cluster_vs_naive(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str, n_boot: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """Cluster and row bootstrap limits of five gaps side by side."""
    metrics = ("sensitivity", "fnr", "ppv", "npv", "predicted_positive_rate")
    kept = df.where(F.col(group).isin([a, b]))
    clustered = kind_count_replicates(kept, keys, group, a, b, cluster, n_boot, seed)
    pairs = G.pair_counts(kept, keys, group, a, b)
    naive = row_count_replicates(pairs, keys, n_boot, seed, joint=True)
    names = [f"gap__{m}" for m in metrics]
    one = summarise(count_statistics(clustered, keys).select(*keys, "replicate", *names), keys, n_boot)
    two = summarise(count_statistics(naive, keys).select(*keys, "replicate", *names), keys, n_boot)
    sizes = kept.groupBy(*keys, cluster).agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.sum("_n").cast("bigint").alias("n_rows")
    )
    both = null_safe_join(
        one.select(
            *keys, "metric", "point", F.col("ci_low").alias("cluster_ci_low"),
            F.col("ci_high").alias("cluster_ci_high"),
        ),
        two.select(
            *keys, "metric", F.col("ci_low").alias("naive_ci_low"),
            F.col("ci_high").alias("naive_ci_high"),
        ),
        [*keys, "metric"],
    )
    cw = F.col("cluster_ci_high") - F.col("cluster_ci_low")
    nw = F.col("naive_ci_high") - F.col("naive_ci_low")
    out = both.select(
        "*", cw.alias("cluster_ci_width"), nw.alias("naive_ci_width"),
        F.try_divide(cw, nw).alias("ci_width_ratio_cluster_over_naive"),
    )
    return null_safe_join(out, sizes, keys)


def ipw_interval(
    df: DataFrame, keys: list[str], group: str, a, b, n_boot: int = 500, seed: int = 42
) -> DataFrame:
    """IPW gaps with row-bootstrap limits; weights use the full-sample prevalence throughout."""
    pairs = G.pair_counts(df, keys, group, a, b)
    base = G.with_adjusted(G.with_side_rates(pairs, G.CORE)).select(
        *keys, "target_prevalence", "prevalence_a", "prevalence_b"
    )
    reps = null_safe_join(
        row_count_replicates(pairs, keys, n_boot, seed), sized_broadcast(base), keys
    )
    t, gaps = F.col("target_prevalence"), {}
    for s in "ab":
        p = F.col(f"prevalence_{s}")
        w1 = F.when(p > 0, F.try_divide(t, p)).otherwise(1.0)
        w0 = F.when(p < 1, F.try_divide(1.0 - t, 1.0 - p)).otherwise(1.0)
        tp, fn = F.col(f"tp_{s}") * w1, F.col(f"fn_{s}") * w1
        fp, tn = F.col(f"fp_{s}") * w0, F.col(f"tn_{s}") * w0
        gaps[s] = {
            "ppv": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn),
            "predicted_positive_rate": F.try_divide(tp + fp, tp + fp + tn + fn),
        }
    stats = reps.select(
        *keys, "replicate",
        *[(gaps["a"][m] - gaps["b"][m]).alias(f"ipw_adj_gap__{m}") for m in PREVALENCE_SENSITIVE],
    )
    limits = summarise(stats, keys, n_boot)
    bayes = G.ipw_prevalence(pairs, keys).select(*keys, "metric", "bayes_adj_gap", "absolute_diff")
    protocol = F.lit(
        "bootstrap_interval" if n_boot else "exploratory_point_estimate_no_confidence_interval"
    )
    return null_safe_join(
        limits.select(
            *keys, "metric", F.col("point").alias("ipw_adj_gap"),
            F.col("ci_low").alias("ipw_ci_low"), F.col("ci_high").alias("ipw_ci_high"),
        ),
        bayes, [*keys, "metric"],
    ).withColumn("inference_protocol", protocol)


def calibration_curve_ci(
    df: DataFrame, keys: list[str], n_boot: int = 300, seed: int = 42, y: str = "y_true",
    prob: str = "prob", bins: int = 10,
) -> DataFrame:
    """Observed rate per non-empty bin with bootstrap limits.

    Resampling n_b outcomes of a bin is one Binomial(n_b, rate_b) draw.
    """
    from .metrics import calibration_curve

    curve = calibration_curve(df, keys, y, prob, bins).where("n > 0")
    schema = T.StructType(
        [*curve.schema.fields, T.StructField("ci_low", T.DoubleType()), T.StructField("ci_high", T.DoubleType())]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low, high = [], []
            for row in pdf.itertuples(index=False):
                rng = _rng(seed, tuple(getattr(row, k) for k in keys), int(row.bin))
                rates = rng.binomial(int(row.n), float(row.observed_rate), size=n_boot) / int(row.n)
                q = np.quantile(rates, [0.025, 0.975])
                low.append(q[0])
                high.append(q[1])
            yield pdf.assign(ci_low=low, ci_high=high)

    width = 1.0 / bins
    return curve.mapInPandas(draw, schema).select(
        *keys, (F.col("bin") * width).alias("bin_low"), ((F.col("bin") + 1) * width).alias("bin_high"),
        ((F.col("bin") + 0.5) * width).alias("bin_mid"), "mean_predicted", "n",
        F.col("observed_rate").alias("observed_freq"), "ci_low", "ci_high",
    )


# --- permutation of group labels -----------------------------------------------------

PERMUTED = ("sensitivity", "fnr", "ppv", "npv", "predicted_positive_rate")


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _gamma_step(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log(Gamma(a + d) / Gamma(a)) - d log(a), without cancellation where ``a`` is large."""
    b = a + d
    out = (b - 0.5) * np.log1p(d / a) - d
    for z, sign in ((b, 1.0), (a, -1.0)):
        out += sign * (1.0 / z - (1.0 / 30.0 - 2.0 / (7.0 * 15.0 * z * z)) / z**3) / 12.0
    few = np.minimum(a, b) < 64
    if few.any():
        out[few] = _lgamma(b[few]) - _lgamma(a[few]) - d[few] * np.log(a[few])
    return out


def urn_shape(good: int, bad: int, n: np.ndarray) -> tuple:
    """Least, largest and most likely number of good rows, centre and width of the sampler's box."""
    total = float(good + bad)
    low, high = np.maximum(0, n - bad), np.minimum(n, good)
    mode = np.clip(np.floor((n + 1.0) * ((good + 1.0) / (total + 2.0))).astype(np.int64), low, high)
    centre = n * (good / total) + 0.5
    variance = n * (good / total) * (bad / total) * ((total - n) / max(total - 1.0, 1.0))
    return low, high, mode, centre, 1.1 * (2.0 * (2.0 / math.e) ** 0.5 * np.sqrt(variance + 0.5) + 3.0 - 2.0 * (3.0 / math.e) ** 0.5)


def urn_log_ratio(good: int, bad: int, n: np.ndarray, mode: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log of the probability of ``x`` good rows over that of ``mode``."""
    d = (x - mode).astype(float)
    up = [(mode + 1).astype(float), (bad - n + mode + 1).astype(float)]
    down = [(n - mode + 1).astype(float), (good - mode + 1).astype(float)]
    tilt = d * np.log((down[0] / up[0]) * (down[1] / up[1]))
    return tilt - sum(_gamma_step(a, d) for a in up) - sum(_gamma_step(a, -d) for a in down)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: np.ndarray) -> np.ndarray:
    """For each ``n``, how many of n rows drawn without replacement are good; exact at any size.

    Ratio of uniforms in Stadlober's box: tries and memory do not grow with the counts.
    """
    n = np.asarray(n, dtype=np.int64)
    if not good or not bad:
        return n.copy() if good else np.zeros_like(n)
    low, high, mode, centre, width = urn_shape(good, bad, n)
    out = mode.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        u, v = 1.0 - rng.random(len(open_)), rng.random(len(open_))
        x = np.floor(centre[open_] + width[open_] * (v - 0.5) / u)
        inside = (x >= low[open_]) & (x <= high[open_])
        x = np.where(inside, x, mode[open_]).astype(np.int64)
        taken = inside & (2.0 * np.log(u) <= urn_log_ratio(good, bad, n[open_], mode[open_], x))
        out[open_[taken]] = x[taken]
        open_ = open_[~taken]
    return out


def permutation_group(
    df: DataFrame, keys: list[str], group: str, a, b, n_perm: int = 1000, seed: int = 42,
    y: str = "y_true", pred: str = "pred",
) -> DataFrame:
    """Null distribution of five gaps when group labels are shuffled.

    A shuffle deals the four kinds of rows (outcome, prediction) to A without
    replacement, so it is a multivariate hypergeometric draw from four counts:
    one cell after the other, each given what the former took.
    """
    # labels of a third group cannot be dealt to two; rows without a label take no part
    third = F.raise_error(F.lit("permutation_group compares exactly two groups; filter the rows first")).cast("boolean")
    df = df.where(F.when(F.col(group).isNull(), F.lit(False)).when(F.col(group).isin([a, b]), F.lit(True)).otherwise(third))
    pairs = G.pair_counts(df, keys, group, a, b, y, pred)
    schema = T.StructType(
        [*_key_schema(pairs, keys), T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in SIDES]
    )

    def deal(rng: np.random.Generator, total: np.ndarray, n_a: int) -> np.ndarray:
        drawn = np.zeros((n_perm, len(total)), dtype=np.int64)
        rest = np.full(n_perm, n_a, dtype=np.int64)
        for c in range(len(total) - 1):
            beyond = int(total[c + 1 :].sum())
            drawn[:, c] = hypergeometric(rng, int(total[c]), beyond, rest)
            rest = rest - drawn[:, c]
        drawn[:, -1] = rest
        return drawn

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                counts = np.array([getattr(row, c) for c in SIDES], dtype=np.int64)
                total, n_a = counts[:4] + counts[4:], int(counts[:4].sum())
                dealt = deal(_rng(seed, "permute", key), total, n_a)
                out = pd.DataFrame(
                    np.vstack([counts, np.hstack([dealt, total - dealt])]), columns=list(SIDES)
                )
                out.insert(0, "replicate", np.arange(n_perm + 1, dtype=np.int32))
                for i, k in enumerate(keys):
                    out.insert(i, k, key[i])
                yield out

    reps = pairs.mapInPandas(draw, schema)
    wide = G.with_side_rates(reps, PERMUTED)
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), G.gap(m).alias("value")) for m in PERMUTED])
    )
    long = wide.select(*keys, "replicate", cells.alias("_c")).select(*keys, "replicate", "_c.*")
    observed = long.where("replicate = 0").select(*keys, "metric", F.col("value").alias("observed_gap"))
    null = null_safe_join(
        long.where("replicate > 0"), sized_broadcast(observed), [*keys, "metric"]
    )
    return null_distribution(null, [*keys, "metric"], n_perm)


def null_distribution(null: DataFrame, keys: list[str], n_perm: int) -> DataFrame:
    """Summary of null draws ``value`` against ``observed_gap`` (p without the +1 rule)."""
    extreme = F.coalesce(F.abs(F.col("value")) >= F.abs(F.col("observed_gap")), F.lit(False))
    return null.groupBy(*keys).agg(
        F.first("observed_gap").alias("observed_gap"),
        F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_sd"),
        F.percentile("value", F.lit(0.025)).alias("null_ci_low"),
        F.percentile("value", F.lit(0.975)).alias("null_ci_high"),
        F.when(
            F.first("observed_gap").isNotNull(),
            F.count_if(extreme) / F.lit(float(n_perm)),
        ).alias("empirical_p"),
        F.lit(n_perm).alias("n_perm"),
    )


# --- replicates of scores: AUROC, Brier, calibration from the same draws ---------------

CELL = ["_side", "_prob", "_pred", "_y"]
#: What a weight vector belongs to, within a comparison.
WEIGHED = ["_b", *CELL]


def _cells(
    df: DataFrame, keys: list[str], group: str, a, b, y: str, prob: str, pred: str,
    extra: list[str] = [],
) -> DataFrame:
    side = F.when(F.col(group) == F.lit(a), 0).when(F.col(group) == F.lit(b), 1)
    rows = df.where(F.col(prob).isNotNull()).select(
        *keys, *extra, side.cast("tinyint").alias("_side"), F.col(prob).cast("double").alias("_prob"),
        F.col(pred).cast("tinyint").alias("_pred"), F.col(y).cast("tinyint").alias("_y"),
    ).where("_side is not null")
    return rows.groupBy(*keys, *extra, *CELL).agg(F.count("*").alias("_n"))


def _score_buckets(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Score ranges of at most ``BUCKET_MEMBERS`` distinct cells, cut where their count says so.

    Distinct scores are dealt to tasks by sampled ranges of (keys, score), so a narrow band of many
    scores is spread like any other; running counts over the ranges and inside each give the places.
    """
    scores = cells.select(*keys, *CELL).distinct().groupBy(*keys, "_prob").agg(F.count("*").alias("_c"))
    ranged = in_ranges(scores, keys, "_prob", RANKED)
    # A score has eight cells at most; they stay together.
    width = BUCKET_MEMBERS - 7
    placed = prefix_sums(ranged, keys, "_p", "_prob", ["_c"], descending=False).select(
        *keys, "_prob", F.floor((F.col("cum__c") - F.col("_c")) / width).cast("int").alias("_b")
    )
    return null_safe_join(cells, sized_broadcast(placed), [*keys, "_prob"])


def _pack_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [*_key_schema(df, keys), T.StructField("_b", T.IntegerType())]
        + [
            T.StructField("side", T.BinaryType()), T.StructField("prob", T.BinaryType()),
            T.StructField("pred", T.BinaryType()), T.StructField("y", T.BinaryType()),
            T.StructField("w", T.BinaryType()),
        ]
    )


def _packed(pdf: pd.DataFrame, keys: list[str], weights: np.ndarray) -> pd.DataFrame:
    """One row holding a bucket's cells, descending by score, and their weights."""
    order = np.lexsort(
        (pdf["_y"], pdf["_pred"], pdf["_side"], -pdf["_prob"].to_numpy())
    )
    part = pdf.iloc[order]
    return pd.DataFrame(
        {
            **{k: [part[k].iloc[0]] for k in keys},
            "_b": [int(part["_b"].iloc[0])],
            "side": [part["_side"].to_numpy(np.int8).tobytes()],
            "prob": [part["_prob"].to_numpy(np.float64).tobytes()],
            "pred": [part["_pred"].to_numpy(np.int8).tobytes()],
            "y": [part["_y"].to_numpy(np.int8).tobytes()],
            "w": [np.ascontiguousarray(weights[:, order], dtype=np.int64).tobytes()],
        }
    )


def weighted_cells_by_row(
    df: DataFrame, keys: list[str], group: str, a, b, n_boot: int, seed: int, y: str, prob: str,
    pred: str,
) -> DataFrame:
    """Row bootstrap weights of score cells; each group is drawn to its own size."""
    cells = _score_buckets(
        _cells(df, keys, group, a, b, y, prob, pred).persist(StorageLevel.MEMORY_AND_DISK), keys
    )
    masses = cells.groupBy(*keys, "_side", "_b").agg(F.sum("_n").alias("_m"))
    draws = _bucket_draws(masses, [*keys, "_side"], "_b", "_m", n_boot, seed)

    def pack(key: tuple, pdf: pd.DataFrame, drawn_to: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CELL).reset_index(drop=True)
        draws_of = dict(zip(drawn_to["_side"], drawn_to["_draws"]))
        weights = np.zeros((n_boot + 1, len(pdf)), dtype=np.int64)
        weights[0] = pdf["_n"].to_numpy()
        for s in (0, 1):
            here = np.flatnonzero(pdf["_side"].to_numpy() == s)
            if len(here):
                n = np.asarray(draws_of[s], dtype=np.int64)
                share = pdf["_n"].to_numpy(dtype=float)[here]
                rng = _rng(seed, "cells", key, s)
                weights[1:, here] = rng.multinomial(n, share / share.sum())
        return _packed(pdf, keys, weights)

    return (
        cells.groupBy(*keys, "_b").cogroup(draws.groupBy(*keys, "_b"))
        .applyInPandas(pack, _pack_schema(df, keys))
    )


def cluster_weight_sums(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str, n_boot: int, seed: int,
    y: str, prob: str, pred: str,
) -> DataFrame:
    """Cluster bootstrap weights of score cells, at most ``MERGED`` vectors to be added a cell.

    Every cluster has one multiplicity per replicate. They are drawn, bucket by bucket of clusters,
    in the tasks that hold the buckets' cells. A task holds as many buckets as their rows allow and
    sends one weight vector per distinct cell; vectors of ``MERGED`` tasks are added at a time, so
    what is shuffled and held grows with distinct cells, not with buckets.
    """
    counted = _cells(df, keys, group, a, b, y, prob, pred, [cluster]).persist(StorageLevel.MEMORY_AND_DISK)
    cells = _score_buckets(counted, keys)
    clusters = cells.select(*keys, cluster).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    bucket = _cluster_bucket(clusters, keys, cluster)
    inside = Window.partitionBy(*keys, "_cb").orderBy(cluster)
    rows = cells.withColumn("_cb", bucket).withColumn("_ci", F.dense_rank().over(inside) - 1).drop(cluster).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    sizes = rows.groupBy(*keys, "_cb").agg((F.max("_ci") + 1).cast("long").alias("_m"), F.count("*").alias("_rows")).persist()
    draws = _bucket_draws(sizes, keys, "_cb", "_m", n_boot, seed)
    clusters.unpersist()
    # buckets of a task, and tasks that share a bucket with many cells (a cluster may hold most rows)
    held = rows.select(*keys, *CELL).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    most, last = sizes.agg(F.max("_rows"), F.max("_cb")).first()
    counted.unpersist()
    limit = 4 * WEIGHTED if held <= HELD else min(WEIGHTED, 2 * HELD)
    span = max(1, limit // int(most or 1))
    of_task = F.floor(F.col("_cb") / F.lit(span)).cast("int")
    shares = sizes.groupBy(*keys, of_task.alias("_cg")).agg(F.ceil(F.sum("_rows") / F.lit(limit)).cast("int").alias("_shares")).persist()
    cut = null_safe_join(rows.withColumn("_cg", of_task), sized_broadcast(shares), [*keys, "_cg"]).withColumn(
        "_share", F.pmod(F.xxhash64("_b", *CELL), F.col("_shares")).cast("int")
    ).drop("_shares")
    draws_of = null_safe_join(draws.withColumn("_cg", of_task), shares, [*keys, "_cg"]).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))
    ).select(*keys, "_cg", "_share", "_cb", "_mass", "_draws")
    names = WEIGHED
    sum_schema = T.StructType(
        [*_key_schema(df, keys), T.StructField("_cg", T.IntegerType()), T.StructField("_b", T.IntegerType())]
        + [rows.schema[c] for c in CELL] + [T.StructField("_w", T.BinaryType())]
    )

    def vectors(key: tuple, pdf: pd.DataFrame, matrix: np.ndarray) -> pd.DataFrame:
        out = pdf[names].reset_index(drop=True)
        for i, k in enumerate([*keys, "_cg"]):
            out.insert(i, k, key[i])
        out["_w"] = [w.tobytes() for w in matrix]
        return out

    def weigh(key: tuple, pdf: pd.DataFrame, drawn_to: pd.DataFrame) -> pd.DataFrame:
        """The buckets' multiplicities, drawn where their cells lie; only sums per cell leave the task."""
        pdf["_cell"] = pdf.groupby(names, sort=False, dropna=False).ngroup()
        first = pdf.drop_duplicates("_cell")
        total = np.zeros((len(first), n_boot + 1), dtype=np.int64)
        drawn_of = {int(r["_cb"]): drawn_to.iloc[[i]] for i, r in enumerate(drawn_to[["_cb"]].to_dict("records"))}
        for cb, part in pdf.groupby("_cb", sort=True):
            here = drawn_of[int(cb)]
            weights = _weights(here, int(here["_mass"].iloc[0]), (*key[: len(keys)], np.int32(cb)), seed)
            of_cluster = np.ones((weights.shape[1], n_boot + 1), dtype=np.int64)
            of_cluster[:, 1:] = weights.T
            part = part.sort_values("_cell", kind="stable")
            for start in range(0, len(part), BUCKET_MEMBERS):
                some = part.iloc[start : start + BUCKET_MEMBERS]
                cell = some["_cell"].to_numpy()
                starts = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
                times = some["_n"].to_numpy(dtype=np.int64)
                found = of_cluster[some["_ci"].to_numpy()]
                if (times != 1).any():
                    found *= times[:, None]
                total[cell[starts]] += np.add.reduceat(found, starts, axis=0)
        return vectors(key, first, total)

    def added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return vectors(key, *_added(pdf, names))

    sums = (
        cut.groupBy(*keys, "_cg", "_share").cogroup(draws_of.groupBy(*keys, "_cg", "_share"))
        .applyInPandas(weigh, sum_schema)
    )
    tasks = int(last or 0) // span + 1
    while tasks > MERGED:
        tasks = -(-tasks // MERGED)
        above = F.floor(F.col("_cg") / F.lit(MERGED)).cast("int")
        sums = sums.withColumn("_cg", above).groupBy(*keys, "_cg", "_b").applyInPandas(added, sum_schema)
    return sums


def weighted_cells_by_cluster(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str, n_boot: int, seed: int,
    y: str, prob: str, pred: str,
) -> DataFrame:
    """Cluster bootstrap weights of score cells, a row per score range."""
    sums = cluster_weight_sums(df, keys, group, a, b, cluster, n_boot, seed, y, prob, pred)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, matrix = _added(pdf, WEIGHED)
        return _packed(pd.concat([pdf.loc[first.index, keys], first], axis=1), keys, matrix.T)

    return sums.groupBy(*keys, "_b").applyInPandas(pack, _pack_schema(df, keys))


def _added(pdf: pd.DataFrame, names: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """First row and summed weight vector of each distinct cell."""
    cell = pdf.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    first = np.unique(cell, return_index=True)[1]
    total = np.zeros((len(first), len(pdf["_w"].iloc[0]) // 8), dtype=np.int64)
    for c, w in zip(cell, pdf["_w"]):
        total[c] += np.frombuffer(w, dtype=np.int64)
    return pdf[names].iloc[first], total


def _unpack(row, n_boot: int):
    prob = np.frombuffer(row.prob, dtype=np.float64)
    flags = [np.frombuffer(getattr(row, c), dtype=np.int8) for c in ("side", "pred", "y")]
    weights = np.frombuffer(row.w, dtype=np.int64).reshape(n_boot + 1, len(prob))
    return prob, *flags, weights


SCOPES = ("a", "b", "overall")
PARTIALS = (*SIDES, "sq_a", "sq_b", "u_a", "u_b", "u_overall")


def _ranked_pairs(prob: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Per replicate, pairs of this bucket ranked correctly (ties count half)."""
    starts = np.flatnonzero(np.r_[True, np.diff(prob) != 0])
    p = np.add.reduceat(pos, starts, axis=1).astype(float)
    n = np.add.reduceat(neg, starts, axis=1).astype(float)
    above = np.cumsum(p, axis=1) - p
    return (n * (above + p / 2.0)).sum(axis=1)


def score_replicates(packed: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    """Counts, AUROC and Brier of A, B and both, one row per replicate."""
    schema = T.StructType(
        [*_key_schema(packed, keys), T.StructField("_b", T.IntegerType())]
        + [T.StructField("replicate", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in PARTIALS]
    )

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                prob, side, pred, y, w = _unpack(row, n_boot)
                out = {}
                for s, label in ((0, "a"), (1, "b")):
                    for c, (p, t) in {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}.items():
                        out[f"{c}_{label}"] = w @ ((side == s) & (pred == p) & (y == t)).astype(np.int64)
                    out[f"sq_{label}"] = w @ ((side == s) * (prob - y) ** 2)
                    here = side == s
                    out[f"u_{label}"] = _ranked_pairs(prob, w * (here & (y == 1)), w * (here & (y == 0)))
                out["u_overall"] = _ranked_pairs(prob, w * (y == 1), w * (y == 0))
                frame = pd.DataFrame(out)[list(PARTIALS)].astype(float)
                frame.insert(0, "replicate", np.arange(n_boot + 1, dtype=np.int32))
                frame.insert(0, "_b", int(getattr(row, "_b", row[len(keys)])))
                for i, k in enumerate(keys):
                    frame.insert(i, k, row[i])
                yield frame

    parts = packed.mapInPandas(reduce, schema)
    above = (
        Window.partitionBy(*keys, "replicate").orderBy(F.col("_b").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pos = {s: F.col(f"tp_{s}") + F.col(f"fn_{s}") for s in "ab"}
    neg = {s: F.col(f"fp_{s}") + F.col(f"tn_{s}") for s in "ab"}
    pos["overall"], neg["overall"] = pos["a"] + pos["b"], neg["a"] + neg["b"]
    crossed = parts.select(
        *keys, "replicate", *PARTIALS,
        *[
            (F.coalesce(F.sum(pos[s]).over(above), F.lit(0.0)) * neg[s]).alias(f"x_{s}")
            for s in SCOPES
        ],
    )
    sums = crossed.groupBy(*keys, "replicate").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in SIDES],
        *[F.sum(f"sq_{s}").alias(f"sq_{s}") for s in "ab"],
        *[(F.sum(f"u_{s}") + F.sum(f"x_{s}")).alias(f"u_{s}") for s in SCOPES],
    )
    size = {s: pos[s] + neg[s] for s in SCOPES}
    sq = {"a": F.col("sq_a"), "b": F.col("sq_b"), "overall": F.col("sq_a") + F.col("sq_b")}
    area = {
        s: F.try_divide(F.col(f"u_{s}"), pos[s].cast("double") * neg[s].cast("double")) for s in SCOPES
    }
    return sums.select(
        *keys, "replicate", *SIDES,
        *[area[s].alias(f"discrimination__auroc_{s}") for s in SCOPES],
        (area["a"] - area["b"]).alias("discrimination__auroc_gap"),
        *[ratio(sq[s], size[s]).alias(f"calibration__brier_{s}") for s in SCOPES],
    )


# Fixed values of the calibration fit.
NEWTON_STEPS, NEWTON_TOLERANCE, SEPARATION_TOLERANCE = 100, 1e-8, 1e-10
MOMENTS = ("g0", "g1", "h00", "h01", "h11", "wmax", "pos", "neg", "xmin", "xmax")


def calibration_replicates(packed: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    """Intercept and slope of outcome on logit(score) for A, B and both, per replicate.

    Newton's method for all comparisons and replicates together. A step is one
    map over the cached buckets and one grouped sum of five terms; the state is
    a DataFrame cut off from its lineage by a reliable checkpoint.
    """
    spark = packed.sparkSession
    ensure_checkpoint_dir(spark)
    size = 3 * (n_boot + 1)
    moment_schema = T.StructType(
        [*_key_schema(packed, keys), T.StructField("slot", T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in MOMENTS]
    )

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                prob, side, _pred, y, w = _unpack(row, n_boot)
                p = np.clip(prob, LOGIT_EPS, 1.0 - LOGIT_EPS)
                x = np.log(p / (1.0 - p))
                coef = np.asarray(row.coef, dtype=float).reshape(3, n_boot + 1, 2)
                live = np.asarray(row.live, dtype=bool).reshape(3, n_boot + 1)
                for scope in range(3):
                    use = np.flatnonzero(live[scope])
                    member = side == scope if scope < 2 else np.ones(len(side), dtype=bool)
                    if not len(use) or not member.any():
                        continue
                    xs, ys, ws = x[member], y[member].astype(float), w[use][:, member].astype(float)
                    eta = coef[scope, use, 0][:, None] + coef[scope, use, 1][:, None] * xs
                    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -700.0, 700.0)))
                    v = mu * (1.0 - mu)
                    seen = ws > 0
                    res = ws * (ys - mu)
                    wv = ws * v
                    frame = pd.DataFrame(
                        {
                            "slot": (scope * (n_boot + 1) + use).astype(np.int32),
                            "g0": res.sum(axis=1), "g1": res @ xs,
                            "h00": wv.sum(axis=1), "h01": wv @ xs, "h11": wv @ (xs * xs),
                            "wmax": np.where(seen, v, 0.0).max(axis=1),
                            "pos": ws @ ys, "neg": ws @ (1.0 - ys),
                            "xmin": np.where(seen, xs, np.inf).min(axis=1),
                            "xmax": np.where(seen, xs, -np.inf).max(axis=1),
                        }
                    )
                    for i, k in enumerate(keys):
                        frame.insert(i, k, row[i])
                    yield frame

    slots = packed.select(*keys).distinct().withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    )
    state = slots.select(
        *keys, F.col("slot").cast("int").alias("slot"), F.lit(0.0).alias("c0"), F.lit(0.0).alias("c1"),
        F.lit(None).cast("string").alias("status"),
    ).checkpoint()
    # The state is small beside the data: its tasks are sized by its own rows.
    width = int(state.count() // 50_000) + 1
    for _ in range(NEWTON_STEPS):
        vectors = state.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("slot", "c0", "c1", F.col("status").isNull().alias("live")))).alias("_s")
        ).select(
            *keys,
            F.flatten(F.transform("_s", lambda s: F.array(s["c0"], s["c1"]))).alias("coef"),
            F.transform("_s", lambda s: s["live"]).alias("live"),
        ).where(F.exists("live", lambda v: v)).persist()
        unfinished = vectors.count()
        if unfinished == 0:
            break
        small = F.broadcast(vectors) if unfinished <= MAX_BROADCAST_FITS else vectors
        sums = (
            null_safe_join(packed, small, keys)
            .mapInPandas(moments, moment_schema)
            .groupBy(*keys, "slot")
            .agg(
                *[F.sum(c).alias(c) for c in ("g0", "g1", "h00", "h01", "h11", "pos", "neg")],
                F.max("wmax").alias("wmax"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
            )
        )
        state = _newton_step(state, sums, keys).coalesce(width).checkpoint()
        vectors.unpersist()
    names = F.array(*[F.lit(s) for s in SCOPES])
    known = F.coalesce(F.col("status"), F.lit("not_converged"))
    fit_ok = known == "ok"
    return state.select(
        *keys, F.get(names, F.floor(F.col("slot") / (n_boot + 1)).cast("int")).alias("scope"),
        (F.col("slot") % (n_boot + 1)).cast("int").alias("replicate"),
        F.when(fit_ok, F.col("c0")).alias("intercept"), F.when(fit_ok, F.col("c1")).alias("slope"),
        known.alias("status"),
    )


def _newton_step(state: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Advance unfinished fits by one step and name the reason when one cannot go on."""
    j = null_safe_join(state, sums, [*keys, "slot"], "left")
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    d0 = F.try_divide(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
    d1 = F.try_divide(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    one_class = (F.coalesce(F.col("pos"), F.lit(0.0)) == 0) | (F.coalesce(F.col("neg"), F.lit(0.0)) == 0)
    stopped = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(one_class, "single_class")
        .when(F.col("xmin") == F.col("xmax"), "degenerate_predictor")
        .when(F.isnan("wmax"), "nonfinite_fit")
        .when(F.col("wmax") < SEPARATION_TOLERANCE, "separation")
        .when(det == 0, "singular_information_matrix")
        .when(~finite(d0) | ~finite(d1), "nonfinite_step")
    )
    marked = j.select(
        *keys, "slot", "c0", "c1", stopped.alias("_stop"), d0.alias("_d0"), d1.alias("_d1")
    )
    move = F.col("_stop").isNull()
    done = F.greatest(F.abs("_d0"), F.abs("_d1")) < NEWTON_TOLERANCE
    return marked.select(
        *keys, "slot",
        F.when(move, F.col("c0") + F.col("_d0")).otherwise(F.col("c0")).alias("c0"),
        F.when(move, F.col("c1") + F.col("_d1")).otherwise(F.col("c1")).alias("c1"),
        F.when(move & done, F.lit("ok")).otherwise(F.col("_stop")).alias("status"),
    )


# Names of the states of a calibration fit.
CALIBRATION_STATUS = {
    "ok": "ok", "one_class": "single_class", "no_rows": "single_class", "nonfinite_predictor": "nonfinite_predictor",
    "separation": "separation", "singular": "singular_information_matrix", "not_converged": "not_converged",
}


def calibration_fit(
    df: DataFrame, keys: list[str], y: str = "y_true", prob: str = "prob"
) -> DataFrame:
    """Calibration intercept and slope per group, with an explicit status.

    All groups are fitted together from their counted (score, outcome) cells. A score that is NULL
    or NaN makes its group ``nonfinite_predictor``, equal scores ``degenerate_predictor``.
    """
    p = F.col(prob).cast("double")
    x = F.when(p.isNull() | F.isnan(p), F.lit(math.nan)).otherwise(clipped_logit(prob))
    cells = df.groupBy(*keys, x.alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").cast("double").alias("_n")).persist()
    fits = fit_all(cells, keys, [Model("calibration", ("_x",), "_y", weight="_n")])
    rows = []
    for f in fits.fits:
        constant = f.status == "singular" and f.spread is not None and f.spread[1] == 0.0
        rows.append((*f.key, f.estimate(), f.estimate("_x"), "degenerate_predictor" if constant else CALIBRATION_STATUS[f.status]))
    cells.unpersist()
    schema = T.StructType([*_key_schema(df, keys), *T.StructType.fromDDL("calib_intercept double, calib_slope double, calib_status string").fields])
    return df.sparkSession.createDataFrame(rows, schema)


def bootstrap_comparison(
    df: DataFrame, keys: list[str], group: str, a, b, cluster: str | None = None,
    n_boot: int = 1000, seed: int = 42, target: float | None = None, level: float = 0.95,
    y: str = "y_true", prob: str = "prob", pred: str = "pred", calibration: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """All uncertainty of a comparison from one set of replicates.

    Returns the long interval table and the calibration status counts.
    """
    if cluster is None:
        packed = weighted_cells_by_row(df, keys, group, a, b, n_boot, seed, y, prob, pred)
    else:
        packed = weighted_cells_by_cluster(df, keys, group, a, b, cluster, n_boot, seed, y, prob, pred)
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    stats = count_statistics(score_replicates(packed, keys, n_boot), keys, target)
    if not calibration:
        return summarise(stats, keys, n_boot, level), stats.limit(0)
    fits = calibration_replicates(packed, keys, n_boot)
    wide = fits.groupBy(*keys, "replicate").agg(
        *[
            F.max(F.when(F.col("scope") == s, F.col(c))).alias(f"calibration__{c}_{s}")
            for s in SCOPES
            for c in ("intercept", "slope")
        ]
    )
    table = summarise(null_safe_join(stats, wide, [*keys, "replicate"]), keys, n_boot, level)
    statuses = (
        fits.where("replicate > 0").groupBy(*keys, "scope", "status").agg(F.count("*").alias("_n"))
        .groupBy(*keys, "scope")
        .agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "_n"))))).alias("status_counts"))
    )
    points = fits.where("replicate = 0").select(*keys, "scope", F.col("status").alias("calib_status"))
    return table, null_safe_join(points, statuses, [*keys, "scope"], "left")
