"""Train/test splits, folds and auxiliary holdouts.

Assignments depend on a seed and the row or cluster id only, so they do not
change with partitioning, and both sides of a rerun agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import null_safe_join, sized_broadcast
from .ranking import even_cuts, hash_parts, hash_selections


class IsolationError(RuntimeError):
    """Training and evaluation data share rows or clusters."""


def share_cut(share: float) -> Column:
    return F.ceil(F.lit(share) * F.col("_total"))


def _named(df: DataFrame, part: str) -> DataFrame:
    label = F.when(F.col(part) == 0, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", label).drop(part)


def split_stratified(
    df: DataFrame, keys: list[str], y: str = "y_true", row_id: str = "row_id",
    seed: int = 42, share: float = 0.3,
) -> DataFrame:
    """Hold out ceil(share x n) rows of each outcome class."""
    return _named(hash_parts(df, [*keys, y], [row_id], seed, [share_cut(share)], "_part"), "_part")


def split_grouped(
    df: DataFrame, keys: list[str], cluster: str = "cluster_id", seed: int = 42,
    share: float = 0.3,
) -> DataFrame:
    """Hold out ceil(share x G) of the G clusters, all their rows together."""
    clusters = df.select(*keys, cluster).distinct()
    parts = hash_parts(df, keys, [cluster], seed, [share_cut(share)], "_part", clusters)
    return _named(parts, "_part")


def split_diagnostics(
    df: DataFrame, keys: list[str], y: str = "y_true", cluster: str | None = None
) -> DataFrame:
    """Sizes, event rates and realised fractions; cluster counts when clustered."""
    test, train = F.col("split") == "test", F.col("split") == "train"
    yd = F.col(y).cast("double")
    out = df.groupBy(*keys).agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
        F.sum(F.when(train, F.col(y))).cast("bigint").alias("n_train_events"),
        F.sum(F.when(test, F.col(y))).cast("bigint").alias("n_test_events"),
        F.avg(F.when(train, yd)).alias("train_event_rate"),
        F.avg(F.when(test, yd)).alias("test_event_rate"),
        F.avg(test.cast("double")).alias("realized_test_fraction"),
    )
    if cluster is None:
        return out
    per_cluster = df.groupBy(*keys, cluster).agg(
        F.max(train.cast("int")).alias("_tr"), F.max(test.cast("int")).alias("_te")
    )
    counts = per_cluster.groupBy(*keys).agg(
        F.sum("_tr").cast("bigint").alias("n_train_clusters"),
        F.sum("_te").cast("bigint").alias("n_test_clusters"),
        F.count("*").alias("n_total_clusters"),
        F.sum(F.col("_tr") * F.col("_te")).cast("bigint").alias("cluster_overlap_train_test"),
    )
    return null_safe_join(out, counts, keys)


def kfold_stratified(
    df: DataFrame, keys: list[str], y: str = "y_true", row_id: str = "row_id", seed: int = 42,
    folds: int = 5, name: str = "fold",
) -> DataFrame:
    """Folds whose class counts differ by at most one row."""
    return hash_parts(df, [*keys, y], [row_id], seed, even_cuts(folds), name)


def kfold_grouped(
    df: DataFrame, keys: list[str], y: str = "y_true", cluster: str = "cluster_id",
    seed: int = 42, folds: int = 5, name: str = "fold",
) -> DataFrame:
    """Folds of whole clusters, balanced over clusters with 0, 1 and more positives."""
    clusters = df.groupBy(*keys, cluster).agg(
        F.least(F.sum(y), F.lit(2)).cast("int").alias("_level")
    )
    assigned = hash_parts(
        clusters, [*keys, "_level"], [cluster], seed, even_cuts(folds), name
    ).drop("_level")
    return null_safe_join(df, assigned, [*keys, cluster])


def fold_violations(
    df: DataFrame, keys: list[str], cluster: str = "cluster_id", fold: str = "fold"
) -> DataFrame:
    """Number of clusters found in more than one fold, per comparison (expected 0)."""
    per_cluster = df.groupBy(*keys, cluster).agg(
        (F.max(fold) > F.min(fold)).cast("int").alias("_bad")
    )
    return per_cluster.groupBy(*keys).agg(
        F.count("*").alias("n_clusters"), F.sum("_bad").cast("bigint").alias("n_spanning")
    )


def auxiliary_holdout(
    df: DataFrame, keys: list[str], group: str, primary: list, y: str = "y_true",
    row_id: str = "row_id", seed: int = 42, share: float = 0.3,
) -> DataFrame:
    """Holdout rows of the groups that take no part in model fitting.

    Stratified by outcome only where both classes have two rows or more; a
    group of fewer than two rows is an error.
    """
    rest = df.where(~F.col(group).isin(primary))
    classes = rest.groupBy(*keys, group).agg(
        F.count("*").alias("_rows"),
        F.least(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).alias("_least"),
    )
    checked = classes.withColumn(
        "_least",
        F.when(
            F.col("_rows") < 2,
            F.raise_error(F.concat(F.lit("too few rows for a holdout in group "), F.col(group).cast("string"))),
        ).otherwise(F.col("_least")).cast("bigint"),
    ).select(*keys, group, "_least")
    marked = null_safe_join(rest, sized_broadcast(checked), [*keys, group]).withColumn(
        "_stratum", F.when(F.col("_least") >= 2, F.col(y)).otherwise(F.lit(-1))
    )
    parts = hash_parts(
        marked, [*keys, group, "_stratum"], [row_id], seed, [share_cut(share)], "_part"
    )
    return parts.where("_part = 0").select(*df.columns)


def shared_rows(training: DataFrame, evaluation: DataFrame, on: list[str]) -> DataFrame:
    """Ids present on both sides; compute once, count, and require zero."""
    return training.select(*on).intersect(evaluation.select(*on))


def require_disjoint(
    training: DataFrame, evaluation: DataFrame, on: list[str], context: str = "auxiliary"
) -> bool:
    n = shared_rows(training, evaluation, on).count()
    if n:
        raise IsolationError(f"{context}: {n} id(s) appear in training and evaluation")
    return True


def union_holdouts(parts: list[DataFrame], row_id: list[str]) -> DataFrame:
    """Union of holdouts; a duplicated id fails the job."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    counted = both.groupBy(*row_id).agg(F.count("*").alias("_n"))
    return counted.select(
        *row_id,
        F.when(F.col("_n") > 1, F.raise_error(F.lit("a holdout contains duplicate row ids")))
        .otherwise(F.col("_n")).cast("bigint").alias("copies"),
    )


#: Distinct ids numbered in one task.
TOKEN_RANGE = 50_000


def dense_cluster_token(
    df: DataFrame, keys: list[str], cluster: str = "cluster_id", prefix: str = "P",
    name: str = "cluster_token",
) -> DataFrame:
    """Distinct clusters numbered in the order of their text: P000001, P000002, ...

    Ids are dealt to ranges of their order, cut at sampled ids, and numbered inside a range behind
    the ranges before it; a prefix that all (or all but one) ids share does not put them together.
    """
    from .ranking import in_ranges, prefix_sums

    ids = df.where(F.col(cluster).isNotNull()).select(
        *keys, F.col(cluster).cast("string").alias("_c")
    ).distinct()
    cells = in_ranges(ids, keys, "_c", TOKEN_RANGE).withColumn("one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(cells, keys, "_p", "_c", ["one"], descending=False)
    return ranked.select(
        *keys, F.col("_c").alias(cluster),
        F.format_string(prefix + "%06d", F.col("cum_one")).alias(name),
    )


# --- balanced training sets ---------------------------------------------------

SCHEMES = (
    "original", "equal_sample_size", "equal_positive_cases", "equal_prevalence",
    "class_balanced_weighting", "group_balanced_weighting", "positive_reweighting",
)


def balanced_training(
    df: DataFrame, keys: list[str], group: str, a, b, y: str = "y_true",
    row_id: str = "row_id", seed: int = 42,
) -> DataFrame:
    """Training rows with a weight per scheme; a row left out by a scheme has NULL.

    One row in, one row out: the three downsampling schemes are exact-size hash selections, all
    from one count of hash buckets; the sizes of groups and outcomes come from the same count.
    """
    kept = df.where(F.col(group).isin([a, b]))
    n = lambda plan, member: F.coalesce(F.sum(F.when((F.col("plan") == plan) & member, F.col("n"))), F.lit(0)).cast("double")
    is_a, pos, every = F.col(group) == F.lit(a), F.coalesce(F.col(y) == 1, F.lit(False)), F.lit(True)
    sizes = {
        "_z_na": n("_size", is_a), "_z_nb": n("_size", ~is_a), "_z_pa": n("_cases", is_a), "_z_pb": n("_cases", ~is_a),
        "_z_p": n("_cases", every), "_z_n": n("_size", every),
    }
    share = F.least(F.try_divide(F.col("_z_pa"), F.col("_z_na")), F.try_divide(F.col("_z_pb"), F.col("_z_nb")))
    own_n = F.when(is_a, F.col("_z_na")).otherwise(F.col("_z_nb"))
    by_prev = hash_selections(
        kept, keys, group, [row_id], {"_size": (seed, every), "_cases": (seed + 1, pos), "_prev": (seed + 2, pos)}, sizes,
        {"_size": F.least("_z_na", "_z_nb"), "_cases": F.least("_z_pa", "_z_pb"), "_prev": F.bround(share * own_n)},
    )
    p, total = F.col("_z_p"), F.col("_z_n")
    own_p = F.when(F.col(group) == F.lit(a), F.col("_z_pa")).otherwise(F.col("_z_pb"))
    weights = {
        "original": F.lit(1.0),
        "equal_sample_size": F.when(F.col("_size"), F.lit(1.0)),
        "equal_positive_cases": F.when(~pos | F.col("_cases"), F.lit(1.0)),
        "equal_prevalence": F.when(~pos | F.col("_prev"), F.lit(1.0)),
        "class_balanced_weighting": F.try_divide(
            total, 2.0 * F.when(F.col(y) == 1, p).otherwise(total - p)
        ),
        "group_balanced_weighting": F.try_divide(total, 2.0 * own_n),
        "positive_reweighting": F.when(
            (F.col(y) == 1) & (F.col("_z_pa") > 0) & (F.col("_z_pb") > 0),
            F.greatest("_z_pa", "_z_pb") / own_p,
        ).otherwise(F.lit(1.0)),
    }
    return by_prev.select(*df.columns, *[w.alias(f"w_{s}") for s, w in weights.items()])
