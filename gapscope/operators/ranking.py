"""Order-dependent primitives that never sort a whole group in one task.

A comparison may hold a large share of all rows. Running totals, exact
quantiles and hash-ordered selections are therefore computed in two levels:
every row gets a coarse bucket that is a monotone function of the order, the
small table of bucket totals is accumulated, and ordering by value happens
only inside a bucket.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_text, value_lattice
from ..session import ensure_checkpoint_dir, null_safe_join, sized_broadcast

HASH_BUCKETS_HEX = 4


def prefix_sums(
    cells: DataFrame,
    keys: list[str],
    bucket: str,
    order: str,
    values: list[str],
    descending: bool = True,
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running total) and ``tot_<v>`` (group total).

    ``cells`` holds one row per (keys, order) and a ``bucket`` column that is
    monotone in ``order``.
    """
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    # One struct key: equality treats null fields as equal, and the window below
    # and the join share the partitioning on (key, bucket).
    keyed = cells.withColumn("_key", F.struct(*keys))
    totals = keyed.groupBy("_key", bucket).agg(*[F.sum(v).alias(f"_b_{v}") for v in values])
    group = Window.partitionBy("_key")
    before = group.orderBy(direction(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_key",
        bucket,
        *[F.coalesce(F.sum(f"_b_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_b_{v}").over(group).alias(f"tot_{v}") for v in values],
    )
    inside = (
        Window.partitionBy("_key", bucket)
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = keyed.select("*", *[F.sum(v).over(inside).alias(f"_r_{v}") for v in values])
    # A left join: every bucket has its offset, and no null filter is inferred on one
    # side only, so both sides reuse one exchange of the cells.
    return running.join(offsets, ["_key", bucket], "left").select(
        *cells.columns,
        *[(F.col(f"_o_{v}") + F.col(f"_r_{v}")).alias(f"cum_{v}") for v in values],
        *[f"tot_{v}" for v in values],
    )


def in_ranges(df: DataFrame, keys: list[str], order: str, rows_per_range: int, name: str = "_p") -> DataFrame:
    """``df`` dealt to ranges of (keys, order) of about ``rows_per_range`` rows, numbered in ``name``.

    Ranges are cut at sampled values, so however alike the values are (a common prefix, a narrow
    band) no range holds many; equal values share one. The result is written down, so that a row
    keeps its range when a task is repeated, and ``name`` may serve as bucket of :func:`prefix_sums`.
    """
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist()
    ranges = -(-kept.count() // rows_per_range) or 1
    dealt = kept.repartitionByRange(ranges, *[F.col(k) for k in keys], F.col(order))
    out = dealt.withColumn(name, F.spark_partition_id()).checkpoint()
    kept.unpersist()
    return out


def numbered_rows(df: DataFrame, name: str = "_position") -> DataFrame:
    """Rows numbered from 0 in the order of the table: of its files where it is read from files.

    Two levels: rows are counted by part of a file (or by partition), and a row's number is its place
    in the part after the parts before it. No part is sorted and no row moves.
    """
    try:
        df.select("_metadata.file_path")
        part = F.struct(F.col("_metadata.file_path").alias("a"), F.col("_metadata.file_block_start").alias("b"))
    except AnalysisException:
        part = F.struct(F.lit("").alias("a"), F.spark_partition_id().cast("long").alias("b"))
    placed = df.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_seen"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_seen").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return placed.join(sized_broadcast(offsets), "_part").select(*df.columns, (F.col("_seen") - F.col("_first") + F.col("_o")).alias(name))


def _known(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value; NaN counts as missing."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles, one output column per entry of ``probs``.

    Pass one counts rows per value bucket and finds the buckets that hold the
    wanted ranks. Pass two looks only at rows in those buckets. Nulls are
    ignored; a group without values yields no row.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    rows = _known(df, value).select(
        *keys, F.col(value).cast("double").alias("_v"), w.cast("bigint").alias("_n")
    ).withColumn("_b", value_lattice("_v"))

    buckets = rows.groupBy(*keys, "_b").agg(
        F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = buckets.select(
        *keys, "_b", "_lo", "_hi",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(group).alias("_total"),
    )

    def wanted(i: int, q: float) -> list[Column]:
        h = (F.col("_total") - 1) * F.lit(float(q))
        return [
            F.struct(F.lit(2 * i).alias("i"), (F.floor(h) + 1).cast("bigint").alias("r")),
            F.struct(F.lit(2 * i + 1).alias("i"), (F.ceil(h) + 1).cast("bigint").alias("r")),
        ]

    ranks = F.array(*[c for i, q in enumerate(probs.values()) for c in wanted(i, q)])
    hit = F.filter(ranks, lambda s: (s["r"] > F.col("_before")) & (s["r"] <= F.col("_upto")))
    targets = sized_broadcast(placed.withColumn("_w", hit).where(F.size("_w") > 0))

    near = null_safe_join(rows, targets.select(*keys, "_b", "_lo", "_hi"), [*keys, "_b"])
    fine = F.coalesce(
        F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 4096.0),
        F.lit(0),
    ).cast("int")
    cells = near.groupBy(*keys, "_b", fine.alias("_f"), "_v").agg(F.sum("_n").alias("_n"))
    ranked = prefix_sums(cells, [*keys, "_b"], "_f", "_v", ["_n"], descending=False)
    marks = targets.select(*keys, "_b", "_before", "_total", F.explode("_w").alias("_w"))
    found = (
        null_safe_join(ranked, marks, [*keys, "_b"])
        .where(
            (F.col("_w.r") - F.col("_before") > F.col("cum__n") - F.col("_n"))
            & (F.col("_w.r") - F.col("_before") <= F.col("cum__n"))
        )
        .groupBy(*keys)
        .agg(
            F.max("_total").alias("_total"),
            *[
                F.max(F.when(F.col("_w.i") == j, F.col("_v"))).alias(f"_q{j}")
                for j in range(2 * len(probs))
            ],
        )
    )
    out = []
    for i, (name, q) in enumerate(probs.items()):
        h = (F.col("_total") - 1) * F.lit(float(q))
        low, high = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        out.append((low + (h - F.floor(h)) * (high - low)).alias(name))
    return found.select(*keys, *out)


def value_at_rank(
    df: DataFrame, keys: list[str], value: str, rank: Column, name: str, descending: bool
) -> DataFrame:
    """The ``rank``-th value per group; ``rank`` is an expression over ``_total`` and keys."""
    sign = -1.0 if descending else 1.0
    rows = _known(df, value).select(
        *keys, (F.col(value).cast("double") * F.lit(sign)).alias("_v")
    ).withColumn("_b", value_lattice("_v"))
    buckets = rows.groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    targets = sized_broadcast(
        buckets.select(
            *keys, "_b", "_lo", "_hi",
            (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
            F.sum("_n").over(upto).alias("_upto"),
            F.sum("_n").over(group).alias("_total"),
        )
        .withColumn("_r", rank.cast("bigint"))
        .where((F.col("_r") > F.col("_before")) & (F.col("_r") <= F.col("_upto")))
        .select(*keys, "_b", "_lo", "_hi", (F.col("_r") - F.col("_before")).alias("_r"))
    )
    near = null_safe_join(rows, targets, [*keys, "_b"])
    fine = F.coalesce(
        F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 4096.0),
        F.lit(0),
    ).cast("int")
    cells = near.groupBy(*keys, "_b", "_r", fine.alias("_f"), "_v").agg(F.count("*").alias("_n"))
    ranked = prefix_sums(cells, [*keys, "_b", "_r"], "_f", "_v", ["_n"], descending=False)
    return ranked.where(
        (F.col("_r") > F.col("cum__n") - F.col("_n")) & (F.col("_r") <= F.col("cum__n"))
    ).select(*keys, (F.col("_v") * F.lit(sign)).alias(name))


def hash_parts(
    df: DataFrame,
    strata: list[str],
    ids: list[str],
    seed: int,
    cuts: list[Column],
    name: str,
    population: DataFrame | None = None,
) -> DataFrame:
    """Cut every stratum, in pseudo-random order, at exact cumulative counts.

    ``cuts`` are expressions over ``_total`` (members of the stratum) and the
    stratum columns. A row's part is the number of cuts before it. Only members
    of the hash bucket that a cut falls into are ranked; all other rows are
    labelled in the scan, so the labelled table is never shuffled.

    Members are the rows of ``population`` (for instance distinct clusters);
    by default those of ``df`` itself.
    """

    if not strata:
        # a constant that the optimiser does not fold, so joins on it stay equi-joins
        one = F.coalesce(F.substring(F.col(ids[0]).cast("string"), 1, 0), F.lit(""))
        named = None if population is None else population.withColumn("_k", one)
        return hash_parts(df.withColumn("_k", one), ["_k"], ids, seed, cuts, name, named).drop("_k")

    def keyed(table: DataFrame) -> DataFrame:
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in ids])
        return table.withColumn("_h", hash_text(ids, seed)).withColumn("_id", text)

    bucket = F.conv(F.substring("_h", 1, HASH_BUCKETS_HEX), 16, 10).cast("int")
    members = keyed(df if population is None else population).select(
        *strata, "_h", "_id", bucket.alias("_b")
    )
    group = Window.partitionBy(*strata)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = members.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    placed = counts.select(
        *strata, "_b",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(group).alias("_total"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(j).alias("j"), k.cast("bigint").alias("k"))
            for j, k in enumerate(cuts)
        ]
    )
    targets = sized_broadcast(
        placed.withColumn("_w", F.explode(wanted))
        .where((F.col("_w.k") > F.col("_before")) & (F.col("_w.k") <= F.col("_upto")))
        .select(
            *strata, "_b", F.col("_w.j").alias("_j"),
            (F.col("_w.k") - F.col("_before")).alias("_r"),
        )
    )
    ranked = null_safe_join(members, targets, [*strata, "_b"]).withColumn(
        "_rn",
        F.row_number().over(Window.partitionBy(*strata, "_b", "_j").orderBy("_h", "_id")),
    )
    edges = sized_broadcast(
        ranked.where(F.col("_rn") == F.col("_r"))
        .groupBy(*strata)
        .agg(
            *[
                F.max(F.when(F.col("_j") == j, F.struct("_h", "_id"))).alias(f"_c{j}")
                for j in range(len(cuts))
            ]
        )
    )
    labelled = null_safe_join(keyed(df), edges, strata, "left")
    here = F.struct("_h", "_id")
    part = F.lit(0)
    for j in range(len(cuts)):
        part = part + F.coalesce(here > F.col(f"_c{j}"), F.lit(True)).cast("int")
    return labelled.select(*df.columns, part.alias(name))


def hash_selections(
    df: DataFrame, keys: list[str], stratum: str, ids: list[str], plans: dict[str, tuple[int, Column]], sizes: dict[str, Column], cuts: dict[str, Column],
) -> DataFrame:
    """Exact-size pseudo-random selections of several plans at once: a boolean column per plan.

    A plan has a seed and a condition; among the rows that meet it, ``cuts[plan]`` rows of every
    (keys, stratum) are selected by their hash. Cuts may use the counts named in ``sizes``: sums
    over (keys) of the columns ``plan``, ``stratum`` and ``n`` (rows of a stratum that meet a plan's
    condition); they are returned as columns too. One grouped count of hash buckets serves all plans, and only rows of the
    buckets in which a cut falls are ranked, so exchanges do not grow with the number of plans.
    """
    if not keys:
        # a constant that the optimiser does not fold, so joins on it stay equi-joins
        one = F.coalesce(F.substring(F.col(ids[0]).cast("string"), 1, 0), F.lit(""))
        return hash_selections(df.withColumn("_all", one), ["_all"], stratum, ids, plans, sizes, cuts).drop("_all")
    names = list(plans)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ids])
    marks = [
        F.when(condition, F.struct(F.lit(i).alias("plan"), hash_text(ids, seed).alias("h"))) for i, (seed, condition) in enumerate(plans.values())
    ]
    members = df.withColumn("_x", F.explode(F.array_compact(F.array(*marks)))).select(
        *keys, stratum, text.alias("_id"), F.col("_x.plan").alias("plan"), F.col("_x.h").alias("_h"),
        F.conv(F.substring("_x.h", 1, HASH_BUCKETS_HEX), 16, 10).cast("int").alias("_b"),
    )
    counts = members.groupBy(*keys, stratum, "plan", "_b").agg(F.count("*").alias("n")).persist()
    plan_no = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, n)])
    totals = counts.groupBy(*keys, stratum, "plan").agg(F.sum("n").alias("n")).withColumn("plan", plan_no[F.col("plan")])
    known = totals.groupBy(*keys).agg(*[c.alias(n) for n, c in sizes.items()])
    upto = Window.partitionBy(*keys, stratum, "plan").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = null_safe_join(counts, sized_broadcast(known), keys).withColumn("_upto", F.sum("n").over(upto))
    cut = F.lit(None).cast("bigint")
    for i, n in enumerate(names):
        cut = F.when(F.col("plan") == i, cuts[n].cast("bigint")).otherwise(cut)
    before = F.col("_upto") - F.col("n")
    targets = placed.withColumn("_cut", cut).where((F.col("_cut") > before) & (F.col("_cut") <= F.col("_upto"))).select(
        *keys, stratum, "plan", "_b", (F.col("_cut") - before).alias("_r")
    )
    place = F.row_number().over(Window.partitionBy(*keys, stratum, "plan", "_b").orderBy("_h", "_id"))
    edges = (
        null_safe_join(members, sized_broadcast(targets), [*keys, stratum, "plan", "_b"]).withColumn("_rn", place).where(F.col("_rn") == F.col("_r"))
        .groupBy(*keys, stratum).agg(*[F.max(F.when(F.col("plan") == i, F.struct("_h", "_id"))).alias(f"_e{i}") for i in range(len(names))])
    )
    wide = null_safe_join(totals.select(*keys, stratum).distinct(), known, keys)
    wide = sized_broadcast(null_safe_join(wide, edges, [*keys, stratum], "left"))
    labelled = null_safe_join(df.withColumn("_id", text), wide, [*keys, stratum], "left")
    chosen = {
        n: condition & F.coalesce(F.struct(hash_text(ids, seed).alias("_h"), F.col("_id")) <= F.col(f"_e{i}"), F.lit(False))
        for i, (n, (seed, condition)) in enumerate(plans.items())
    }
    return labelled.select(*df.columns, *sizes, *[c.alias(n) for n, c in chosen.items()])


def even_cuts(parts: int) -> list[Column]:
    """Cumulative sizes that split a stratum into ``parts`` sizes differing by at most one."""
    base, extra = F.floor(F.col("_total") / parts), F.col("_total") % parts
    return [base * j + F.least(F.lit(j), extra) for j in range(1, parts)]
