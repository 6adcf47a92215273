"""Mixing sources to target weights by block permutations, in DataFrame operations only.

The words of each source, in a fixed order of its documents, are cut into blocks of ``BLOCK`` words.
Every output shard has ``SHARD`` slots and draws a multinomial number of slots per source, slot by
slot from a hash. A source's slots, counted over all shards, are mapped through a pseudorandom
permutation of its block numbers, a fresh one per pass over the source, and blocks are joined by
number. Draws beyond a source's share go, in order, to the sources that drew too few, so that each
source supplies exactly its target in words; its last slot takes the front of a block only.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. Together they supply
``TOTAL`` of all words; a target stops at ``MOST`` times its source's size and the excess is shared
by weight among the others. Running numbers are taken in two levels (buckets, then rows of one), so
no task holds a source. Null or empty texts have size 0 and nothing is taken from them; repeated
rows are documents of their own; no rows give no rows. All draws hash fixed values: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, register, released, table, written

BLOCK = 256
SHARD = 512
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BUCKET_ROWS = 2_000
CELLS = 4_096


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with _size, the words of the text, and _bucket and _key, a place in a fixed order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("_size", size).withColumn("_key", F.xxhash64("doc_id", "text", F.lit(1)))


def source_table(sizes: DataFrame) -> DataFrame:
    """One row per source: _s (its number), source, source_size, target, words, slots, _first_slot."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = Window.partitionBy()
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
        .withColumn("_s", F.row_number().over(by_name))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.pmod(F.col("_s") - 1, F.lit(len(WEIGHTS))) + 1))
        .withColumn("all_words", TOTAL * F.sum("source_size").over(totals))
        .withColumn("ratio", MOST * F.col("source_size") / F.col("w"))
    )
    by_ratio = Window.orderBy("ratio", "_s")
    # the level at which the sources from this one on share by weight what the capped ones leave
    level = (F.col("all_words") - F.coalesce(F.sum(MOST * F.col("source_size")).over(before(by_ratio)), F.lit(0))) / (
        F.sum("w").over(totals) - F.coalesce(F.sum("w").over(before(by_ratio)), F.lit(0.0))
    )
    shared = (
        numbered.withColumn("level", level)
        .withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "_s", "level"))).over(totals))
        .withColumn(
            "target",
            F.when(F.col("share").isNull() | (F.struct("ratio", "_s") < F.struct("share.ratio", "share._s")), MOST * F.col("source_size").cast("double"))
            .otherwise(F.col("w") * F.col("share.level")),
        )
        .withColumn("words", F.least(F.round("target").cast("long"), MOST * F.col("source_size")))
        .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
        .withColumn(
            "slots",
            F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
                F.expr("words div source_size * blocks") + F.ceil(F.expr("words % source_size") / BLOCK)
            ).cast("long"),
        )
    )
    return (
        shared.withColumn("_first_slot", F.coalesce(F.sum("slots").over(before(by_name)), F.lit(0)))
        .select("_s", "source", "source_size", "target", "words", "blocks", "slots", "_first_slot")
    )


def in_order(rows: DataFrame, group: list[str], bucket: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Running sum of ``amount`` before each row of a group: over its buckets, then inside one."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    start = F.coalesce(
        F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums.withColumn("_start", start).drop("_sum"), [*group, bucket])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_start")
    )


def found_range(rows: DataFrame, at: Column, ranges: DataFrame, lo: str, n: str, total: int) -> DataFrame:
    """Join each row with the one range [lo, lo + n) that holds ``at``, over cells of the whole."""
    cell = lambda x: F.expr("0") + (x * CELLS / max(total, 1)).cast("long")
    split = ranges.where(F.col(n) > 0).withColumn(
        "_cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(lo) + F.col(n) - 1)))
    )
    return (
        rows.withColumn("_at", at).withColumn("_cell", cell(F.col("_at"))).join(split, "_cell")
        .where((F.col("_at") >= F.col(lo)) & (F.col("_at") < F.col(lo) + F.col(n))).drop("_cell", "_at")
    )


def drawn_slots(sources: DataFrame, total: int) -> DataFrame:
    """(slot, shard, _s, j): the source of every slot, and its running number j in that source."""
    spark = sources.sparkSession
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {SHARD}").alias("shard"))
    draw = F.pmod(F.xxhash64("slot", F.lit("draw")), F.lit(max(total, 1)))
    drawn = found_range(slots, draw, sources.select("_s", "_first_slot", "slots"), "_first_slot", "slots", total)
    counted = written(in_order(drawn.withColumn("one", F.lit(1)), ["_s"], "shard", ["slot"], "one", "j"), "slots")
    released(spark)
    kept = counted.where("j < slots").select("slot", "shard", "_s", "j")
    by_source = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    missing = (
        sources.select("_s", "slots").join(kept.groupBy("_s").agg(F.count("*").alias("have")), "_s", "left")
        .withColumn("have", F.coalesce("have", F.lit(0))).withColumn("lack", F.col("slots") - F.col("have"))
        .withColumn("lack_from", F.coalesce(F.sum("lack").over(by_source), F.lit(0))).select("_s", "have", "lack", "lack_from")
    )
    spare = in_order(
        counted.where("j >= slots").select("slot", "shard", F.lit(1).alias("one"), F.lit(0).alias("g")), ["g"], "shard", ["slot"], "one", "f"
    )
    given = found_range(spare, F.col("f"), missing, "lack_from", "lack", total).select(
        "slot", "shard", "_s", (F.col("have") + F.col("f") - F.col("lack_from")).alias("j")
    )
    return kept.unionByName(given)


def permuted(i: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1: Feistel rounds on a grid of about sqrt(n) a side,
    walked again while they lead outside (at most the grid's excess, below its side)."""
    side = F.ceil(F.sqrt(n)).cast("long")
    height = F.ceil(n / side).cast("long")

    # a round names its input once: written out, the rounds double from one to the next
    def one(s: Column, r: Column) -> Column:
        a = F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], r, *salt), height), height)
        return F.struct(a.alias("a"), F.pmod(s["b"] + F.pmod(F.xxhash64(a, r + 1, *salt), side), side).alias("b"))

    def rounds(x: Column) -> Column:
        start = F.struct(F.floor(x / side).cast("long").alias("a"), F.pmod(x, side).alias("b"))
        return F.aggregate(F.array(F.lit(0), F.lit(2), F.lit(4)), start, one, lambda s: s["a"] * side + s["b"])

    once = rounds(i)
    again = F.aggregate(F.sequence(F.lit(1).cast("long"), side + 1), once, lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when(n <= 1, i).when(once < n, once).otherwise(again)


def block_uses(sources: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, shard, _s, epoch, block, n): the block of each slot and the words taken from its front."""
    facts = sources.select("_s", "source_size", "words", "blocks")
    at = slots.join(facts, "_s").withColumn("epoch", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    full = F.expr(f"source_size div {BLOCK}")
    return (
        at.withColumn("block", F.when(F.col("i") < full, permuted(F.col("i"), full, F.col("_s"), F.col("epoch"))).otherwise(F.col("i")))
        .withColumn("n", F.least(
            F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK,
            F.col("words") - F.col("epoch") * F.col("source_size") - F.col("i") * BLOCK,
        ))
        .select("slot", "shard", "_s", "epoch", "block", "n")
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, documents, spans).

    ``documents``: doc_id, _s, _size, _key, _from (first word's number in the source).
    ``spans``: per slot and document (_s, _from, shard, slot, epoch, lo, n): the words lo .. lo+n-1
    of the document, in the order of the output.
    """
    sizes = written(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "_size", "_key"), "sizes")
    sources = written(source_table(sizes), "sources")
    facts = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    known = sources.select("_s", F.col("source").alias("_name"))
    placed = in_order(
        sizes.join(known, F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "source")
        .withColumn("_bucket", F.pmod("_key", F.lit(buckets))),
        ["_s"], "_bucket", ["_key", "doc_id", "_size"], "_size", "_from",
    )
    placed = written(placed.select("doc_id", "_s", "_size", "_key", "_from"), "placed")
    released(docs.sparkSession)
    uses = block_uses(sources, drawn_slots(sources, int(facts["slots"])))
    parts = (
        placed.where("_size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"_from div {BLOCK}"), F.expr(f"(_from + _size - 1) div {BLOCK}"))))
        .select("_s", "_from", "block", F.greatest(F.lit(0), F.col("_from") - F.col("block") * BLOCK).alias("b_lo"),
                F.least(F.lit(BLOCK), F.col("_from") + F.col("_size") - F.col("block") * BLOCK).alias("b_hi"))
    )
    spans = (
        uses.join(parts, ["_s", "block"]).withColumn("n", F.least("n", "b_hi") - F.col("b_lo")).where("n > 0")
        .select("_s", "_from", "shard", "slot", "epoch", (F.col("block") * BLOCK + F.col("b_lo") - F.col("_from")).alias("lo"), "n")
    )
    return sources, placed, spans


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``."""
    sources, placed, spans = mix(docs)
    taken = spans.groupBy("_s", "_from").agg(F.sum("n").alias("taken"))
    full = placed.where("_size > 0").join(taken, ["_s", "_from"], "left").unionByName(
        placed.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    )
    return full.join(sources.select("_s", "source_size", "target"), "_s").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: per document and pass the words it gives, joined by one space.

    A text given whole stays as it is; documents of which nothing is taken do not occur.
    """
    _, placed, spans = mix(docs)
    pieces = spans.groupBy("_s", "_from", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "n"))).alias("_pieces"))
    given = placed.where("_size > 0").withColumn("_twin", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("_from"))).join(
        pieces, ["_s", "_from"]
    )
    # equal rows are told apart by a running number on both sides
    own = sized(docs).withColumn("_twin", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.col("source").asc_nulls_last())))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    joined = given.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("_twin").alias("_t"), "epoch", "_pieces")
    both = own.join(joined, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")) & (F.col("_twin") == F.col("_t")))
    all_of_it = F.aggregate("_pieces", F.lit(0).cast("long"), lambda s, p: s + p["n"]) == F.col("_size")
    some = F.array_join(
        F.flatten(F.transform("_pieces", lambda p: F.slice(words, (p["lo"] + 1).cast("int"), p["n"].cast("int")))), " "
    )
    text = F.when(all_of_it, F.col("text")).otherwise(some)
    result = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return result.select(*docs.columns)


@register("op4_mixed_sources")
def op4(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents"))
