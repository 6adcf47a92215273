"""Exact Jaccard join of documents by word n-grams, filtered under several global token orders.

Tokens are 64-bit hashes of n consecutive words. Two sets of sizes a and b with Jaccard similarity
of t or more differ from each other, seen from the first one, in at most ``a - ceil(t * a)`` tokens.
Every filter below follows from that and loses no pair:

1. *Equal sets* are one class, by fingerprint; members are linked without being compared.
2. *Rare-first order* over fixed slices of the hash range. A token of a slice that no other
   document holds is missing everywhere, so a document with more such tokens than its allowance has
   no partner. One grouped count a slice settles most documents; the slices are counted one after
   the other, so that only one slice's tokens are on disk at a time. The classes left are counted
   again among themselves, over the whole range, before their sets are made.
3. *Rare-first order over all tokens* of the classes left. Partners meet in a list of their prefixes,
   and neither may share fewer tokens with all others than the pair must have in common.
4. *Two hash orders*: a candidate pair must share a prefix token under each of them before its sets
   are intersected.

Posting lists are never expanded into all their pairs. Each list is compared with a pivot first
(a star): the class whose tokens are the most common, then random ones. Links are contracted to
components, and only lists that still hold several components are opened, joining what lies outside a list's main component with the list. Empty and null texts
have no tokens and link with nothing; a text of fewer than n words is one token; equal rows link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, register, released, row_keyed, table, written
from .textops import Words, mix, span_hash, word_slices, WORD_BASE

#: Bounds of the slices of the hash range in which tokens are counted over the whole corpus.
SLICES = (0.0, 0.2, 0.4, 0.6)
#: And those for the classes that this leaves: the whole range.
REST = (0.0, 0.5, 1.0)
#: Up to this many row numbers go to the texts; of more of them the texts are shuffled.
SENT_ROWS = 1 << 18
ORDER_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def token_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each document."""
    hashes = words.hashes()
    grams = words.grams(hashes, n)
    at = words.doc_words
    for i in range(words.docs):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= n:
            found = np.sort(grams[lo : hi - n + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif hi > lo:
            yield span_hash(hashes[lo:hi], np.array([0]), np.array([hi - lo]), WORD_BASE)
        else:
            yield grams[:0]


def allowance(size: np.ndarray | int, percent: int):
    """Most tokens of a set that a partner may lack."""
    return size - (-(-size * percent // 100))


def _fingerprint(tokens: np.ndarray) -> int:
    total = np.array([tokens.sum(dtype=np.uint64), np.uint64(len(tokens))])
    return int(mix(mix(total[:1]) + total[1:])[0].astype(np.int64))


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """One row per document: set size and fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints = [], []
            for words in word_slices(batch.column(1), lower=True):
                for s in token_sets(words, n):
                    sizes.append(len(s))
                    prints.append(_fingerprint(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())], names=["_row", "size", "class"]
            )

    return docs.select("_row", "text").mapInArrow(scan, "_row long, size long, class long")


def slice_tokens(docs: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    """(token, _row) for the tokens whose hash lies in the slice [lo, hi) of the range.

    Their first 48 bits only, to shuffle less: tokens that agree in these count as shared, so the
    filter keeps a document too many, never one too few.
    """
    bounds = np.array([int(lo * 2**64), min(int(hi * 2**64), 2**64 - 1)], dtype=np.uint64)

    def scan(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for words in word_slices(batch.column(1), lower=True, size=1 << 18):
                found = [s[slice(*np.searchsorted(s, bounds))] for s in token_sets(words, n)]
                owner = np.repeat(rows[words.first : words.first + words.docs], [len(x) for x in found])
                tokens = (np.concatenate(found) >> np.uint64(16)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owner)], names=["token", "_row"])

    return docs.select("_row", "text").mapInArrow(scan, "token long, _row long")


def missing_tokens(docs: DataFrame, n: int, slices: tuple[float, ...]) -> DataFrame:
    """(_row, missing): the tokens of a document, of those in the slices, that no other document holds."""
    found = None
    for lo, hi in zip(slices, slices[1:]):
        alone = (
            slice_tokens(docs, n, lo, hi).groupBy("token")
            .agg(F.count("*").alias("n"), F.min("_row").alias("_row")).where("n = 1")
            .groupBy("_row").agg(F.count("*").alias("missing"))
        )
        part = written(alone, "missing")
        released(docs.sparkSession)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("_row").agg(F.sum("missing").alias("missing"))


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(_row, text) of the given rows, a written table."""
    rows = rows.select("_row")
    return docs.select("_row", "text").join(F.broadcast(rows) if rows.count() <= SENT_ROWS else rows, "_row")


def class_sets(docs: DataFrame, n: int) -> DataFrame:
    """(class, size, tokens): the sorted set of each given document as packed 64-bit values."""

    def scan(batches):
        for batch in batches:
            for words in word_slices(batch.column(1), lower=True, size=1 << 18):
                found = list(token_sets(words, n))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, words.docs),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([x.tobytes() for x in found], pa.binary()),
                    ],
                    names=["class", "size", "tokens"],
                )

    return docs.select("class", "text").mapInArrow(scan, "class long, size long, tokens binary")


def postings_of(sets: DataFrame) -> DataFrame:
    """(token, class, size): one row per token of each set."""

    def scan(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            tokens = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(2)]
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens)),
                        pa.array(np.repeat(batch.column(0).to_numpy(), sizes)),
                        pa.array(np.repeat(sizes, sizes)),
                    ],
                    names=["token", "class", "size"],
                )

    return sets.mapInArrow(scan, "token long, class long, size long")


def candidate_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(token, class, size, shared, rank, centre): posting lists such that similar classes meet in one.

    ``centre`` is the mean logarithm of the counts of a class's tokens: of a family of edited copies
    the text that they were made from has the most. The order is rare-first by the exact count among these classes. A token that no other class
    holds is missing from every partner; of the ``shared`` others a partner may lack what is left
    of the allowance, so one of that many and one more of the rarest is in both prefixes.
    """
    allowed = f"(size - ceil(size * {percent} / 100))"
    raw = postings_of(sets)
    counts = raw.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    by_class = Window.partitionBy("class")
    return (
        raw.join(counts, "token")
        .withColumn("rank", F.row_number().over(by_class.orderBy("n", "token")))
        .withColumn("shared", F.count("*").over(by_class))
        .withColumn("centre", F.sum(F.ln("n")).over(by_class) / F.col("size"))
        .where(f"rank <= {allowed} - (size - shared) + 1")
        .select("token", "class", "size", "shared", "rank", "centre")
    )


def _prefix(tokens: np.ndarray, seed: int, keep: int) -> np.ndarray:
    ranks = mix(tokens ^ np.uint64(seed))
    return np.partition(ranks, keep - 1)[:keep]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the similarity.

    The pairs are written first, so that Spark knows how few they are and only the sets they name
    are shuffled.
    """
    pairs = written(pairs, "pairs")
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "named")
    sets = sets.join(named, "class", "left_semi")
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                t = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                ks, kt = allowance(len(s), percent) + 1, allowance(len(t), percent) + 1
                shares = all(
                    len(np.intersect1d(_prefix(s, o, ks), _prefix(t, o, kt), assume_unique=True)) for o in ORDER_SEEDS
                )
                if shares:
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(s) + len(t) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"]
            )

    return both.mapInArrow(check, "a long, b long")


def _labelled(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return postings.withColumn("root", F.col("class"))
    return postings.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )


def class_links(sets: DataFrame, percent: int, stars: int = 3, tries: int = 3) -> DataFrame:
    """Links (a, b) between classes that connect exactly what all similar pairs connect."""
    # at a pair's first common token nothing before it is common, so what is left must be enough
    possible = f"(100 + {percent}) * (1 + least(shared - rank, x.shared - x.rank)) >= {percent} * (size + x.size)"
    postings = written(candidate_lists(sets, percent), "postings")
    released(sets.sparkSession)
    links = roots = None
    for star in range(stars):
        # first the most central class of each list is its pivot, then ``tries`` random ones, new
        # ones each time; a class is held against those that it meets in most of its lists
        rows = _labelled(postings, roots)
        fields = ["class", "size", "shared", "rank", "root"]
        heads = [F.struct((-F.col("centre")).alias("h"), *fields)] if star == 0 else [
            F.struct(F.xxhash64("class", F.lit(star * tries + i)).cast("double").alias("h"), *fields) for i in range(tries)
        ]
        pivots = (
            rows.groupBy("token")
            .agg(F.array(*[F.min(h) for h in heads]).alias("xs"), F.min("root").alias("lo"), F.max("root").alias("hi"))
            .where("lo <> hi").select("token", F.explode(F.array_distinct("xs")).alias("x"))
        )
        best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
        pairs = (
            rows.join(pivots, "token").where(f"root <> x.root and {possible}")
            .groupBy(F.col("class").alias("a"), F.col("x.class").alias("b")).agg(F.count("*").alias("n"))
            .withColumn("r", F.row_number().over(best)).where(F.col("r") <= tries).select("a", "b")
        )
        new = written(verified(pairs, sets, percent), "links")
        released(sets.sparkSession)
        if not new.limit(1).count():
            break
        links = new if links is None else links.unionByName(new)
        roots = written(components(links), "roots")
    rows = _labelled(postings, roots)
    spread = (
        rows.groupBy("token", "root").agg(F.count("*").alias("n"))
        .groupBy("token").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
        .where("roots > 1").select("token", F.col("main.root").alias("main"))
    )
    opened = written(rows.join(spread, "token"), "opened")
    released(sets.sparkSession)
    outside = opened.where("root <> main").select("token", F.struct("class", "size", "shared", "rank", "root").alias("x"))
    pairs = (
        outside.join(opened, "token")
        .where(f"root <> x.root and (root = main or class > x.class) and {possible}")
        .select(F.least("class", "x.class").alias("a"), F.greatest("class", "x.class").alias("b")).distinct()
    )
    last = verified(pairs, sets, percent)
    return last if links is None else links.unionByName(last)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, slices: tuple[float, ...] = SLICES) -> DataFrame:
    """``docs`` (with a unique long ``_row`` and ``text``) -> (_row, size, class, root).

    ``root`` numbers the connected group of similar documents (the smallest ``_row`` in it); documents
    without tokens have null class and root. Classes are joined under the ``_row`` of their first
    member: row numbers take fewer bytes of a shuffle than fingerprints do.
    """
    profile = written(profiles(docs, n), "profiles")
    alone = missing_tokens(docs, n, slices)
    possible = f"coalesce(missing, 0) <= size - ceil(size * {percent} / 100)"
    alive = written(
        profile.join(alone, "_row", "left").where(f"size > 0 and {possible}")
        .groupBy("class").agg(F.min("_row").alias("_row"), F.first("size").alias("size")),
        "alive",
    )
    released(docs.sparkSession)
    first = written(texts_of(docs, alive), "first")
    released(docs.sparkSession)
    near = written(alive.join(missing_tokens(first, n, REST), "_row", "left").where(possible), "near")
    sets = written(class_sets(texts_of(first, near).withColumnRenamed("_row", "class"), n), "sets")
    released(docs.sparkSession)
    linked = components(class_links(sets, percent)).withColumnRenamed("node", "_row")
    roots = alive.join(linked, "_row", "left").select("class", F.coalesce("root", "_row").alias("root"))
    # a class that is not alive holds a token of its own, so it has one row
    return (
        profile.join(roots, "class", "left")
        .select("_row", "size", "class", F.expr("if(class is null, null, coalesce(root, _row))").alias("root"))
    )


def near_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` plus n_shingles and component_id (smallest doc_id of the group, itself included)."""
    keyed = row_keyed(docs.select("doc_id", "text"))
    groups = near_groups(keyed, n, percent)
    ids = keyed.select("_row", "doc_id").join(groups, "_row")
    least = ids.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return ids.join(least, "root", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "class", "_row"
    )


GROUPS_SQL = r"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w from documents),
x as (select doc_id, len(w) m, unnest(range(1, len(w) + 1)) i, unnest(w) x from w),
t as (select distinct doc_id, t from (select doc_id, case when m >= 5 then x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' '
    || lead(x, 3) over o || ' ' || lead(x, 4) over o when i = 1 then string_agg(x, ' ') over (partition by doc_id) end t from x
    window o as (partition by doc_id order by i)) q where t is not null),
n as (select w.doc_id, count(t)::bigint n from w left join t on w.doc_id = t.doc_id group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id a, doc_id b from n union select r.a, e.b from r join e on r.b = e.a)
select doc_id, n n_shingles, component_id from n join (select a doc_id, min(b) component_id from r group by a) g using (doc_id)"""


@register("op9_ngram_jaccard_join", GROUPS_SQL)
def op9(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
