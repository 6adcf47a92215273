"""Removal of long repeated word spans through a compacted de Bruijn graph of sampled k-mers.

A *window* is ``WINDOW`` consecutive words of one text; a word goes if a window that covers it has a
word sequence that starts anywhere else, the same text included.

Nodes are the k-mers that are the smallest hash of some window (so equal windows hold equal nodes at
equal places), edges the word sequences from one node of a text to its next. A node is *interior* if
it occurs twice or more and always between the same two edges. Chains of interior nodes are
compacted by pointer doubling over Spark joins; a chain occurs as a whole wherever its first node
does, which gives its source coordinates, and every window inside it that holds none of its two end
nodes is repeated. Only windows near a branching, where sources part, are compared one by one, by
the hash of their words; windows whose node occurs once are unique and never leave the scan.

Null text has no words. A text of fewer words than a window keeps them all. Repeated rows repeat
each other's windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import register, row_keyed, table, written
from .textops import WORD_BASE, Words, buffers, mix, span_hash, word_slices

WINDOW = 35
K = 10


def anchors(words: Words, hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-mer hashes, window starts, and the place of the smallest k-mer (leftmost) of each window."""
    grams = words.grams(hashes, k)
    starts = np.flatnonzero(words.whole(window))
    if not len(starts):
        return grams, starts, starts
    view = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1)
    return grams, starts, starts + view[starts].argmin(axis=1)


def node_rows(docs: DataFrame, window: int, k: int, places: bool) -> DataFrame:
    """A row per node occurrence: its place, or its surroundings for the graph."""

    def scan(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for words in word_slices(batch.column(1)):
                hashes = words.hashes()
                grams, _, least = anchors(words, hashes, window, k)
                at = np.unique(least)
                if not len(at):
                    continue
                doc = words.doc_of_word()[at]
                node = pa.array(grams[at].view(np.int64))
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [node, pa.array(rows[words.first + doc]), pa.array(at - words.doc_words[doc])], names=["node", "_row", "at"]
                    )
                    continue
                joined = np.flatnonzero(doc[1:] == doc[:-1])  # edges from node i to i + 1
                edge = span_hash(hashes, at[joined], at[joined + 1] + k, WORD_BASE)
                into, out = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                has_in, has_out = np.zeros(len(at), bool), np.zeros(len(at), bool)
                into[joined + 1], out[joined], has_in[joined + 1], has_out[joined] = edge, edge, True, True
                open_end = ~(has_in & has_out)
                left, right = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
                left[1:], right[:-1] = np.diff(at), np.diff(at)
                after = np.zeros(len(at), np.uint64)
                after[:-1] = grams[at][1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        node, pa.array(mix(mix(into) + out).view(np.int64), mask=open_end),
                        pa.array(after.view(np.int64), mask=open_end), pa.array(left, mask=open_end), pa.array(right, mask=open_end),
                    ],
                    names=["node", "context", "after", "left", "right"],
                )

    schema = "node long, _row long, at long" if places else "node long, context long, after long, left int, right int"
    return docs.select("_row", "text").mapInArrow(scan, schema)


def repeated_nodes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Nodes found twice or more; ``after`` is null unless the node is interior."""
    return written(
        node_rows(docs, window, k, places=False).groupBy("node")
        .agg(F.count("*").alias("n"), F.count("context").alias("inner"), F.min("context").alias("lo"),
             F.max("context").alias("hi"), *[F.min(c).alias(c) for c in ("after", "left", "right")])
        .where("n > 1")
        .select("node", "n", *[F.when((F.col("inner") == F.col("n")) & (F.col("lo") == F.col("hi")), F.col(c)).alias(c)
                               for c in ("after", "left", "right")]),
        "nodes",
    )


def compacted(nodes: DataFrame) -> DataFrame:
    """(node, left, length): first node of each chain, words back to the end node before it, and
    words from there to the end node after the chain."""
    interior = nodes.where("after is not null")
    inside = interior.select(F.col("node").alias("after"), F.lit(True).alias("goes_on"))
    state = written(
        interior.join(inside, "after", "left")
        .select("node", F.when(F.col("goes_on"), F.col("after")).alias("next"), F.col("right").cast("long").alias("length")),
        "chains",
    )
    first = interior.join(state.where("next is not null").select(F.col("next").alias("node")).distinct(), "node", "left_anti")
    while state.where("next is not null").limit(1).count():
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("then"), F.col("length").alias("more"))
        state = written(
            state.join(ahead, "next", "left")
            .select("node", F.col("then").alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")),
            "chains",
        )
    return first.select("node", F.col("left").cast("long").alias("left")).join(state.select("node", "length"), "node").select(
        "node", "left", (F.col("left") + F.col("length")).alias("length")
    )


def squeezed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed, for the shuffles."""

    def scan(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            offsets, raw = buffers(batch.column(1))
            data = memoryview(raw)
            small = [squeeze.compress(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["_row", "packed"])

    return docs.select("_row", "text").mapInArrow(scan, "_row long, packed binary")


def unsqueezed(column: pa.Array, step: int = 500) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a compressed column, a few hundred at a time, with the first one's number."""
    expand = zstandard.ZstdDecompressor()
    for i in range(0, len(column), step):
        part = [expand.decompress(x.as_buffer()) if x.as_buffer().size else b"" for x in column.slice(i, step)]
        yield i, pa.array(part, pa.large_binary()).cast(pa.large_string())


def marks_of(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place in the slice, length) of the marks of its documents."""
    part = column.slice(words.first, words.docs)
    sizes = np.diff(np.asarray(part.offsets))
    inner = part.flatten()
    at, length = (np.asarray(inner.field(i), dtype=np.int64) for i in (0, 1))
    return at + np.repeat(words.doc_words[:-1], sizes), length


def _slices(column: pa.Array) -> Iterator[Words]:
    for first, texts in unsqueezed(column):
        for words in word_slices(texts):
            words.first += first
            yield words


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta)[:n] > 0


def repeated_windows(marked: DataFrame, window: int, k: int) -> DataFrame:
    """(_row, window, at, n): windows to compare (n: times in the text), or with null ``window`` a
    range of n words known to be repeated."""

    def scan(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for words in _slices(batch.column(1)):
                hashes = words.hashes()
                _, starts, least = anchors(words, hashes, window, k)
                at, length = marks_of(batch.column(2), words)
                total = len(hashes)
                lone, chain = at[length == 0], length > 0
                u, v = at[chain], at[chain] + length[chain]
                repeated = cover(total, u + 1, v)
                repeated[lone] = True
                sure_from, sure_to = u + 1, v + k - 1
                long_enough = sure_to - sure_from >= window
                sure_from, sure_to = sure_from[long_enough], sure_to[long_enough]
                sure = cover(total, sure_from, sure_to - window + 1)
                pick = repeated[least] & ~sure[starts]
                starts = starts[pick]
                doc = words.doc_of_word()
                keys = words.grams(hashes, window)[starts]
                _, first, inverse, n = np.unique(
                    keys ^ mix(doc[starts].astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True
                )
                own = starts[n[inverse] > 1]
                gone = cover(total, np.concatenate((sure_from, own)), np.concatenate((sure_to, own + window)))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                a, b = edges[::2], edges[1::2]  # may run over several documents; cut at their bounds
                cuts = np.unique(np.concatenate((a, words.doc_words[:-1][gone[np.minimum(words.doc_words[:-1], max(total - 1, 0))]] if total else a)))
                stops = np.minimum(b[np.searchsorted(a, cuts, side="right") - 1], words.doc_words[1:][doc[cuts]]) if len(cuts) else cuts
                places = np.concatenate((starts[first], cuts))
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[words.first + doc[places]]),
                        pa.array(np.concatenate((keys[first].view(np.int64), np.zeros(len(cuts), np.int64))), mask=np.arange(len(places)) >= m),
                        pa.array(places - words.doc_words[doc[places]]),
                        pa.array(np.concatenate((n, stops - cuts))),
                    ],
                    names=["_row", "window", "at", "n"],
                )

    return marked.select("_row", "packed", "marks").mapInArrow(scan, "_row long, window long, at long, n long")


def removal_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(_row, spans): word ranges (at, n) to remove, for every text that has any."""
    nodes = repeated_nodes(docs, window, k)
    heads = compacted(nodes)
    places = heads.unionByName(
        nodes.where("after is null").select("node", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("length"))
    )
    marks = (
        node_rows(docs, window, k, places=True).join(places, "node")
        .groupBy("_row").agg(F.collect_list(F.struct((F.col("at") - F.col("left")).alias("at"), "length")).alias("marks"))
    )
    found = written(repeated_windows(squeezed(docs).join(marks, "_row"), window, k), "windows")
    compare = found.where("window is not null")
    twice = compare.groupBy("window").agg(F.sum("n").alias("times")).where("times > 1").select("window")
    spans = compare.join(twice, "window").select("_row", "at", F.lit(window).cast("long").alias("n")).unionByName(
        found.where("window is null").select("_row", "at", "n")
    )
    return spans.groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with ``texts`` the kept words) per row."""
    keyed = row_keyed(docs.select("doc_id", "text"))
    spans = removal_spans(keyed, window, k)
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")
    ids = keyed.select("_row", "doc_id")
    both = squeezed(keyed).join(spans, "_row", "left").select("_row", "packed", F.coalesce("spans", none).alias("spans"))

    def scan(batches):
        for batch in batches:
            for words in _slices(batch.column(1)):
                at, n = marks_of(batch.column(2), words)
                gone = cover(len(words.starts), at, at + n)
                removed = np.concatenate(([0], np.cumsum(gone)))
                data = np.append(words.data, np.uint8(0x20))
                lengths = (words.ends - words.starts + 1)[~gone]
                stops = np.cumsum(lengths)
                index = np.arange(stops[-1] if len(stops) else 0) + np.repeat(words.starts[~gone] - (stops - lengths), lengths)
                out = data[index]
                out[stops - 1] = 0x20
                ends = np.concatenate(([0], stops))
                kept_at = ends[words.doc_words - removed[words.doc_words]]
                blocks = [out[a : b - 1].tobytes() if b > a else b"" for a, b in zip(kept_at, kept_at[1:])]
                columns = [
                    batch.column(0).slice(words.first, words.docs), pa.array(words.counts()),
                    pa.array(removed[words.doc_words[1:]] - removed[words.doc_words[:-1]]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in blocks]),
                ]
                names = ["_row", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    columns, names = [*columns, pa.array([x.decode() for x in blocks])], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "_row long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return ids.join(both.mapInArrow(scan, schema), "_row").drop("_row")


REPEATS_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, len(w) n, unnest(range(1, len(w) + 1)) i, unnest(w) x from d),
m as (select doc_id, i, x, case when i + 34 <= n then string_agg(x, ' ') over (
  partition by doc_id order by i rows between current row and 34 following) end span from p),
q as (select doc_id, i, x, span is not null and count(*) over (partition by span) > 1 again from m),
c as (select doc_id, i, x, max(again::int) over (partition by doc_id order by i rows between 34 preceding and current row) = 1 gone from q),
g as (select doc_id, count_if(gone)::bigint n_removed, string_agg(x, ' ' order by i) filter (not gone) kept from c group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join g using (doc_id)"""


@register("op6_de_bruijn_substring_dedup", REPEATS_SQL)
def op6(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"))
