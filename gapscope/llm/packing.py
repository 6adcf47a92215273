"""Hierarchical residual packing of token pieces into sequences by best fit.

Every document becomes its token ids and an end id; one longer than a sequence is cut so that only
its first piece is shorter. Pieces are dealt to leaves by a hash of their row number. A leaf packs
its pieces by best fit in decreasing order and emits the bins that are nearly full; the pieces of
underfull bins move up, where at most ``FAN`` leaves merge into one, and are packed again. A level
has as many nodes as its pieces need, so a task never holds more than about ``LEAF`` of them. The
last level emits everything: one node, or where pieces fill no bins together, the level that leaves
over nine tenths of its nodes. A level writes its bins, so a lost executor repeats one level's tasks
only.

Null text is the empty text: one piece with only the end id. Rows are packed one by one, so repeated
rows (and rows without doc_id) are packed as often as they occur. No rows give no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import arrow_batches, register, table, written

END = 2
LENGTH = 1024
LEAF = 20_000
FAN = 8
#: A bin is nearly full from this share on.
FULL = 0.98
VOCABULARY = "byte_bpe_50k.json"


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def scan(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            ids, found = batch.column(0).cast(pa.int64()), []
            for i, tokens in enumerate(encode(batch.column(1))):
                tokens = np.append(tokens, np.uint32(end)).astype("<u4")
                first = len(tokens) % length or length
                cuts = [0, *range(first, len(tokens) + 1, length)] if len(tokens) > length else [0, len(tokens)]
                found += [(i, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                if len(found) >= 50_000:
                    yield _rows(ids, found)
                    found = []
            if found:
                yield _rows(ids, found)

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def _rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    at, piece, start, length, crc = zip(*found)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(at)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
        names=["doc_id", "piece", "start", "length", "ids_crc32"],
    )


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item: decreasing best fit, an open bin of least sufficient room first."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # rooms with open bins, sorted
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        else:
            room, b = size, count
            count += 1
        bins[i] = b
        if left := room - n:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


def _filler(size: int, full: float, level: int, last: bool):
    """Packs one node: adds sequence_id, offset and whether the bin is emitted here."""

    def fill(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("_item").drop_columns(["_node"])
        lengths = part["length"].to_numpy()
        bins = best_fit(lengths, size)
        used = np.bincount(bins, weights=lengths)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = np.concatenate(([0], np.cumsum(used)[:-1])).astype(np.int64)
        offset = np.empty_like(lengths)
        offset[order] = ends - lengths[order] - starts[bins[order]]
        sequence = (level << 56) | (key[0].as_py() << 24) | bins
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_done", last | (used[bins] >= full * size))):
            part = part.append_column(name, pa.array(values))
        return part

    return fill


def pack(items: DataFrame, size: int = LENGTH, leaf: int = LEAF, fan: int = FAN, full: float = FULL) -> DataFrame:
    """``items`` (with ``length`` up to ``size``) plus sequence_id and offset.

    ``sequence_id`` joins the level, the node and the bin's number in it.
    """
    columns = items.columns
    with arrow_batches(items.sparkSession):  # whole texts cross to Python here
        left = written(items.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    nodes = max(1, -(-left.count() // leaf))
    done, level = [], 0
    schema = left.withColumns(
        {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "_done": F.lit(True)}
    ).schema
    while True:
        last = nodes == 1
        node = F.pmod(F.xxhash64("_item"), F.lit(nodes)).cast("int")
        fill = _filler(size, full, level, last)
        packed = written(
            left.select(*columns, "_item").withColumn("_node", node).groupBy("_node").applyInArrow(fill, schema), "bins"
        )
        left = packed.where("not _done")
        fewer = 1 if last else max(-(-nodes // fan), -(-left.count() // leaf))
        if last or 10 * fewer > 9 * nodes:  # more levels would pack the same pieces alike
            done.append(packed)
            break
        done.append(packed.where("_done"))
        nodes, level = fewer, level + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.drop("_item", "_done")


@register("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), VOCABULARY))
