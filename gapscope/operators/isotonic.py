"""Keyed isotonic regression: pool-adjacent-violators in levels, all keys in one job.

Scores are summed per (key, score), dealt to ranges of the score order, and pooled within each range;
the blocks left of neighbouring ranges are pooled together, and what remains of a key once more. A
pooled range of n labelled rows leaves at most about n^(2/3) blocks, since their means are growing
fractions with small denominators, so the last level meets few rows. The result is the exact
isotonic fit: pooling is the same in whatever order neighbours are merged.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct scores of a range, and ranges whose blocks meet in the second level.
RANGE_ROWS = 200_000
FAN = 32
#: Blocks of all keys together that a map may hold where it is sent to every task.
MAX_BLOCKS = 5_000_000

BLOCK = "lo double, hi double, total double, weight double"


def pooled(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """Blocks of growing mean from runs in score order; equal means are one block."""
    out: list[list[float]] = []
    for a, b, s, w in zip(lo.tolist(), hi.tolist(), total.tolist(), weight.tolist()):
        block = [a, b, s, w]
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return out


def _pooler(n_keys: int):
    """Pools the rows of a task, which come sorted by key and score."""

    def pool(batches):
        for batch in _joined(batches):
            names = batch.schema.names
            columns = [c.to_pylist() for c in batch.columns[:n_keys]]
            numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns[n_keys:]]
            start, keys, blocks = 0, [], []
            for key, run in groupby(zip(*columns) if columns else ((),) * batch.num_rows):
                end = start + sum(1 for _ in run)
                found = pooled(*(x[start:end] for x in numbers))
                keys += [key] * len(found)
                blocks += found
                start = end
            arrays = [pa.array([k[i] for k in keys], batch.schema.field(i).type) for i in range(n_keys)]
            arrays += [pa.array([b[i] for b in blocks], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pool


def _joined(batches):
    """All batches of a task as one."""
    found = [b for b in batches if b.num_rows]
    if found:
        yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]


def fit(df: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Blocks of the isotonic fit of ``label`` on ``score``: keys, lo, hi, value, weight.

    Rows whose score or label is NULL (or a score of NaN) take no part; a key without rows has no
    blocks.
    """
    x, w = F.col(score).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = (
        df.where(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull())
        .groupBy(*keys, x.alias("lo")).agg(F.sum(F.col(label).cast("double") * w).alias("total"), F.sum(w).alias("weight"))
    )
    cells = cells.where("weight > 0").select(*keys, "lo", F.col("lo").alias("hi"), "total", "weight").persist()
    fields = [cells.schema[k] for k in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL(BLOCK).fields])
    ranges = -(-cells.count() // RANGE_ROWS)
    blocks, pool = cells, _pooler(len(keys))
    while ranges > 1:
        dealt = blocks.repartitionByRange(ranges, *keys, "lo").sortWithinPartitions(*keys, "lo")
        blocks = dealt.mapInArrow(pool, schema)
        ranges = ranges // FAN
    last = blocks.repartition(*keys) if keys else blocks.coalesce(1)
    final = last.sortWithinPartitions(*keys, "lo").mapInArrow(pool, schema)
    return final.select(*keys, "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")


def mapped(df: DataFrame, keys: list[str], score: str, blocks: DataFrame, out: str) -> DataFrame:
    """``df`` with the fit's value at each score: linear between blocks, level inside and beyond them.

    NULL where the row's key has no blocks or its score is NULL.
    """
    rows = blocks.select(*keys, "lo", "hi", "value").limit(MAX_BLOCKS + 1).collect()
    if len(rows) > MAX_BLOCKS:
        raise ValueError(f"isotonic maps of more than {MAX_BLOCKS} blocks; map fewer keys at a time")
    found: dict[tuple, list] = {}
    for r in sorted(rows, key=lambda r: r["lo"]):
        found.setdefault(tuple(r[k] for k in keys), []).extend([(r["lo"], r["value"]), (r["hi"], r["value"])])
    maps = {k: tuple(np.array(v).T) for k, v in found.items()}
    sent = df.sparkSession.sparkContext.broadcast(maps)
    place = {c: i for i, c in enumerate(df.columns)}
    at, n = [place[k] for k in keys], place[score]

    def look_up(batches):
        for batch in batches:
            x = batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
            value = np.full(len(x), np.nan)
            own = list(zip(*[batch.column(i).to_pylist() for i in at])) if at else [()] * len(x)
            index: dict[tuple, list[int]] = {}
            for i, k in enumerate(own):
                index.setdefault(k, []).append(i)
            for k, where in index.items():
                if k in sent.value:
                    value[where] = np.interp(x[where], *sent.value[k])
            column = pa.array(value, mask=np.isnan(value) | np.isnan(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return df.mapInArrow(look_up, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))
