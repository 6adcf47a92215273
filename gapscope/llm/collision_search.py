"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Largest inner product becomes smallest distance by one more coordinate: x -> (x, sqrt(M^2 - |x|^2)),
q -> (q, 0) scaled to length M, with M the largest length among vectors of like length: a block keeps
an index for every octave of lengths, since beside one long vector all others would look alike, and
each is searched. Every vector is projected on ``PROJECTIONS`` random lines and an index keeps one
sorted array per line. A query
opens a window centred on its own projection in every array and widens all of them by the same
factor (virtual rehashing), until enough vectors have collided with it in ``THRESHOLD`` of the
arrays; all those vectors are then verified by their exact inner product.

Index blocks hold about ``BLOCK`` rows each, whatever the table's size; every query block meets
every index block, and the blocks' best lists are merged. All rows are indexed. Vectors that are
null, zero, or hold null or non-finite components take no part; vectors of different lengths are
never compared; repeated rows are rows of their own, and a query skips its own row only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import register, table

PROJECTIONS = 64
THRESHOLD = 0.7
START = 0.7  # half width of a block's first windows, in standard deviations of the projections
GROWTH = 1.06
#: Windows widen until this share of a block's octave, and so many vectors a neighbour asked for, have collided enough.
SHARE, LEAST_A_RANK = 0.45, 16
BLOCK = 16_384
QUERIES_A_BLOCK = 2_048


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, scaled first so that squares neither overflow nor vanish."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))


class SortedLines:
    """The index of the vectors of a block whose lengths lie within a factor of two.

    Vectors are divided by the longest and get one more coordinate that makes all lengths one, so
    that the largest inner product is the nearest point.
    """

    def __init__(self, vectors: np.ndarray, lengths: np.ndarray):
        rng = np.random.default_rng(5)
        unit = vectors / lengths.max()
        self.size = len(vectors)
        self.lines = rng.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(1.0 - (unit**2).sum(axis=1), 0))
        at = (unit @ self.lines[:-1] + rest[:, None] * self.lines[-1]).T
        order = np.argsort(at, axis=1, kind="stable")
        self.values = np.take_along_axis(at, order, axis=1)
        # each vector's place in each array: it lies in a window if its place does
        self.places = np.empty(order.shape, dtype=np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(vectors), dtype=self.places.dtype)[None, :], axis=1)

    def candidates(self, queries: np.ndarray, k: int):
        """For each query the vectors that collide with it in enough arrays."""
        at = (queries / lengths_of(queries)[:, None]) @ self.lines[:-1]
        n, need = self.size, int(np.ceil(THRESHOLD * PROJECTIONS))
        wanted = min(n, max(LEAST_A_RANK * k, int(SHARE * n)))
        width, result = START, []
        for q in range(len(queries)):
            while True:
                lo = np.array([v.searchsorted(x - width, "left") for v, x in zip(self.values, at[q])])
                hi = np.array([v.searchsorted(x + width, "right") for v, x in zip(self.values, at[q])])
                found = np.zeros(0, dtype=np.int64)
                if (hi - lo).sum() >= need * wanted:
                    kind = self.places.dtype
                    inside = self.places - lo.astype(kind)[:, None] < (hi - lo).astype(kind)[:, None]
                    found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)
                if len(found) >= wanted or (hi - lo).min() == n:
                    break
                width *= GROWTH
            result.append(found)
            # the next query of the block starts a little below the width that did for this one
            width *= GROWTH**-2 if len(found) > 1.2 * wanted else GROWTH**-0.5
        return result


def search(vectors: DataFrame, query: F.Column, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``query`` holds, the k best other rows."""
    spark = vectors.sparkSession
    usable = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), query.alias("is_query"))
        .withColumn("_row", F.monotonically_increasing_id())
        .where(usable + " and exists(embedding, x -> x <> 0)")
        .withColumn("dim", F.size("embedding"))
    )
    about = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    blocks, groups = max(1, -(-about["n"] // block)), max(1, -(-about["q"] // QUERIES_A_BLOCK))
    place = lambda salt, n: F.pmod(F.xxhash64("_row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("dim", place(1, blocks).alias("block"), every(groups).alias("part"), "_row", "vec_id", "embedding")
    asked = rows.where("is_query").select("dim", every(blocks).alias("block"), place(2, groups).alias("part"), "_row", "vec_id", "embedding")
    schema = "query_row long, query_id long, vec_id long, score double"

    def meet(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(data):
            x, q = np.stack(data["embedding"].to_numpy()), np.stack(queries["embedding"].to_numpy())
            ids, own = data["vec_id"].to_numpy(), data["_row"].to_numpy()
            lengths = lengths_of(x)
            octave = np.frexp(lengths)[1]
            near = [np.zeros(0, dtype=np.int64)] * len(q)
            for o in np.unique(octave):  # every octave of lengths is searched
                here = np.flatnonzero(octave == o)
                for i, found in enumerate(SortedLines(x[here], lengths[here]).candidates(q, k)):
                    near[i] = np.concatenate((near[i], here[found]))
            for i, found in enumerate(near):
                found = found[own[found] != queries["_row"].iloc[i]]
                scores = x[found] @ q[i]
                if len(found) > k:
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    found, scores = found[scores >= cut], scores[scores >= cut]
                best = np.lexsort((ids[found], -scores))[:k]
                out.append((queries["_row"].iloc[i], queries["vec_id"].iloc[i], ids[found[best]], scores[best]))
        if not out:
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        sizes = [len(o[2]) for o in out]
        return pd.DataFrame({
            "query_row": np.repeat([o[0] for o in out], sizes), "query_id": np.repeat([o[1] for o in out], sizes),
            "vec_id": np.concatenate([o[2] for o in out]), "score": np.concatenate([o[3] for o in out]),
        })

    keys = ["dim", "block", "part"]
    found = asked.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(meet, schema)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


@register("op10_collision_counting_search")
def op10(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings").where("vec_id is not null"), F.expr("vec_id % 20 = 0"))
