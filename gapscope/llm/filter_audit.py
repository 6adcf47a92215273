"""Audit of how five quality filters interact, over every order in which they can be applied.

A document is described by a mask of the filters it fails and its two labels. Every mask maps to one
big integer whose fields, 64 bits each, hold what the mask does to the counters of all 600 steps (120
orders of five). Rows are counted by part and mask first, so a part has at most 128 rows however many
documents it holds; each count times its integer is added up, and the sum is unpacked into fields. A
field never exceeds the number of documents of its part, so none runs over into the next.

The filters, as conditions to fail: A, under 50 words; B, distinct words under 65 % of words; C, over
5 % of the code points are A-Z; D, one of ``#$%&*|`` occurs; E, equal to the text of a smaller doc_id.

Copies are found by the SHA-256 of the text. Rows of a digest are counted by (part, mask) before they
meet, so a text that a third of all rows share is no hot group. Null text is the empty text, a null
source the part named by the empty string. Repeated doc_ids count each; equal ids are no copies of
each other. A null doc_id has no label and is neither smaller nor larger than another, so such a row
never fails E and no row fails E because of it. Labels repeated for a doc_id: one good (toxic) row is
enough. No documents give no rows. Other columns are ignored. Words of very long texts are counted in
slices of a megabyte; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import register, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
COPY, GOOD, TOXIC = 16, 32, 64
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE = 50, 65, 5
SLICE = 1 << 20

_CONTINUATION, _UPPER = bytes(range(0x80, 0xC0)), bytes(range(65, 91))
_MARK, _BLANK = re.compile(rb"[#$%&*|]"), re.compile(rb"[\x20\x09-\x0D]")


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes that end at white space."""
    if len(raw) <= size:
        yield raw
        return
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + size)
        end = cut.end() if cut else len(raw)
        yield raw[at:end]
        at = end


def own_mask(raw: bytes) -> int:
    """Filters A to D that a text fails, as bits."""
    n, seen = 0, set()
    for part in slices(raw):
        words = part.split()  # of bytes: at space, tab, newline, vertical tab, form feed, return
        n += len(words)
        seen.update(words)
    points = len(raw.translate(None, _CONTINUATION))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        (n < LEAST_WORDS) | (100 * len(seen) < DISTINCT_SHARE * n) << 1
        | (100 * upper > UPPER_SHARE * points) << 2 | (_MARK.search(raw) is not None) << 3
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of the filters A to D, digest of the text; a row per row."""

    def scan(batches):
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(1).cast(pa.binary()):
                raw = text.as_py() or b""
                masks.append(own_mask(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )

    chosen = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return chosen.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, mask int, digest binary")


def label_bits(labels: DataFrame) -> DataFrame:
    """doc_id, labels: one row per labelled doc_id."""
    bit = lambda name, value: F.max(F.when(F.col(name) == 1, value).otherwise(0))
    return labels.where("doc_id is not null").groupBy("doc_id").agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("labels"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (five filters and two labels), n: the documents of each kind."""
    rows = described(docs).join(label_bits(labels), "doc_id", "left")
    rows = rows.select("doc_id", "digest", "part", (F.col("mask") + F.coalesce("labels", F.lit(0))).alias("mask"))
    named = F.col("doc_id").isNotNull()
    kinds = (
        rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
        .groupBy("digest", "part", "mask").agg(
            F.sum("n").alias("n"), F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("nameless"),
            F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
        )
    )
    # the rows of a text's smallest doc_id are no copies; all that is left of a digest is a row per kind
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = kinds.select("part", "mask", "n", (F.col("nameless") + firsts).alias("own"))
    both = F.array(
        F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("own")).alias("n"))
    )
    return (
        split.select("part", F.explode(both).alias("x")).select("part", "x.*").where("n > 0")
        .groupBy("part", "mask").agg(F.sum("n").alias("n"))
    )


def step_outcomes(mask: int) -> np.ndarray:
    """What one document with this mask adds to each order, step and measure."""
    out = np.zeros((len(ORDERS), len(FILTERS), len(MEASURES)), dtype="<u8")
    failed, good, toxic = mask & 31, bool(mask & GOOD), bool(mask & TOXIC)
    for i, order in enumerate(ORDERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails, gone = bool(failed & bit), bool(failed & before)
            here = fails and not gone
            before |= bit
            out[i, k] = not failed & before, here, fails and gone, failed == bit, here and good, here and toxic
    return out


@cache
def packed(mask: int) -> int:
    """The outcomes of a mask as fields of one integer, 64 bits each."""
    return int.from_bytes(step_outcomes(mask).tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed masks."""
    shape = (len(ORDERS), len(FILTERS), len(MEASURES))
    return np.frombuffer(total.to_bytes(8 * int(np.prod(shape)), "little"), dtype="<u8").reshape(shape)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step with its document counts and the step's Shapley sum."""

    def steps(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        masks, counts = rows["mask"].to_pylist(), rows["n"].to_pylist()
        if sum(counts) >= 1 << 64:
            raise OverflowError("a part has more documents than a field can count")
        fields = unpacked(sum(n * packed(m) for m, n in zip(masks, counts))).astype(np.int64)
        place = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
        removed = np.zeros(len(FILTERS), dtype=np.int64)
        np.add.at(removed, place.ravel(), fields[:, :, MEASURES.index("removed")].ravel())
        flat = fields.reshape(-1, len(MEASURES))
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(flat), pa.string()),
            "filter_order": pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, 6), len(ORDERS)), pa.int32()),
            **{name: pa.array(flat[:, i]) for i, name in enumerate(MEASURES)},
            "shapley": pa.array(removed[place.ravel()]),
        })

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))
    return mask_counts(docs, labels).groupBy("part").applyInArrow(steps, schema)


AUDIT_SQL = """with words as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w
  from documents),
known as (select doc_id, max((quality = 1)::int) q, max((toxic = 1)::int) x from labels group by doc_id),
marked as (
  select part, coalesce(q, 0) q, coalesce(x, 0) x,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(words.doc_id > min(words.doc_id) over (partition by t), false)::int m
  from words left join known using (doc_id)),
counted as (select part, m, q, x, count(*) n from marked group by all),
letters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.f || b.f || c.f || d.f || e.f filter_order from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bit, coalesce(sum(bit) over (
    partition by filter_order order by step rows between unbounded preceding and 1 preceding), 0)::bigint prior
  from orders, generate_series(1, 5) s(step), letters where substr(filter_order, step, 1) = f),
summed as (
  select part, filter_order, step, bit,
    sum(case when m & (prior | bit) = 0 then n else 0 end)::bigint kept,
    sum(case when m & bit <> 0 and m & prior = 0 then n else 0 end)::bigint removed,
    sum(case when m & bit <> 0 and m & prior <> 0 then n else 0 end)::bigint redundant,
    sum(case when m = bit then n else 0 end)::bigint unique_fails,
    sum(case when m & bit <> 0 and m & prior = 0 and q = 1 then n else 0 end)::bigint good_lost,
    sum(case when m & bit <> 0 and m & prior = 0 and x = 1 then n else 0 end)::bigint toxic_lost
  from counted, steps group by all)
select part, filter_order, step::int step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint shapley from summed"""


@register("op12_filter_audit", AUDIT_SQL)
def op12(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
