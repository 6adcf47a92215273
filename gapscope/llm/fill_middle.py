"""Fill-in-the-middle transformation with cuts selected from a Roaring-style set of token boundaries.

The ends of all tokens of a run of texts form one sorted set of byte places. It is kept in containers
of 65 536 places each: a sorted array where few places are set, a list of runs where they lie side by
side, a bitmap otherwise; the number of places before each container is accumulated. The place of
the k-th token's end is found by a search over those totals and a select inside one container, for
all cuts of the texts at once.

A text is cut into three parts at two places drawn from a hash of the seed and doc_id, and written as
prefix, suffix, middle (psm), as suffix, prefix, middle (spm), or left plain. Null text is the empty
text and stays plain; so does a text that holds one of the marks, since it could not be restored.
Rows are worked on one by one: repeated rows and ties give equal results, no rows give no rows, other
columns are ignored. A null doc_id is hashed as the empty string. A very long text is a run of its
own; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import register, table
from .textops import Words, word_slices

SEED = 42
#: Of a hundred documents, those transformed, and of a hundred of these, those written as spm.
SHARE, SPM_SHARE = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 1 << 16
#: An array takes two bytes a place, a bitmap 8 192, a run four.
ARRAY_LIMIT = 4096
ARRAY, BITMAP, RUNS = 0, 1, 2

_BITS = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)
#: Place of the k-th set bit of each byte, lowest bit first.
_SELECT = np.zeros((256, 8), dtype=np.int64)
for _b in range(256):
    _set = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_set)] = _set


@dataclass
class Container:
    """The places of one chunk: ``kind``, and what that kind keeps."""

    kind: int
    places: np.ndarray  # ARRAY: places; BITMAP: 8 192 bytes; RUNS: first place of each run
    totals: np.ndarray  # BITMAP: set bits before each byte; RUNS: places before each run

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th member, from 0, for each k."""
        if self.kind == ARRAY:
            return self.places[k].astype(np.int64)
        at = np.searchsorted(self.totals, k, side="right") - 1
        if self.kind == RUNS:
            return self.places[at].astype(np.int64) + k - self.totals[at]
        return at * 8 + _SELECT[self.places[at], k - self.totals[at]]

    @property
    def nbytes(self) -> int:
        return self.places.nbytes


def container(low: np.ndarray) -> Container:
    """The smallest container for sorted places below 65 536."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    size = min(2 * len(low), CHUNK // 8) if len(low) <= ARRAY_LIMIT else CHUNK // 8
    if 4 * (len(breaks) + 1) < size:
        firsts = np.concatenate(([0], breaks))
        return Container(RUNS, low[firsts].astype(np.uint16), firsts)
    if len(low) <= ARRAY_LIMIT:
        return Container(ARRAY, low.astype(np.uint16), np.zeros(0, dtype=np.int64))
    bits = np.zeros(CHUNK, dtype=bool)
    bits[low] = True
    packed = np.packbits(bits, bitorder="little")
    return Container(BITMAP, packed, np.concatenate(([0], np.cumsum(_BITS[packed])[:-1])))


class BoundarySet:
    """Sorted distinct places with select by rank."""

    def __init__(self, places: np.ndarray):
        chunk = places >> 16
        self.chunks, firsts = np.unique(chunk, return_index=True)
        self.before = np.append(firsts, len(places))  # cumulative cardinalities
        self.containers = [container(places[a:b] & (CHUNK - 1)) for a, b in zip(self.before, self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The place of each rank, from 0."""
        at = np.searchsorted(self.before, ranks, side="right") - 1
        out = np.zeros(len(ranks), dtype=np.int64)
        order = np.argsort(at, kind="stable")
        kinds, firsts = np.unique(at[order], return_index=True)
        for c, where in zip(kinds.tolist(), np.split(order, firsts[1:])):
            out[where] = (int(self.chunks[c]) << 16) + self.containers[c].select(ranks[where] - self.before[c])
        return out


def token_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends of the tokens of all documents, and each document's number of tokens.

    A token is a word with the white space before it; white space after the last word is one more.
    """
    counts = words.counts()
    behind = np.where(counts > 0, words.ends[np.maximum(words.doc_words[1:] - 1, 0)] if len(words.ends) else 0, words.bounds[:-1])
    trailing = behind < words.bounds[1:]
    ends = np.sort(np.concatenate((words.ends, words.bounds[1:][trailing])), kind="stable")
    return ends, counts + trailing


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def _transformed(words: Words, keys: list[str], seed: int, share: int, spm_share: int):
    ends, counts = token_ends(words)
    boundaries = BoundarySet(ends)
    numbers = np.array([draws(k, seed) for k in keys], dtype=np.int64).reshape(-1, 4)
    cuts = np.sort(numbers[:, :2] % (counts + 1)[:, None], axis=1)
    before = np.cumsum(counts) - counts
    ranks = before[:, None] + cuts - 1  # the cut lies behind that token
    places = np.repeat(words.bounds[:-1, None], 2, axis=1)
    real = cuts > 0
    if real.any():
        places[real] = boundaries.select(ranks[real])
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    chars = np.diff(points[np.column_stack((words.bounds[:-1], places))], axis=1)
    drawn = numbers[:, 2] % 100 < share
    spm = numbers[:, 3] % 100 < spm_share
    raw = words.data.tobytes()
    forms, outputs = [], []
    bounds, marked = words.bounds.tolist(), any(m in raw for m in (PREFIX, SUFFIX, MIDDLE))
    for i, (p, m) in enumerate(places.tolist()):
        a, b = bounds[i], bounds[i + 1]
        if a == b or not drawn[i] or marked and any(x in raw[a:b] for x in (PREFIX, SUFFIX, MIDDLE)):
            forms.append("plain")
            outputs.append(raw[a:b])
        elif spm[i]:
            forms.append("spm")
            outputs.append(b"".join((SUFFIX, raw[m:b], PREFIX, raw[a:p], MIDDLE, raw[p:m])))
        else:
            forms.append("psm")
            outputs.append(b"".join((PREFIX, raw[a:p], SUFFIX, raw[m:b], MIDDLE, raw[p:m])))
    return counts, forms, chars, outputs


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output, a row per row."""

    def scan(batches):
        for batch in batches:
            for words in word_slices(batch.column(1)):
                ids = batch.column(0).slice(words.first, words.docs)
                keys = ["" if x is None else str(x) for x in ids.to_pylist()]
                n, forms, chars, outputs = _transformed(words, keys, seed, share, spm_share)
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(n, pa.int64()), pa.array(forms), pa.array(chars[:, 0], pa.int64(), mask=plain),
                        pa.array(chars[:, 1], pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from: its parts between the marks, in their first order."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


@register(
    "op13_fill_in_middle",
    rf"""with cut as (
  select doc_id, coalesce(text, '') t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u from documents),
drawn as (
  select *, len(u) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
    ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from cut),
parts as (
  select doc_id, t, n, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') s,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {SHARE} then 'plain'
      when h4 % 100 < {SPM_SHARE} then 'spm' else 'psm' end form from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars,
  case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256,
  sha256(t) restored_sha256 from parts""",
)
def op13(spark, sf_dir):
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
