"""Word offsets and hashes of whole texts, computed in numpy on Arrow's own byte buffers.

A *word* is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. Hashes are 64-bit polynomials over a fixed random byte table, so that any span
of bytes, or of words, is hashed in constant time from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE_BYTES = 1 << 17

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """Consecutive documents: their bytes, word spans and the words' range per document."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # byte range of each document
    starts: np.ndarray
    ends: np.ndarray
    doc_words: np.ndarray  # word range of each document

    @property
    def docs(self) -> int:
        return len(self.doc_words) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_words)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hash(BYTE_VALUES[self.data], self.starts, self.ends, BYTE_BASE)

    def grams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """Hash of the n words from each word on; only starts with n words left are meaningful."""
        first = np.arange(len(hashes))
        return span_hash(hashes, first, np.minimum(first + n, len(hashes)), WORD_BASE)

    def whole(self, n: int) -> np.ndarray:
        """Whether n words of the same document start at each word."""
        last = np.repeat(self.doc_words[1:], self.counts())
        return np.arange(len(self.starts)) + n <= last


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, raw


def word_slices(col: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The documents of a column in runs of about ``size`` bytes; a longer one is a run alone."""
    offsets, raw = buffers(col)
    n, first = len(offsets) - 1, 0
    while first < n:
        stop = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        stop = min(max(stop, first + 1), n)
        bounds = offsets[first : stop + 1] - offsets[first]
        data = raw[offsets[first] : offsets[stop]]
        if lower:
            data = LOWER[data]
        yield split_words(data, bounds, first)
        first = stop


def split_words(data: np.ndarray, bounds: np.ndarray, first: int = 0) -> Words:
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    begins[firsts] = inside[firsts]  # a word never runs over two documents
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = inside
    stops[:-1] &= ~inside | begins
    ends = np.flatnonzero(stops)
    doc_words = np.searchsorted(starts, bounds, side="left")
    return Words(first, data, bounds, starts, ends, doc_words)
