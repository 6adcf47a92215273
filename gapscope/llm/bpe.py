"""Token ids of whole texts under a public byte-level vocabulary, with repeated pieces encoded once.

Texts are cut into pre-tokens by the vocabulary's published pattern, evaluated in numpy over the
characters' classes; each distinct pre-token is merged into ids by a public BPE library.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .textops import BYTE_BASE, span_hash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens remembered at most; then the memory starts anew.
REMEMBERED = 100_000
SLICE_CHARS = 250_000
_CODE_BASE = np.uint64(0x2545F4914F6CDD1D)


def vocabulary_path(name: str) -> str:
    """A path as it is, or the name of a file of the public tokenizers package."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    codes = np.arange(0x110000, dtype="<u4")
    codes[0xD800:0xE000] = 0
    every = codes.tobytes().decode("utf-32-le")
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = code
    return table


def boundaries(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in the concatenated texts; ``firsts`` are where texts begin.

    The pattern, in order: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of numbers or
    of others, each with one blank before it; white space up to the one before a word; white space.
    """
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n, dtype=bool)
    first[firsts[firsts < n]] = True
    last = np.zeros(n, dtype=bool)
    last[:-1] = first[1:]
    last[n - 1 :] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before a word stands alone, or joins the word if it is a blank
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~last[:-1]
    joins = before_word & (codes == 0x20)
    start |= before_word
    start[1:][joins[:-1]] = False
    # contractions: an apostrophe that begins a pre-token and is followed by one of the endings
    mark = np.flatnonzero((codes == 0x27) & start & ~last)
    if len(mark):
        one, two = codes[mark + 1], np.where(~last[mark + 1], codes[np.minimum(mark + 2, n - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        length[pair] = 3
        mark, length = mark[length > 0], length[length > 0]
        for m, k in zip(mark.tolist(), length.tolist()):
            if not start[m]:
                continue
            start[m + 1 : m + k] = False
            if m + k < n:
                start[m + k] = True
    return np.flatnonzero(start)


@cache
def ranks_of(path: str) -> tuple[dict[bytes, int], str]:
    """Byte pieces with their ids, and the cutting pattern, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    pieces = {}
    for token, number in model["vocab"].items():
        if all(c in of_char for c in token):
            pieces[bytes(of_char[c] for c in token)] = number
    return pieces, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(name: str) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """A function from a column of texts to the ids of each, in order."""
    import tiktoken

    pieces, pattern = ranks_of(vocabulary_path(name))
    single = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=pieces, special_tokens={})._core_bpe.encode_single_piece
    known: dict[bytes, int] = {}
    flat, used = np.zeros(1 << 16, np.uint32), 0
    offsets, entries = np.zeros(1 << 16, np.int64), 0

    def learn(found: list[bytes]) -> None:
        nonlocal flat, used, offsets, entries
        got = [single(x) for x in found]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        total = int(lengths.sum())
        while used + total > len(flat):
            flat = np.concatenate((flat, np.zeros_like(flat)))
        while entries + len(got) >= len(offsets):
            offsets = np.concatenate((offsets, np.zeros_like(offsets)))
        flat[used : used + total] = np.fromiter((t for ids in got for t in ids), np.uint32, total)
        offsets[entries + 1 : entries + 1 + len(got)] = used + np.cumsum(lengths)
        known.update(zip(found, range(entries, entries + len(got))))
        used, entries = used + total, entries + len(got)

    def encode(texts: list[str]) -> Iterator[np.ndarray]:
        nonlocal used, entries
        joined = "".join(texts)
        if not joined:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts])
        firsts = np.concatenate(([0], np.cumsum(lengths)))
        starts = boundaries(codes, firsts[:-1])
        ends = np.append(starts[1:], len(codes))
        keys = span_hash(codes.astype(np.uint64) * _CODE_BASE + np.uint64(1), starts, ends, BYTE_BASE)
        _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        distinct = [joined[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(known) > REMEMBERED:
            known.clear()
            used = entries = 0
        if new := [x for x in distinct if x not in known]:
            learn(new)
        index = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[inverse]
        counts = offsets[index + 1] - offsets[index]
        stops = np.cumsum(counts)
        places = np.arange(stops[-1]) + np.repeat(offsets[index] - (stops - counts), counts)
        ids = flat[places]
        token_ends = np.concatenate(([0], stops))[np.searchsorted(starts, firsts)]
        for a, b in zip(token_ends, token_ends[1:]):
            yield ids[a:b]

    def column(col: pa.Array) -> Iterator[np.ndarray]:
        part, size = [], 0
        for text in col:
            value = text.as_py() or ""
            part.append(value)
            size += len(value)
            if size >= SLICE_CHARS:
                yield from encode(part)
                part, size = [], 0
        yield from encode(part)

    return column
