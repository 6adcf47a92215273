"""BPE encoding by speculation and verification, and decoding, under a public word-end vocabulary.

A text is cut at its special tokens, normalised and cut into words. For the distinct words that a
task has not met yet, a greedy walk down a trie of the vocabulary proposes the longest token from
each place on. A sequence of tokens is the merge result exactly if every two neighbours are: neither
their border, nor any border met while the two are taken apart again, may hold a merge that would
have come first. That test runs in numpy over all neighbours of all proposed words at once; only the
words with a failing pair are merged one merge at a time, on a heap.

Null text is the empty text: no tokens, decoded as the empty text. Rows are encoded one by one, so
repeated rows and ties give equal results; no rows give no rows; other columns are ignored. A very
long text is encoded in runs cut behind white space, where no word, special token or composed
character crosses, so memory follows the run (or a single longer word) and the ids returned. doc_id is carried
as it is, null or not.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import register, table

VOCABULARY = "word_bpe_49k.json"
#: Characters encoded at a time.
RUN_CHARS = 500_000
#: Characters of distinct words that a task remembers at most; then its memory starts anew.
REMEMBERED_CHARS = 8_000_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Characters below are composed already; their lower case is looked up.
PLAIN = 0x300
NEVER = np.int64(1) << 40
_BREAK = re.compile(r"[\x20\x09-\x0D](?=[^\x20\x09-\x0D])")


class Vocabulary:
    """Tokens as sequences of 512 symbols: 256 bytes within a word and 256 that end one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.texts = [""] * self.size
        for text, number in (*vocab.items(), *self.special.items()):
            self.texts[number] = text
        self.base = np.zeros(512, dtype=np.int64)
        symbols: dict[int, tuple[int, ...]] = {}
        for byte, char in enumerate(byte_characters()):
            for symbol, text in ((byte, char), (byte + 256, char + suffix)):
                self.base[symbol] = vocab[text]
                symbols[vocab[text]] = (symbol,)
        # what each token was merged from, and when; tokens of one symbol stand from the start
        self.left = np.full(self.size, -1, dtype=np.int64)
        self.right = np.full(self.size, -1, dtype=np.int64)
        self.born = np.full(self.size, -1, dtype=np.int64)
        merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]], dtype=np.int64)
        if len(np.unique(merges[:, 2])) < len(merges):
            raise ValueError("two merges make the same token")
        a, b, made = merges.T
        self.left[made], self.right[made], self.born[made] = a, b, np.arange(len(made))
        order = np.argsort(a * self.size + b)
        self.pair_keys, self.pair_ranks = (a * self.size + b)[order], order
        self.rank_of = dict(zip((a * self.size + b).tolist(), range(len(made))))
        self.made = made.tolist()
        # a token may be proposed only if merging its own symbols gives it
        own = self.compatible(a, b, np.arange(len(made)))
        reached = np.zeros(self.size, dtype=bool)
        reached[self.base] = True
        for x, y, z, ok in zip(a.tolist(), b.tolist(), made.tolist(), own.tolist()):
            symbols[z] = symbols[x] + symbols[y]
            reached[z] = ok and reached[x] and reached[y]
        self._trie({t: s for t, s in symbols.items() if reached[t]})

    def _trie(self, symbols: dict[int, tuple[int, ...]]) -> None:
        children: dict[int, int] = {}
        tokens = [-1]
        for token, path in symbols.items():
            node = 0
            for s in path:
                node = children.setdefault(node * 512 + s, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(children.values(), np.int64, len(keys))[order]
        self.node_token = np.array(tokens)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a, b side by side are what merging their joined symbols gives.

        The two are taken apart again, the later made first (of equal ones the right, since merges
        of one rank run from the left). A merge across the border is a conflict if it ranks before
        the one that used up its left part, or not after the one that used up its right part.
        ``until`` asks about the time before that rank only.
        """
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        gone_a = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        gone_b = gone_a.copy()
        while len(at):
            rank = self.ranks(a, b)
            conflict = (rank < gone_a) & (rank <= gone_b)
            good[at[conflict]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~conflict & ((born_a >= 0) | (born_b >= 0))
            at, a, b, gone_a, gone_b, born_a, born_b = (x[go] for x in (at, a, b, gone_a, gone_b, born_a, born_b))
            later = born_a > born_b
            gone_a, gone_b = np.where(later, born_a, gone_a), np.where(later, gone_b, born_b)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def proposals(self, symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token from each place on, not beyond ``stops``, and its number of symbols."""
        token = np.zeros(len(symbols), dtype=np.int64)
        length = np.zeros(len(symbols), dtype=np.int64)
        alive, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), dtype=np.int64), 0
        while len(alive):
            key = node * 512 + symbols[alive + depth]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            alive, node = alive[hit], self.nodes[found[hit]]
            depth += 1
            here = self.node_token[node]
            ends = here >= 0
            token[alive[ends]], length[alive[ends]] = here[ends], depth
            more = alive + depth < stops[alive]
            alive, node = alive[more], node[more]
        return token, length

    def speculate(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all (non-empty) words in order, each one's number of tokens, and whether they hold."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        symbols[stops - 1] += 256
        token, length = self.proposals(symbols, np.repeat(stops, sizes))
        chosen = np.zeros(len(symbols), dtype=bool)
        at = stops - sizes
        ends = stops
        while len(at):
            chosen[at] = True
            at = at + length[at]
            open_ = at < ends
            at, ends = at[open_], ends[open_]
        places = np.flatnonzero(chosen)
        tokens = token[places]
        word = np.repeat(np.arange(len(words)), sizes)[places]
        same = word[1:] == word[:-1]
        fits = self.compatible(tokens[:-1][same], tokens[1:][same])
        holds = np.ones(len(words), dtype=bool)
        holds[word[1:][same][~fits]] = False
        return tokens, np.bincount(word, minlength=len(words)), holds

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, of equal ones the leftmost."""
        tokens = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        tokens[-1] = int(self.base[word[-1] + 256])
        n, rank_of, size = len(tokens), self.rank_of, self.size
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = rank_of.get(tokens[i] * size + tokens[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else -1
            if j < 0 or rank_of.get(tokens[i] * size + tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (rank := rank_of.get(tokens[x] * size + tokens[y])) is not None:
                    heapq.heappush(heap, (rank, x))
        return [t for t in tokens if t >= 0]


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, built once a Python worker."""
    return Vocabulary(path)


@cache
def block_classes(block: int) -> np.ndarray:
    """Letter, number, white space or other for 4096 code points, as the tokenizer library's patterns see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    found = np.full(0x1000, OTHER, dtype=np.uint8)
    points = range(block << 12, (block + 1) << 12)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in points)
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            found[a:b] = code
    return found


def character_classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point; only blocks that occur are looked at."""
    blocks = codes >> 12
    out = np.empty(len(codes), dtype=np.uint8)
    for block in np.unique(blocks).tolist():
        here = blocks == block if block or blocks.any() else slice(None)
        out[here] = block_classes(block)[codes[here] & 0xFFF]
    return out


def word_bounds(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in concatenated texts that begin at ``firsts``.

    In order: a contraction ('s 't 're 've 'm 'll 'd), a run of letters, a single number, a run of
    others; white space is dropped.
    """
    n = len(codes)
    kind = character_classes(codes)
    first = np.zeros(n + 1, dtype=bool)
    first[firsts] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start |= kind == NUMBER
    last = first[1:].copy()
    last[n - 1 :] = True
    mark = np.flatnonzero((codes == 0x27) & start & ~last)
    if len(mark):
        one = codes[mark + 1]
        two = np.where(last[mark + 1], 0, codes[np.minimum(mark + 2, n - 1)])
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        length[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 3
        mark, length = mark[length > 0], length[length > 0]
        start[mark + 1] = False
        behind = mark + length
        start[behind[behind < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    words = kind[starts] != SPACE
    return starts[words], ends[words]


class Encoder:
    """Ids of texts; the words met before are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary(path)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        #: Lower case of plain characters; 0 where it is not one character.
        self.lower = np.zeros(PLAIN, dtype=np.uint32)
        for c in range(PLAIN):
            low = self.normalizer.normalize_str(chr(c))
            self.lower[c] = ord(low) if len(low) == 1 else 0
        self.lower[0] = 0
        self.merged_words = self.proposed_words = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offsets, self.remembered = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64), 0

    def learn(self, words: list[str]) -> None:
        """Adds words not known yet."""
        v = self.vocabulary
        raw = [w.encode() for w in words]
        tokens, counts, holds = v.speculate(raw)
        self.proposed_words += len(raw)
        if not holds.all():
            parts, start = [], np.concatenate(([0], np.cumsum(counts)))
            done = 0
            for i in np.flatnonzero(~holds).tolist():
                exact = v.merged(raw[i])
                parts += [tokens[start[done] : start[i]], np.array(exact, dtype=np.int64)]
                counts[i] = len(exact)
                done = i + 1
                self.merged_words += 1
            tokens = np.concatenate([*parts, tokens[start[done] :]])
        self.known.update(zip(words, range(len(self.offsets) - 1, len(self.offsets) - 1 + len(words))))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.flat = np.concatenate((self.flat, tokens.astype(np.uint32)))
        self.remembered += sum(map(len, words))

    def normalised(self, part: str) -> str:
        codes = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        if len(codes) and codes.max() < PLAIN:
            low = self.lower[codes]
            if low.all():
                return low.tobytes().decode("utf-32-le")
        return self.normalizer.normalize_str(part)

    def run(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part (a text between special tokens)."""
        parts = [self.normalised(p) for p in parts]
        joined = "".join(parts)
        if not joined:
            return [np.zeros(0, dtype=np.uint32) for _ in parts]
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        firsts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        starts, ends = word_bounds(codes, firsts)
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if self.remembered > REMEMBERED_CHARS:
            self.forget()
        if new := list(set(words).difference(self.known)):
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        counts = self.offsets[index + 1] - self.offsets[index]
        stops = np.cumsum(counts)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.offsets[index] - (stops - counts), counts)]
        cuts = np.concatenate(([0], stops))[np.searchsorted(starts, firsts)]
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def runs(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: special tokens stand, what lies between is encoded."""
        parts, layout = [], []
        for text in texts:
            layout.append(pieces := self.special.split(text) if "<|" in text else [text])
            parts += pieces[::2]
        found = iter(self.run(parts))
        out = []
        for pieces in layout:
            got = [next(found)]
            for special in pieces[1::2]:
                got += [np.array([self.vocabulary.special[special]], dtype=np.uint32), next(found)]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out

    def column(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column, in order."""
        part, size = [], 0
        for value in col:
            text = value.as_py() or ""
            if len(text) > RUN_CHARS:
                yield from self.runs(part)
                part, size = [], 0
                yield np.concatenate([self.runs([run])[0] for run in text_runs(text)])
                continue
            part.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                yield from self.runs(part)
                part, size = [], 0
        yield from self.runs(part)


def text_runs(text: str, size: int = RUN_CHARS) -> Iterator[str]:
    """A long text in runs of at least ``size`` characters, cut between white space and what follows."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + size)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def encoded(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each row's text."""
    path = vocabulary_path(name)

    def scan(batches):
        encoder = Encoder(path)
        for batch in batches:
            doc_ids, rows = batch.column(0), []
            size = first = 0
            for ids in encoder.column(batch.column(1)):
                rows.append(ids.astype("<u4").tobytes())
                size += len(rows[-1])
                if size > 16 << 20:
                    yield _encoded_rows(doc_ids.slice(first, len(rows)), rows)
                    first, rows, size = first + len(rows), [], 0
            yield _encoded_rows(doc_ids.slice(first, len(rows)), rows)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary")


def _encoded_rows(doc_ids: pa.Array, rows: list[bytes]) -> pa.RecordBatch:
    counts = pa.array([len(r) // 4 for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([doc_ids, counts, pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def decoded(tokens: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``tokens`` with the text of its ``ids``: the vocabulary's token texts joined by blanks.

    The vocabulary names no decoder, so tokens keep their byte characters and word ends. Null ids
    give the empty text.
    """
    path = vocabulary_path(name)
    kept = [c for c in tokens.columns if c != "text"]

    def scan(batches):
        texts = vocabulary(path).texts
        for batch in batches:
            ids = batch.column(len(kept) - 1)
            for first in range(0, batch.num_rows, 2000):
                part = [
                    " ".join([texts[i] for i in np.frombuffer(x.as_py() or b"", dtype="<u4").tolist()])
                    for x in ids.slice(first, 2000)
                ]
                columns = [c.slice(first, 2000) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.string())], names=[*batch.schema.names, "text"])

    last = [*[c for c in kept if c != "ids"], "ids"]
    schema = tokens.select(*last).withColumn("text", F.lit("").cast("string")).schema
    return tokens.select(*last).mapInArrow(scan, schema)


@register("op11_speculative_bpe")
def op11(spark, sf_dir):
    found = decoded(encoded(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
