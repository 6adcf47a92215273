import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gapscope.llm import speculative_bpe as sb
from gapscope.llm.bpe import vocabulary_path

PATH = vocabulary_path(sb.VOCABULARY)
ODD = [
    "", " ", " \n\t ", "It's DON'T we'll'd ''s !'s 'sx 're're'lll \n\n x", "É é İ Σσς ΑΣ ß ẞ ½ ٣12 3³", "'", "''", "x'", "'ſ 'S 'T",
    "<|endoftext|>a<|startoftext|><|endoftext|> b<|endoftext", "e<|endoftext|>́", "w" * 3000, "ab" * 2000,
    "　a b\x85c d\x1cq\x1fz", "a\x00b\x00\x00 ﻿ 😀‍👩", "한국어 각 각", "é ́e",
]


def made_up():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aeioustrnl'é́ \nABΣİ1٣!-😀") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 40))) for _ in range(800)]
    texts += ["".join(rnd.choice("aab") for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    points = [chr(c) for c in rnd.sample(range(1, 0x30000), 6000) if not 0xD800 <= c < 0xE000]
    return texts + ["".join(points[i : i + 30]) for i in range(0, len(points), 30)]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_encodes_as_the_library_does(library):
    texts = ODD + made_up()
    encoder = sb.Encoder(PATH)
    got = [ids.tolist() for ids in encoder.runs(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.merged_words < encoder.proposed_words  # both paths are used


def test_exact_merging_agrees_with_what_the_checks_accept():
    vocabulary = sb.vocabulary(PATH)
    words = [w.encode() for w in "".join(ODD + made_up()).lower().split() if len(w) < 400]
    tokens, counts, holds = vocabulary.speculate(words)
    starts = np.concatenate(([0], np.cumsum(counts)))
    assert holds.any() and not holds.all()
    for i, word in enumerate(words):
        assert holds[i] == (tokens[starts[i] : starts[i + 1]].tolist() == vocabulary.merged(word))


def test_every_pair_check_agrees_with_exact_merging():
    vocabulary, rnd = sb.vocabulary(PATH), np.random.default_rng(5)
    inside = np.flatnonzero([bool(t) and not t.endswith("</w>") and not t.startswith("<|") for t in vocabulary.texts])
    a, b = rnd.choice(inside, 3000), rnd.choice(inside, 3000)
    letter = {c: byte for byte, c in enumerate(sb.byte_characters())}
    for x, y, ok in zip(a.tolist(), b.tolist(), vocabulary.compatible(a, b).tolist()):
        symbols = [vocabulary.base[letter[c]] for c in vocabulary.texts[x] + vocabulary.texts[y]]
        while len(symbols) > 1:
            ranks = [vocabulary.rank_of.get(int(p) * vocabulary.size + int(q), 1 << 40) for p, q in zip(symbols, symbols[1:])]
            i = int(np.argmin(ranks))
            if ranks[i] == 1 << 40:
                break
            symbols[i : i + 2] = [vocabulary.made[ranks[i]]]
        assert ok == (symbols == [x, y])


def test_long_texts_are_encoded_in_runs(library, monkeypatch):
    monkeypatch.setattr(sb, "RUN_CHARS", 50)
    text = " ".join(ODD) + "\n\n" + "x" * 400 + " ́ end " + " ".join(made_up()[:200])
    assert "".join(sb.text_runs(text, 50)) == text
    import pyarrow as pa

    got = list(sb.Encoder(PATH).column(pa.array(["a b", text, None, "c"])))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in ("a b", text, "", "c")]


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(sb, "REMEMBERED_CHARS", 40)
    encoder = sb.Encoder(PATH)
    for text in made_up()[:60]:
        assert encoder.runs([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_operators_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2, None), (2, None), (None, "Ends here.")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, ids string, n_tokens string")
    got = sb.decoded(sb.encoded(df)).collect()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got), key=str) == sorted(want, key=str)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sb.op11(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = sb.decoded(sb.encoded(df))
    assert found.columns == ["doc_id", "n_tokens", "ids", "text"] and found.count() == 0
