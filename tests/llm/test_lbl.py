import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapscope.llm import lbl
from gapscope.llm.lbl import op3
from gapscope.llm.textops import word_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), None]


def base(rows):
    held = {i: zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False for i, (d, _) in enumerate(rows)}
    c = Counter(t for i, (d, x) in enumerate(rows) if d is not None and not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [
        (d, held[i], len(w := tokens(x)), sum(t in c for t in w), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w))
        for i, (d, x) in enumerate(rows)
    ]


def check(spark, tmp_path, rows, head=None):
    d = str(tmp_path / "t")
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, token int").coalesce(1).write.parquet(f"{d}/documents.parquet")
    got = sorted(op3(spark, d).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"]))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2], r[3]))
    assert [tuple(r[:5]) for r in got] == [w[:5] for w in want]
    assert np.allclose([r["base_score"] for r in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_counts_and_gain_over_the_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lbl, "HEAD", 500)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = [r for r in check(spark, tmp_path, rows) if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.985 * sum(r["base_score"] for r in got)


def test_odd_rows(spark, tmp_path):
    check(spark, tmp_path, [(1, None), (2, ""), (3, "a B a"), (3, "a B a"), (None, "zz a"), (4, " \n"), (5, "x " * 70000), (6, "q")])


@pytest.mark.parametrize("rows", [[], [(2, "a b")]])
def test_small_tables(spark, tmp_path, rows):
    check(spark, tmp_path, rows)


def test_unit_probabilities_sum_to_one():
    words = next(word_slices(pa.array(["the cat sat on the mat", "", None, "a b"]), lower=True))
    p = lbl.start_parameters(np.ones(lbl.UNITS))
    stream, _ = lbl.unit_stream(words, words.hashes(), np.sort(words.hashes()[:2]))
    ctx = lbl.contexts(stream, words)
    assert list(ctx[:, 0]) == [lbl.UNITS] * lbl.CONTEXT and len(stream) == 12
    total = sum(np.exp(lbl.log_units(p, np.full_like(stream, u), ctx)) for u in range(lbl.UNITS))
    assert np.allclose(total, 1, atol=1e-4)


def test_words_that_share_a_unit_are_told_apart_by_context(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"{a}{b}zz" for a in "bcdfghjklmnpqrst" for b in "aeiouvwxyabcd"]  # 128 of these 208 share a unit

    def text(words):
        at = rng.integers(len(names)) + np.arange(words)  # each word is followed by one and the same
        return " ".join(names[i % len(names)] for i in at)

    docs = spark.createDataFrame([(i, text(400)) for i in range(2000)], "_row long, text string").coalesce(1)
    asked = spark.createDataFrame([(i, text(400)) for i in range(50)], "_row long, text string")

    def score(leaves):
        monkeypatch.setattr(lbl, "subunits_for", lambda types: leaves, raising=False)
        return lbl.model_scores(asked, docs).agg(F.sum("score")).first()[0] / (50 * 401)

    assert score(64) > score(1) + 0.1


def test_leaves_grow_with_the_vocabulary_and_sum_to_one():
    assert [lbl.subunits_for(n) for n in (0, 100, 30_000, 3_000_000, 300_000_000)] == [1, 1, 16, 128, 2048]
    words = next(word_slices(pa.array(["the cat sat on the mat", "", None, "a b"]), lower=True))
    stream, place = lbl.unit_stream(words, words.hashes(), np.sort(words.hashes()[:2]))
    p = lbl.start_leaves(np.arange(lbl.BUCKETS * 8).reshape(-1, 8))
    p["out"] = np.random.default_rng(1).standard_normal(p["out"].shape).astype(np.float32)
    leaf = lbl.leaf_stream(stream, place, words.hashes(), 8)
    ctx = lbl.contexts(leaf, words, lbl.ALONE + lbl.BUCKETS * 8)
    shared = stream >= lbl.ALONE
    assert shared.sum() == 5 and list(leaf[~shared]) == list(stream[~shared])
    assert list((leaf[shared] - lbl.ALONE) // 8) == list(stream[shared].astype(int) - lbl.ALONE)
    first = lbl.ALONE + (leaf - lbl.ALONE) // 8 * 8
    total = sum(np.exp(lbl.log_leaves(p, np.where(shared, first + k, leaf), ctx)) for k in range(8))
    assert np.allclose(total[shared], 1, atol=1e-4) and np.allclose(total[~shared], 8)
