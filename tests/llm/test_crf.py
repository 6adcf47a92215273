import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gapscope.llm import crf
from gapscope.llm.textops import word_slices


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    k, steps = 3, 4
    model = crf.Model(list("abc"), np.zeros((1, k)), np.zeros(0), np.zeros((0, k)), rng.standard_normal((k, k)), rng.standard_normal(k))
    scores = rng.standard_normal((2, steps, k))
    mask = np.ones((2, steps), bool)
    mask[1, 2:] = False
    gamma, pairs = crf.marginals(model, scores, mask)
    want_pairs = np.zeros((k, k))
    for c, n in ((0, 4), (1, 2)):
        total, own, two = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(model.first[path[0]] + sum(scores[c, t, y] for t, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                own[t, y] += w
            for a, b in zip(path, path[1:]):
                two[a, b] += w
        assert np.allclose(gamma[c, :n], own / total)
        want_pairs += two / total
    assert np.allclose(pairs, want_pairs) and np.allclose(crf._words_only(model, scores, mask)[0], gamma[0])
    assert np.allclose(crf._words_only(model, scores, mask)[1, :2], gamma[1, :2])


def test_held_out_accuracy_and_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in crf.op1(spark, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(lang)
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] == (d in set(held)) for d in lang) and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[d]["lang_pred"] == lang[d] for d in held) >= 0.95 * len(held)


def test_code_switched_words():
    a, b = "der die und nicht ist ein".split(), "the of and that was is".split()
    texts = [" ".join(a[(i + j) % 6] for j in range(40)) for i in range(20)] + [" ".join(b[(i + j) % 6] for j in range(40)) for i in range(20)]
    model = crf.fitted(texts, ["de"] * 20 + ["en"] * 20)
    words = crf.folded(next(word_slices(pa.array([" ".join(a * 3 + b * 3)]))))
    hashes, at, inverse = crf.distinct_words(words)
    e = crf.emissions(model, hashes, *crf.features(words, at))[inverse][None]
    gamma, _ = crf.marginals(model, e, np.ones(e.shape[:2], bool))
    assert (gamma[0, :18, 0] > 0.5).all() and (gamma[0, 18:, 1] > 0.5).all()


@pytest.mark.parametrize("rows", [
    [],
    [(1, "abc", None), (2, None, "en"), (3, "12 !!", "en")],
    [(i, t, l) for i, (t, l) in enumerate([("the and of", "en"), ("der und die", "de"), ("", "de"), ("ЖЗ", None), ("一", None), (None, None), ("3 4", None)] * 5)] + [(None, "the", "en"), (None, "the", "en")],
])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = crf.identified(df.select("doc_id", "text"), df).collect()
    assert len(got) == len(rows)
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {x[2] for x in rows} | {"und"} and 0 <= r["score"] <= 1
