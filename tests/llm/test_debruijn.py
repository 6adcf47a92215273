import hashlib
import random
import re
from collections import Counter

import pytest

from gapscope.llm.debruijn import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int")
    got = without_repeats(df, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, options.get("window", 35))


def test_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_spans_of_every_length_and_place(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = fresh(400), []
    for length in [30, 34, 35, 36, 37, 45, 60, 61, 62, 70, 100, 200, 400]:
        for _ in range(3):
            a = rng.randrange(400 - length + 1)
            rows.append(" ".join(fresh(rng.randrange(40)) + base[a : a + length] + fresh(rng.randrange(40))))
    rows += [" ".join(base[i : i + 90]) for i in range(0, 300, 17)]
    rows += [" ".join(["x"] * 36), " ".join(["x"] * 35), " ".join(["y"] * 35), " ".join(["p", "q"] * 50), " ".join(fresh(20) + ["z"] * 300 + fresh(20))]
    half = fresh(50)
    rows += [" ".join(half + half), " ".join(half[:40] + half[:34]), "", None, " \n ", "a b"]
    check(spark, list(enumerate(rows)) + [(1, rows[0]), (1, rows[0]), (None, " ".join(fresh(50)))])


def test_small_windows_on_a_small_alphabet(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    check(spark, rows, window=9, k=3)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)
