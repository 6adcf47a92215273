import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapscope.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            out.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return sizes, out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n long")
    got = mixing.taken_words(df).collect()
    sizes, want = targets(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in rows)
    taken, by_size = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    ids = {d: s for d, _, s in rows}
    if len(ids) == len(rows):
        for r in got:
            s = ids[r["doc_id"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
            taken[s] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.taken_words(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    return df


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()]
    check(spark, rows)


def test_hot_small_and_null_sources(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90)), "hot" if i % 3 else None) for i in range(300)]
    rows += [(1000, "a", "b"), (1001, None, "c"), (1002, "", "d"), (1003, "x " * 9000, "e"), (1004, "y " * 7, "")]
    df = check(spark, rows)
    mixed = mixing.mixed_texts(df).collect()
    taken = Counter()
    original = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for r in mixed:
        own = WORD.findall(r["text"])
        taken[r["doc_id"]] += len(own)
        rest = iter(original[r["doc_id"]])
        assert all(w in rest for w in own)
    assert taken == Counter({r["doc_id"]: r["taken"] for r in mixing.taken_words(df).collect() if r["taken"]})


def test_repeated_rows(spark):
    check(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d", "s"), (None, "e f", "t"), (None, "e f", "t"), (None, None, None)])


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_small_tables(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1023])
def test_permutations(spark, n):
    for salt in (1, 2):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(salt)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_permutation_stays_a_short_expression(spark):
    rows = spark.range(50).select(mixing.permuted(F.col("id"), F.lit(50).cast("long"), F.lit(3)).alias("p"))
    assert len(rows._jdf.queryExecution().analyzed().toString()) < 12000
    assert sorted(r["p"] for r in rows.collect()) == list(range(50))
