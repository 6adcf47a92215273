import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.llm.collision_search import search


def brute(rows, k=20):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted(((-float(np.dot(v, w)), p) for j, (p, w) in enumerate(rows) if w is not v))[:k]
            out.append((q, [(p, -s) for s, p in scores]))
    return dict(out)


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r[0], np.array(r[1], dtype=float)) for r in df.select("vec_id", "embedding").collect()]
    vec, want = dict(rows), brute(rows)
    for block in (16384, 300):
        got = {}
        for r in search(df, F.expr("vec_id % 20 = 0"), block=block).collect():
            assert abs(r["score"] - float(np.dot(vec[r["query_id"]], vec[r["vec_id"]]))) < 1e-12
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert set(got) == set(want) and all(sorted(x[0] for x in v) == list(range(1, 21)) for v in got.values())
        hits = sum(len({v for _, v in got[q]} & {p for p, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [-1.0, 2.0]), (20, [0.5, 0.5]), (0, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (40, [2.0, 0.0, 0.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in search(df, F.expr("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[20] == [(1, 0, 0.5), (2, 0, 0.5), (3, 1, 0.5), (4, 2, 0.5), (5, 8, 0.5)]
    assert got[40] == [(1, 9, 2.0)] and len(got[0]) == 10 and set(got) == {0, 20, 40}
    assert search(df.where("false"), F.expr("vec_id % 20 = 0")).count() == 0


def tables():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 64)) * 3
    mixed = rng.standard_normal((2000, 64))
    mixed[::97] *= 50
    unit = rng.standard_normal((1500, 96))
    return {
        "random": rng.standard_normal((2000, 64)), "mixed": mixed, "unit": unit / np.linalg.norm(unit, axis=1, keepdims=True),
        "clustered": centres[rng.integers(0, 20, 1500)] + rng.standard_normal((1500, 64)) * 0.7,
    }


@pytest.mark.parametrize("name", ["random", "mixed", "unit", "clustered"])
def test_recall_holds_on_other_tables(spark, name):
    x = tables()[name]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, F.expr("vec_id % 20 = 0"), block=1024).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits, total = hits + len(set(np.argsort(-scores)[:20].tolist()) & got[q]), total + 20
    assert hits >= 0.9 * total


def test_vanishing_and_huge_vectors_end(spark):
    rows = [(i, [1e-200 * (i + 1), 1e-200]) for i in range(40)] + [(100 + i, [1e200, float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, F.expr("vec_id % 20 = 0"), k=3).collect()
    assert sorted({r["query_id"] for r in got}) == [0, 20, 100] and len(got) == 9
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 20 and r["rank"] <= 3) == [100, 101, 102]
