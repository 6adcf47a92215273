"""Multinomial draws down a split tree, score ranges, and cluster weights where the cells lie."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapscope.operators import resample as RS


def draws(spark, masses, n_boot, seed=1, fan_out=None, monkeypatch=None):
    if fan_out:
        monkeypatch.setattr(RS, "FAN_OUT", fan_out)
    df = spark.createDataFrame([("k", i, m) for i, m in enumerate(masses)], "k string, b int, m long").repartition(4)
    got = RS._bucket_draws(df, ["k"], "b", "m", n_boot, seed).orderBy("b").collect()
    assert [r["b"] for r in got] == list(range(len(masses))) and [r["_mass"] for r in got] == list(masses)
    return np.array([r["_draws"] for r in got])


def test_tree_draws_follow_the_multinomial_law(spark, monkeypatch):
    masses = [int(m) for m in np.random.default_rng(4).integers(1, 60, 70)]
    n, boots = sum(masses), 4000
    got = draws(spark, masses, boots, fan_out=4, monkeypatch=monkeypatch)  # four levels of nodes
    assert (got.sum(axis=0) == n).all()
    p = np.array(masses) / n
    assert got.mean(axis=1) == pytest.approx(n * p, abs=5 * np.sqrt(n * p.max() / boots))
    cov = np.cov(got)
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.abs(cov - want).max() < 0.12 * want.max()


def test_more_buckets_than_a_task_may_hold(spark, monkeypatch):
    seen = draws(spark, [3] * 2500, 20, fan_out=16, monkeypatch=monkeypatch)
    assert seen.shape == (2500, 20) and (seen.sum(axis=0) == 7500).all()
    again = draws(spark, [3] * 2500, 20, fan_out=16, monkeypatch=monkeypatch)
    assert (seen == again).all()


def test_a_band_of_scores_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(RS, "RANKED", 5000)
    cells = spark.range(60_000).selectExpr(
        "'k' as k", "cast(id % 2 as tinyint) as _side", "0.5 + id * 1e-11 as _prob", "cast(1 as tinyint) as _pred", "cast(0 as tinyint) as _y", "1L as _n"
    )
    asked = []
    plain = RS.prefix_sums
    monkeypatch.setattr(RS, "prefix_sums", lambda df, *a, **k: asked.append(df) or plain(df, *a, **k))
    got = RS._score_buckets(cells, ["k"])
    assert got.count() == 60_000
    held = [r["count"] for r in asked[0].groupBy("_p").count().collect()]
    assert len(held) == 12 and max(held) < 4 * 5000
    spans = got.groupBy("_b").agg(F.count("*").alias("n"), F.min("_prob").alias("lo"), F.max("_prob").alias("hi")).orderBy("_b").collect()
    assert max(r["n"] for r in spans) <= RS.BUCKET_MEMBERS and all(x["hi"] < y["lo"] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("share", [50_000, 7])
def test_cluster_weights_are_one_multiplicity_per_cluster(spark, monkeypatch, share):
    monkeypatch.setattr(RS, "WEIGHTED", share)
    rng = np.random.default_rng(6)
    n = 400
    pdf = pd.DataFrame({"k": "k", "c": [f"c{v}" for v in np.where(rng.uniform(size=n) < 0.3, 0, rng.integers(0, 50, n))]})
    pdf["g"], pdf["y_true"] = rng.choice(["A", "B"], n), rng.integers(0, 2, n)
    pdf["prob"] = np.round(rng.uniform(size=n), 2)
    pdf["pred"] = (pdf.prob >= 0.5).astype(int)
    packed = RS.weighted_cells_by_cluster(spark.createDataFrame(pdf), ["k"], "g", "A", "B", "c", 30, 9, "y_true", "prob", "pred").collect()
    clusters = sorted(pdf.c.unique())
    masses = spark.createDataFrame([("k", 0, len(clusters))], "k string, _cb int, _m long")
    drawn = RS._bucket_draws(masses, ["k"], "_cb", "_m", 30, 9).toPandas()
    w = RS._weights(drawn, len(clusters), ("k", np.int32(0)), 9)
    want = {}
    for r in pdf.itertuples():
        key = (0 if r.g == "A" else 1, r.prob, r.pred, r.y_true)
        want[key] = want.get(key, 0) + np.concatenate(([1], w[:, clusters.index(r.c)]))
    got = {}
    for row in packed:
        prob, side, pred, y, weights = RS._unpack(row, 30)
        for i in range(len(prob)):
            got[int(side[i]), float(prob[i]), int(pred[i]), int(y[i])] = weights[:, i]
    assert sorted(got) == sorted(want)
    assert all((got[k] == want[k]).all() for k in want)


def many_clusters(n=3000):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": "k", "c": rng.integers(0, n // 2, n), "g": rng.choice(["A", "B"], n), "y_true": rng.integers(0, 2, n)})
    pdf["prob"] = np.round(rng.uniform(size=n), 1)
    pdf["pred"] = (pdf.prob >= 0.5).astype(int)
    return pdf


def test_weight_vectors_do_not_grow_with_clusters(spark, monkeypatch):
    monkeypatch.setattr(RS, "BUCKET_MEMBERS", 16)  # some eighty buckets of clusters
    monkeypatch.setattr(RS, "WEIGHTED", 10)
    pdf = many_clusters()
    sums = RS.cluster_weight_sums(spark.createDataFrame(pdf), ["k"], "g", "A", "B", "c", 12, 9, "y_true", "prob", "pred").toPandas()
    cells = pdf.groupby(["g", "prob", "pred", "y_true"]).size()
    assert len(sums) <= RS.MERGED * len(cells)
    total = np.array([np.frombuffer(w, dtype=np.int64) for w in sums["_w"]]).sum(axis=0)
    assert total[0] == len(pdf) and abs(total[1:] - len(pdf)).max() < 0.2 * len(pdf)


def test_clusters_are_drawn_by_kind(spark, monkeypatch):
    pdf = many_clusters()
    df = spark.createDataFrame(pdf)
    sizes = []
    plain = RS._bucket_draws
    monkeypatch.setattr(RS, "_bucket_draws", lambda m, *a: sizes.append(m.count()) or plain(m, *a))
    kinds = RS.kind_count_replicates(df, ["k"], "g", "A", "B", "c", 3000).toPandas()
    assert sizes == [1]
    each = RS.cluster_count_replicates(df, ["k"], "g", "A", "B", "c", 3000).toPandas()
    one, two = (d.set_index("replicate").sort_index()[list(RS.SIDES)] for d in (kinds, each))
    assert (one.loc[0] == two.loc[0]).all()
    one, two = one.loc[1:], two.loc[1:]
    assert np.abs(one.mean() - two.mean()).max() < 6 * two.std().max() / 3000**0.5
    assert np.abs(np.cov(one.T) / np.cov(two.T).max() - np.cov(two.T) / np.cov(two.T).max()).max() < 0.12
    table = RS.cluster_vs_naive(df, ["k"], "g", "A", "B", "c", 50)
    assert sizes[-1] == 1 and table.count() == 5
