"""Running row numbers, tokens in ranges, one-pass selections, comparisons without a key."""

import pytest
from pyspark.sql import functions as F

from gapscope.operators import compare as C
from gapscope.operators import ranking as K
from gapscope.operators import splits as S


def test_rows_of_files_are_numbered_in_file_order(spark, tmp_path):
    for name, first in (("b", 0), ("a", 100), ("c", 7)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "\n".join(f"{name}{first + i}" for i in range(5 if name == "a" else 40)) + "\n")
    df = spark.read.csv(str(tmp_path), header=True)
    got = [r["v"] for r in K.numbered_rows(df).orderBy("_position").collect()]
    assert got == [f"a{100 + i}" for i in range(5)] + [f"b{i}" for i in range(40)] + [f"c{7 + i}" for i in range(40)]
    rows = K.numbered_rows(spark.range(1000).repartition(7).withColumn("x", F.lit(1))).collect()
    assert sorted(r["_position"] for r in rows) == list(range(1000))
    assert K.numbered_rows(df.limit(0)).count() == 0


def test_comparison_by_position(spark):
    old = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "x"), ("c", 3.0, "y")], "s string, auroc double, t string").coalesce(1)
    new = spark.createDataFrame([("a", 1.0 + 4e-6, None), ("B", None, "x")], "s string, auroc double, t string").coalesce(1)
    got = {(r["row_key"], r["column"]): (r["classification"], r["baseline"], r["difference"]) for r in C.run_diff(old, new, []).collect()}
    assert got == {
        ("0", "auroc"): ("WITHIN_TOLERANCE", "1.0", "+0.000004"), ("1", "s"): ("TYPE_OR_TEXT", "b", "text differs"),
        ("1", "auroc"): ("CHANGED", "2.0", "missingness differs"), ("", ""): ("STRUCTURE", "rows=3", "row count differs"),
    }
    files = C.compare_runs({"x": old, "y": old}, {"x": old, "z": old}, {"x": ["s"]}).collect()
    assert {(r["file"], r["classification"], r["difference"]) for r in files} == {("y", "STRUCTURE", "file only in baseline"), ("z", "NEW_OUTPUT", "file only in candidate")}


def test_an_odd_id_beside_a_common_prefix(spark, monkeypatch):
    monkeypatch.setattr(S, "TOKEN_RANGE", 5000)
    ids = spark.range(60_000).selectExpr("'k' as k", "concat('hospital-unit-7-patient-', lpad(cast(id as string), 8, '0')) as cluster_id")
    df = ids.union(spark.createDataFrame([("k", "?")], ids.schema))
    asked = []
    plain = K.prefix_sums
    monkeypatch.setattr(K, "prefix_sums", lambda cells, *a, **o: asked.append(cells) or plain(cells, *a, **o))
    got = S.dense_cluster_token(df, ["k"])
    assert max(r["count"] for r in asked[0].groupBy("_p").count().collect()) < 4 * 5000
    rows = got.where("cluster_id = '?' or cluster_id like '%00000000' or cluster_id like '%00059999'").collect()
    assert sorted((r["cluster_id"][-8:], r["cluster_token"]) for r in rows) == [("00000000", "P000002"), ("00059999", "P060001"), ("?", "P000001")]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_selections_of_all_plans_have_exact_sizes(spark, keys):
    df = spark.range(5000).selectExpr("id as row_id", "id % 2 as k", "case when id % 5 = 0 then 'A' else 'B' end as g", "cast(id % 3 = 0 as int) as y")
    out = S.balanced_training(df, keys, "g", "A", "B", "y").toPandas()
    assert len(out) == 5000 and list(out.columns[:4]) == df.columns
    for _, part in out.groupby(keys) if keys else [(None, out)]:
        n = {g: (part.g == g).sum() for g in "AB"}
        p = {g: ((part.g == g) & (part.y == 1)).sum() for g in "AB"}
        for g in "AB":
            mine = part[part.g == g]
            assert mine.w_equal_sample_size.notna().sum() == min(n.values())
            assert mine[mine.y == 1].w_equal_positive_cases.notna().sum() == min(p.values())
            assert mine[mine.y == 1].w_equal_prevalence.notna().sum() == round(min(p[x] / n[x] for x in "AB") * n[g])
            assert mine[mine.y == 0].w_equal_prevalence.notna().all()


def test_one_group_leaves_no_equal_sample(spark):
    df = spark.range(50).selectExpr("id as row_id", "'A' as g", "cast(id % 2 as int) as y")
    out = S.balanced_training(df, [], "g", "A", "B", "y").toPandas()
    assert out.w_equal_sample_size.isna().all() and out.w_original.notna().all()
    assert S.balanced_training(df.limit(0), [], "g", "A", "B", "y").count() == 0
