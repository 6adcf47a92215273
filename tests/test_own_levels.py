"""Every key keeps its own levels, reference and columns."""

import pytest

from gapscope.operators import prep as P

SPEC = P.DesignSpec(["x", "c", "z"], [P.Categorical("c")])


def state(spark, rows):
    df = spark.createDataFrame(rows, "k string, row_id long, x double, c string, z double")
    return df, P.fit_medians(df, ["k"], ["x", "z"]), P.fit_categories(df, ["k"], SPEC.categorical)


def test_keys_keep_their_own_reference(spark):
    rows = [("A", 1, 1.0, "b", 5.0), ("A", 2, None, "c", 6.0), ("B", 3, 2.0, "a", 7.0), ("B", 4, 4.0, "b", None), ("B", 5, 4.0, "c", 9.0), (None, 6, 0.5, "q", 1.0)]
    df, medians, categories = state(spark, rows)
    new = df.union(spark.createDataFrame([("A", 7, 3.0, "a", 1.0), ("B", 8, 3.0, None, 1.0)], df.schema))
    got = {r["row_id"]: (r["size"], r["indices"], r["values"]) for r in P.sparse_design(new, ["k"], SPEC, medians, categories, ["row_id"]).collect()}
    assert got[1] == (3, [0, 2], [1.0, 5.0])  # b is A's reference
    assert got[2] == (3, [0, 1, 2], [1.0, 1.0, 6.0])
    assert got[4] == (4, [0, 1, 3], [4.0, 1.0, 8.0])  # and an indicator of B
    assert got[5] == (4, [0, 2, 3], [4.0, 1.0, 9.0])
    assert got[6] == (2, [0, 1], [0.5, 1.0])
    assert got[7] == (3, [0, 2], [3.0, 1.0]) and got[8] == (4, [0, 3], [3.0, 1.0])  # unseen and missing levels set nothing
    blocks = P.expand_blocks_by_key({"all": ["c", "x"]}, medians, categories, ["k"]).collect()
    assert {r["column"] for r in blocks if r["k"] == "A"} == {"x", "c_c"} and {r["column"] for r in blocks if r["k"] == "B"} == {"x", "c_b", "c_c"}
    with pytest.raises(ValueError, match="sparse_design"):
        P.level_lists(categories, SPEC)


def test_many_levels_are_joined(spark):
    df = spark.range(100_000).selectExpr("'A' as k", "id as row_id", "1.0D as x", "lpad(cast(id as string), 6, '0') as c", "2.0D as z")
    medians, categories = P.fit_medians(df, ["k"], ["x", "z"]), P.fit_categories(df, ["k"], SPEC.categorical)
    found = P.sparse_design(df, ["k"], SPEC, medians, categories, ["row_id"])
    r = found.where("row_id = 77777").first()
    assert (r["size"], r["indices"], r["values"]) == (100_001, [0, 77_777, 100_000], [1.0, 1.0, 2.0])
    assert found.where("size(indices) = 2").count() == 1


def test_empty_table(spark):
    df, medians, categories = state(spark, [])
    assert P.sparse_design(df, ["k"], SPEC, medians, categories, ["row_id"]).count() == 0
