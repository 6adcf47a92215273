"""Exports fail closed and carry the whole contract."""

import pytest

from gapscope.operators import report as RP
from gapscope.operators import resample as RS
from gapscope.plans import modelling
from gapscope.schema import CALIBRATION_COLUMNS, EXPORT_COLUMNS, PERFORMANCE_COLUMNS

SCORED = "row_id long, cluster_id string, y_true int, prob_calibrated double, operating_threshold double, y_pred_at_threshold int"


def scored(spark, change=None):
    rows = [[i, f"P{i}", i % 2, i / 10, 0.5, int(i >= 5)] for i in range(10)]
    if change:
        i, column, value = change
        rows[i][column] = value
    return spark.createDataFrame([tuple(r) for r in rows], SCORED)


@pytest.mark.parametrize("change", [(3, 1, None), (3, 2, 0), (3, 3, 0.31), (3, 3, None), (9, 5, 0), (3, 0, 77)])
def test_a_changed_export_is_refused(spark, change):
    evaluated = scored(spark).select("row_id", "y_true", "prob_calibrated")
    assert RP.require_export(scored(spark), evaluated).count() == 10
    with pytest.raises(RP.ExportError):
        RP.require_export(scored(spark, change), evaluated)


def test_a_row_without_a_cluster_fails(spark):
    rows = spark.createDataFrame([("k", "c1", 1), ("k", None, 2)], "k string, cluster_id string, row_id long")
    tokens = spark.createDataFrame([("k", "c1", "P000001")], "k string, cluster_id string, cluster_token string")
    assert RP.with_cluster_tokens(rows.where("row_id = 1"), tokens, ["k"]).first()["cluster_token"] == "P000001"
    with pytest.raises(Exception, match="cluster identifiers are missing"):
        RP.with_cluster_tokens(rows, tokens, ["k"]).collect()


def test_performance_files_have_the_contract(spark):
    assert (len(PERFORMANCE_COLUMNS), len(CALIBRATION_COLUMNS)) == (20, 25)
    file = modelling.performance_file(spark, "/root/testdata/sf0.001", 3)
    assert tuple(file.columns) == EXPORT_COLUMNS
    first, second = RP.united_performance([file, file.limit(0)])
    assert tuple(first.columns) == PERFORMANCE_COLUMNS and tuple(second.columns) == CALIBRATION_COLUMNS
    rows = first.collect()
    assert len(rows) == 21 and {r["group_value"] for r in rows} == {"overall", "BUILDING", "MACHINERY"} and {r["n_boot"] for r in rows} == {3}
    with pytest.raises(RuntimeError):
        RP.united_performance([])


def test_a_third_group_is_refused(spark):
    df = spark.createDataFrame([("k", g, i % 2, i % 3 % 2) for i, g in enumerate("ABABABAB")], "k string, g string, y_true int, pred int")
    assert RS.permutation_group(df, ["k"], "g", "A", "B", 5).count() == 5
    with pytest.raises(Exception, match="exactly two groups"):
        RS.permutation_group(df.union(spark.createDataFrame([("k", "C", 1, 1)], df.schema)), ["k"], "g", "A", "B", 5).collect()
