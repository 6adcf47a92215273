"""Output contracts: exact ordered columns with types, checked fail-closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names and order of the exchanged tables.
SCORED_COLUMNS = (
    "dataset", "comparison_type", "comparison", "row_id", "cluster_id", "subgroup", "y_true",
    "prob_calibrated", "prob_uncalibrated", "y_pred_at_threshold", "selected_family",
    "operating_threshold",
)
SWEEP_METRICS = (
    "sensitivity", "specificity", "fnr", "fpr", "ppv", "npv", "predicted_positive_rate",
)
ROBUSTNESS_METRICS = ("sensitivity_gap", "fnr_gap", "ppv_gap_raw", "ppv_gap_adj", "ppr_gap")
ROBUSTNESS_STATISTICS = ("mean", "std", "min", "max")
FIGURE_COLUMNS = (
    "dataset", "protected_attribute", "comparison_label", "group_a", "group_b",
    "sensitivity_gap", "ci_low", "ci_high", "significance", "analysis_status",
    "display_order", "source_result_path",
)

PERFORMANCE_COLUMNS = (
    "dataset", "comparison_type", "comparison", "group", "group_value", "n", "n_events", "selected_family",
    "operating_threshold", "auroc", "auroc_ci_low", "auroc_ci_high", "auprc", "ci_method", "ci_level", "n_boot",
    "resampling_unit", "resampling_design", "n_resampling_units", "n_units_spanning_subgroups",
)
CALIBRATION_COLUMNS = (
    "dataset", "comparison_type", "comparison", "group", "group_value", "n", "n_events", "brier", "brier_ci_low",
    "brier_ci_high", "calib_intercept", "calib_intercept_ci_low", "calib_intercept_ci_high", "calib_slope",
    "calib_slope_ci_low", "calib_slope_ci_high", "calib_status", "calib_slope_valid_replicates",
    "calib_slope_failed_replicates", "calib_replicate_status_counts", "calib_n_clipped", "ece", "ci_method", "n_boot",
    "resampling_unit",
)
#: Columns of a comparison's performance file: those of both tables.
EXPORT_COLUMNS = (*PERFORMANCE_COLUMNS, *[c for c in CALIBRATION_COLUMNS if c not in PERFORMANCE_COLUMNS])

_D, _L, _S, _I = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType()

SCORED_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in zip(SCORED_COLUMNS, (_S, _S, _S, _L, _S, _S, _I, _D, _D, _I, _S, _D))
    ]
)


def sweep_columns() -> list[str]:
    out = ["threshold"]
    for m in SWEEP_METRICS:
        out += [f"{m}_A", f"{m}_B", f"{m}_gap"]
    return [*out, "disparate_impact_ratio"]


def robustness_columns() -> list[str]:
    return ["dataset"] + [f"{m}_{s}" for m in ROBUSTNESS_METRICS for s in ROBUSTNESS_STATISTICS]


class ContractError(ValueError):
    """An output does not have the documented columns."""


def check_columns(df: DataFrame, expected: list[str] | tuple[str, ...]) -> DataFrame:
    """Exact names in exact order; the message lists what is missing or extra."""
    actual, expected = list(df.columns), list(expected)
    if actual != expected:
        missing = [c for c in expected if c not in actual]
        extra = [c for c in actual if c not in expected]
        raise ContractError(f"schema mismatch: missing={missing} unexpected={extra} actual={actual}")
    return df


def check_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    check_columns(df, schema.names)
    wrong = [
        (a.name, a.dataType.simpleString(), e.dataType.simpleString())
        for a, e in zip(df.schema.fields, schema.fields)
        if a.dataType != e.dataType
    ]
    if wrong:
        raise ContractError(f"type mismatch (column, actual, expected): {wrong}")
    return df
