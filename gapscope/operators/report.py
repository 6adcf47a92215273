"""Report tables assembled from result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import COUNTS, excludes_zero
from ..schema import (
    CALIBRATION_COLUMNS,
    EXPORT_COLUMNS,
    FIGURE_COLUMNS,
    PERFORMANCE_COLUMNS,
    ROBUSTNESS_METRICS,
    check_columns,
    robustness_columns,
)
from ..session import null_safe_join

# Display order of comparison types and expected figure composition.
TYPE_ORDER = ("sex", "age", "race", "race_secondary")
FIGURE_COUNTS = {"sex": 5, "age": 5, "race/ethnicity": 3}
FIGURE_ROWS = 13
# Fixed value: name of the interval method.
CI_METHOD = "percentile"


def robustness_summary(results: DataFrame, key: str = "dataset") -> DataFrame:
    """Mean, sample sd, min and max of five gaps per data set, with fixed names."""
    functions = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    cols = [f(m).alias(f"{m}_{s}") for m in ROBUSTNESS_METRICS for s, f in functions.items()]
    return check_columns(results.groupBy(key).agg(*cols), robustness_columns())


def stability_direction(gaps: DataFrame, keys: list[str], value: str = "gap") -> DataFrame:
    """Sign stability over repeated splits; a tie counts as negative."""
    v = F.col(value)
    out = gaps.groupBy(*keys).agg(
        F.avg(v).alias("mean_gap"), F.stddev_pop(v).alias("sd_gap"),
        F.min(v).alias("min_gap"), F.max(v).alias("max_gap"),
        F.count_if(v > 0).alias("n_positive_dir"), F.count_if(v < 0).alias("n_negative_dir"),
    )
    majority = F.greatest("n_positive_dir", "n_negative_dir")
    return out.select(
        "*",
        F.when(F.col("n_positive_dir") > F.col("n_negative_dir"), "positive")
        .otherwise("negative").alias("majority_direction"),
        majority.alias("n_seeds_majority"), (majority >= 9).alias("stable"),
    )


def status_counts(replicates: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """JSON object of replicate counts by status, in alphabetical order."""
    counts = replicates.groupBy(*keys, status).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(status), F.col("n"))))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("status_counts"))


def report_explode(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Denominator rows and long metric rows of nested analysis records.

    Expects ``dataset, command_id, analysis_role, protected_attribute,
    comparison, group_a, group_b`` with each group a struct of label, counts and
    a map metric -> interval struct.
    """
    base = ["dataset", "command_id", "analysis_role", "protected_attribute", "comparison"]
    groups = records.select(*base, F.explode(F.array("group_a", "group_b")).alias("g"))
    denominators = groups.select(*base, F.col("g.label").alias("group"), "g.counts.*")
    metrics = groups.select(
        *base, F.col("g.label").alias("group"), F.explode("g.metrics").alias("metric", "v")
    ).select(
        *base, "group", "metric", F.col("v.point").alias("estimate"), "v.ci_low", "v.ci_high",
        "v.numerator", "v.denominator",
    )
    return denominators, metrics


def analysis_role(
    command: Column, comparison: Column, primary_commands: list[str], guarded_command: str,
    primary_comparisons: list[str],
) -> Column:
    return (
        F.when(~command.isin(primary_commands), "supplement_recomputation")
        .when(
            (command == guarded_command) & ~comparison.isin(primary_comparisons),
            "prespecified_secondary_supplement",
        )
        .otherwise("primary")
    )


def type_rank(kind: Column | str) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(9)
    for i, name in reversed(list(enumerate(TYPE_ORDER))):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def performance_tables(
    performance: DataFrame, discrimination: list[str], calibration: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Two ordered projections of the united performance rows."""
    missing = [c for c in {*discrimination, *calibration} if c not in performance.columns]
    if missing:
        raise RuntimeError(f"performance rows lack columns: {sorted(missing)}")
    ordered = performance.orderBy(type_rank("comparison_type"), "dataset", "group")
    return ordered.select(*discrimination), ordered.select(*calibration)


def report_lookup(results: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows named by an ordered request table; each must exist exactly once."""
    found = results.groupBy(*on).agg(F.count("*").alias("_n"))
    checked = null_safe_join(wanted, found, on, "left").withColumn(
        "_ok",
        F.when(F.coalesce(F.col("_n"), F.lit(0)) != 1, F.raise_error(F.lit("a requested row is missing or repeated")))
        .otherwise(F.lit(True)).cast("boolean"),
    )
    return null_safe_join(checked.where("_ok").drop("_n", "_ok"), results, on)


def figure_violations(figure: DataFrame) -> DataFrame:
    """One row per broken rule of the 13-point gap table; empty when it is complete."""
    check_columns(figure, FIGURE_COLUMNS)
    text = [f.name for f in figure.schema.fields if f.dataType.simpleString() == "string"]
    nulls, blank = F.lit(False), F.lit(False)
    for c in FIGURE_COLUMNS:
        nulls = nulls | F.col(c).isNull()
    for c in text:
        blank = blank | (F.trim(F.col(c)) == "")
    attribute, label = F.col("protected_attribute"), F.col("comparison_label")
    is_race = attribute == "race/ethnicity"
    expected_status = F.when(F.col("dataset").startswith("NHANES"), "exploratory").otherwise("primary")
    measured = figure.agg(
        F.count("*").alias("n"),
        F.count_if(nulls).alias("missing_field"),
        F.count_if(blank).alias("empty_text"),
        F.count_if((F.col("display_order") < 1) | (F.col("display_order") > FIGURE_ROWS)).alias("order_range"),
        F.count_distinct("display_order").alias("orders"),
        *[F.count_if(attribute == a).alias(f"n_{i}") for i, a in enumerate(FIGURE_COUNTS)],
        F.count_if(is_race & F.col("dataset").rlike("CDC|CCHS")).alias("race_dataset"),
        F.count_if(is_race & label.rlike("(?i)hispanic|multiracial")).alias("secondary_race"),
        F.count_if(F.col("significance") != excludes_zero(F.col("ci_low"), F.col("ci_high"))).alias("significance"),
        F.count_if(F.col("analysis_status") != expected_status).alias("status"),
    )
    composition = F.lit(False)
    for i, n in enumerate(FIGURE_COUNTS.values()):
        composition = composition | (F.col(f"n_{i}") != n)
    rules = {
        "exactly 13 rows": F.col("n") != FIGURE_ROWS,
        "no missing field": F.col("missing_field") > 0,
        "no empty text": F.col("empty_text") > 0,
        "display order 1..13": (F.col("order_range") > 0) | (F.col("orders") != FIGURE_ROWS),
        "5 sex, 5 age, 3 race rows": composition,
        "race data sets": F.col("race_dataset") > 0,
        "no secondary race comparison": F.col("secondary_race") > 0,
        "significance matches the interval": F.col("significance") > 0,
        "analysis status": F.col("status") > 0,
    }
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("broken")) for r, c in rules.items()])
    return measured.select(F.explode(rows).alias("_r")).select("_r.*").where("broken").select("rule")


def display_order(rows: DataFrame, order: list[Column], name: str = "display_order") -> DataFrame:
    """Number a result table for display (a single ordered window over result rows)."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def scored_export(
    scored: DataFrame, evaluated: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Check an export against the evaluated rows before it is written.

    Returns one row of violation counts: rows missing, missing clusters,
    outcomes or probabilities that differ, predictions that contradict the
    threshold rule. All must be zero.
    """
    other = evaluated.select(
        F.col(row_id), F.col("y_true").alias("_y"), F.col("prob_calibrated").alias("_p")
    )
    joined = scored.join(other, row_id, "full_outer")
    rule = (F.col("prob_calibrated") >= F.col("operating_threshold")).cast("int")
    return joined.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("_y").isNull() | F.col("y_true").isNull()).alias("n_unmatched"),
        F.count_if(F.col("cluster_id").isNull()).alias("n_missing_cluster"),
        F.count_if(F.col("y_true") != F.col("_y")).alias("n_outcome_differs"),
        F.count_if(~F.col("prob_calibrated").eqNullSafe(F.col("_p"))).alias("n_probability_differs"),
        F.count_if(F.col("y_pred_at_threshold") != rule).alias("n_prediction_differs"),
    )


def performance_rows(
    metrics: DataFrame, intervals: DataFrame, statuses: DataFrame, keys: list[str],
    groups: dict[str, str], group: str = "subgroup",
) -> DataFrame:
    """Overall and per-group metrics beside bootstrap limits and status counts.

    ``metrics`` has a row per group and one for ``overall``; ``intervals`` and
    ``statuses`` come from the bootstrap, where groups are called a and b.
    """
    scope = F.lit("overall")
    for side, label in groups.items():
        scope = F.when(F.col(group) == F.lit(label), F.lit(side)).otherwise(scope)
    left = metrics.withColumn("scope", scope)
    named = intervals.where(F.col("metric").rlike("^(auroc|brier|intercept|slope)_(a|b|overall)$"))
    parts = named.withColumn("scope", F.regexp_extract("metric", "_(a|b|overall)$", 1)).withColumn(
        "stat", F.regexp_extract("metric", "^([a-z]+)_", 1)
    )
    cells = []
    for stat in ("auroc", "brier", "intercept", "slope"):
        here = F.col("stat") == stat
        stem = stat if stat in ("auroc", "brier") else f"calib_{stat}"
        cells += [
            F.max(F.when(here, F.col("ci_low"))).alias(f"{stem}_ci_low"),
            F.max(F.when(here, F.col("ci_high"))).alias(f"{stem}_ci_high"),
        ]
        if stat in ("intercept", "slope"):
            cells.append(F.max(F.when(here, F.col("point"))).alias(stem))
        if stat == "slope":
            cells += [
                F.max(F.when(here, F.col("n_valid_replicates"))).alias("calib_slope_valid_replicates"),
                F.max(F.when(here, F.col("n_failed_replicates"))).alias("calib_slope_failed_replicates"),
            ]
    wide = parts.groupBy(*keys, "scope").agg(*cells)
    joined = null_safe_join(null_safe_join(left, wide, [*keys, "scope"], "left"), statuses, [*keys, "scope"], "left")
    return joined.drop("scope")


def performance_export(
    rows: DataFrame, design: DataFrame, keys: list[str], named: dict[str, Column], n_boot: int, level: float = 0.95, group: str = "subgroup",
) -> DataFrame:
    """The performance file of comparisons: :func:`performance_rows` with all columns of the contract.

    ``design`` is the bootstrap's description per comparison; ``named`` gives dataset,
    comparison_type, comparison, selected_family, operating_threshold and the group's label.
    """
    joined = null_safe_join(rows, design.drop("n_observations"), keys)
    out = joined.select(
        *[named[c].alias(c) for c in ("dataset", "comparison_type", "comparison", "group", "selected_family", "operating_threshold")],
        F.col(group).cast("string").alias("group_value"), F.col("n_pos").alias("n_events"),
        *[c for c in ("n", "auroc", "auroc_ci_low", "auroc_ci_high", "auprc", "brier", "brier_ci_low", "brier_ci_high")],
        "calib_intercept", "calib_slope",
        *[f"calib_{s}_ci_{e}" for s in ("intercept", "slope") for e in ("low", "high")],
        "calib_status", "calib_slope_valid_replicates", "calib_slope_failed_replicates",
        F.col("status_counts").alias("calib_replicate_status_counts"), "calib_n_clipped", "ece",
        F.lit(CI_METHOD).alias("ci_method"), F.lit(float(level)).alias("ci_level"),
        F.lit(n_boot).alias("n_boot"), "resampling_unit", "resampling_design", "n_resampling_units", "n_units_spanning_subgroups",
    )
    return check_columns(out.select(*EXPORT_COLUMNS), EXPORT_COLUMNS)


def united_performance(files: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both reporting tables from the performance files of all comparisons."""
    if not files:
        raise RuntimeError("no performance file to report")
    united = files[0]
    for f in files[1:]:
        united = united.unionByName(f)
    return performance_tables(united, list(PERFORMANCE_COLUMNS), list(CALIBRATION_COLUMNS))


class ExportError(RuntimeError):
    """An export does not hold the evaluated rows."""


def with_cluster_tokens(rows: DataFrame, tokens: DataFrame, keys: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Rows with their cluster's token; a row without a cluster fails the job instead of vanishing."""
    joined = null_safe_join(rows, tokens, [*keys, cluster], "left")
    message = F.lit("cluster identifiers are missing for some held-out rows; clustered inference would be unreliable")
    return joined.withColumn("cluster_token", F.when(F.col("cluster_token").isNull(), F.raise_error(message)).otherwise(F.col("cluster_token")))


def require_export(scored: DataFrame, evaluated: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``scored`` itself, after every check of :func:`scored_export` found nothing."""
    found = scored_export(scored, evaluated, row_id).first().asDict()
    broken = {k: v for k, v in found.items() if k != "n_rows" and v}
    if broken:
        raise ExportError(f"the export differs from the evaluated rows: {broken}")
    return scored
