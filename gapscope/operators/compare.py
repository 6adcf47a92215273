"""Run-to-run comparison of result tables and reproducibility rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import null_safe_join
from .ranking import numbered_rows

# Name fragments of continuous diagnostics and their tolerance.
CONTINUOUS_FRAGMENTS = ("auroc", "brier", "calib", "ece", "auprc", "prob")
CONTINUOUS_TOLERANCE = 1e-5
STRICT_TOLERANCE = 1e-12
# Acceptance rule of each field class.
FIELD_CLASSES = {
    "selected_model_family": ("exact", 0.0),
    "operating_threshold": ("exact", 0.0),
    "subgroup_and_event_counts": ("exact", 0.0),
    "manuscript_metrics_and_bootstrap_confidence_intervals": ("absolute", STRICT_TOLERANCE),
    "direction_and_significance": ("exact", 0.0),
    "schemas_and_output_paths": ("exact", 0.0),
    "continuous_auroc_and_calibrated_score_diagnostics": ("absolute", CONTINUOUS_TOLERANCE),
}


def column_tolerance(name: Column) -> Column:
    hit = F.lit(False)
    for fragment in CONTINUOUS_FRAGMENTS:
        hit = hit | F.contains(F.lower(name), F.lit(fragment))
    return F.when(hit, F.lit(CONTINUOUS_TOLERANCE)).otherwise(F.lit(0.0))


def _cells(df: DataFrame, keys: list[str], columns: list[str], side: str) -> DataFrame:
    """One row per cell: its text and, for numeric columns, its number."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(c).cast("string").alias(f"{side}_text"),
                    (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias(
                        f"{side}_number"
                    ),
                    F.lit(c in numeric).alias(f"{side}_numeric"),
                )
                for c in columns
            ]
        )
    )
    return df.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def run_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Differences between two tables aligned on ``keys``, one row per difference.

    Equal cells are not reported. Structure rows name columns or keys present on
    one side only. Without keys rows are aligned by their position in the table: tables of different
    length give one structure row with both lengths, and positions that both have are compared.
    """
    if not keys:
        return _positional_diff(old, new)
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    one_sided = [(c, "column only in baseline") for c in old.columns if c not in new.columns]
    one_sided += [(c, "column only in candidate") for c in new.columns if c not in old.columns]
    row_key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])

    missing = null_safe_join(old.select(*keys), new.select(*keys), keys, "left_anti")
    added = null_safe_join(new.select(*keys), old.select(*keys), keys, "left_anti")

    def structure(df: DataFrame, base: str, cand: str, text: str) -> DataFrame:
        return df.select(
            row_key.alias("row_key"), F.lit("").alias("column"),
            F.lit("STRUCTURE").alias("classification"), F.lit(base).alias("baseline"),
            F.lit(cand).alias("candidate"), F.lit(text).alias("difference"),
        )

    both = null_safe_join(
        _cells(old, keys, shared, "o"), _cells(new, keys, shared, "n"), [*keys, "column"]
    )
    numeric = F.col("o_numeric") & F.col("n_numeric")
    delta = F.col("n_number") - F.col("o_number")
    one_null = F.col("o_text").isNull() != F.col("n_text").isNull()
    kind = (
        F.when(numeric & one_null, "CHANGED")
        .when(numeric & (F.abs(delta) <= column_tolerance(F.col("column"))) & (delta != 0), "WITHIN_TOLERANCE")
        .when(numeric & (delta != 0), "CHANGED")
        .when(~numeric & ~F.col("o_text").eqNullSafe(F.col("n_text")), "TYPE_OR_TEXT")
    )
    text = (
        F.when(numeric & one_null, F.lit("missingness differs"))
        .when(numeric, F.format_string("%+.6f", delta))
        .otherwise(F.lit("text differs"))
    )
    cells = both.withColumn("classification", kind).where("classification is not null").select(
        row_key.alias("row_key"), "column", "classification",
        F.col("o_text").alias("baseline"), F.col("n_text").alias("candidate"),
        text.alias("difference"),
    )
    out = (
        cells.unionByName(structure(missing, "present", "absent", "row only in baseline"))
        .unionByName(structure(added, "absent", "present", "row only in candidate"))
    )
    if one_sided:
        names = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in one_sided])
        head = old.sparkSession.range(1).select(F.explode(names).alias("_x"))
        out = out.unionByName(
            head.select(
                F.lit("").alias("row_key"), F.col("_x.c").alias("column"),
                F.lit("STRUCTURE").alias("classification"), F.lit("").alias("baseline"),
                F.lit("").alias("candidate"), F.col("_x.t").alias("difference"),
            )
        )
    return out


def _positional_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of two tables without a key, aligned by running row numbers."""
    first, second = numbered_rows(old, "_position"), numbered_rows(new, "_position")
    found = run_diff(first, second, ["_position"])
    one_sided = (F.col("classification") == "STRUCTURE") & (F.col("column") == "")
    n_old, n_new = old.agg(F.count("*").alias("o")), new.agg(F.count("*").alias("n"))
    lengths = n_old.withColumn("_one", F.lit(1)).join(n_new.withColumn("_one", F.lit(1)), "_one").where("o <> n").select(
        F.lit("").alias("row_key"), F.lit("").alias("column"), F.lit("STRUCTURE").alias("classification"),
        F.concat(F.lit("rows="), F.col("o").cast("string")).alias("baseline"), F.concat(F.lit("rows="), F.col("n").cast("string")).alias("candidate"),
        F.lit("row count differs").alias("difference"),
    )
    return found.where(~one_sided).unionByName(lengths)


def compare_runs(
    old: dict[str, DataFrame], new: dict[str, DataFrame], keys: dict[str, list[str]]
) -> DataFrame:
    """Differences of two runs file by file; ``keys`` names the row key of each file, if it has one.

    A file only in the baseline is a structure row, one only in the candidate a new output.
    """
    parts = [
        run_diff(old[name], new[name], keys.get(name, [])).select(F.lit(name).alias("file"), "*") for name in sorted(old.keys() & new.keys())
    ]
    alone = [(n, "", "", "STRUCTURE", "present", "absent", "file only in baseline") for n in sorted(old.keys() - new.keys())]
    alone += [(n, "", "", "NEW_OUTPUT", "absent", "present", "file only in candidate") for n in sorted(new.keys() - old.keys())]
    spark = next(iter([*old.values(), *new.values()])).sparkSession
    names = "file string, row_key string, column string, classification string, baseline string, candidate string, difference string"
    out = spark.createDataFrame(alone, names)
    for p in parts:
        out = out.unionByName(p)
    return out


def run_summary(diff: DataFrame) -> DataFrame:
    """Per file and classification the differences, and whether a cell of the file changed."""
    changed = F.max(F.col("classification") == "CHANGED").over(Window.partitionBy("file"))
    counts = diff.groupBy("file", "classification").agg(F.count("*").alias("n"))
    return counts.withColumn("file_has_changed_cells", changed)


def infer_row_key(df: DataFrame, candidates: list[str], longest: int = 5) -> DataFrame:
    """Shortest prefix of the candidate columns without duplicate rows; all in one aggregate."""
    prefixes = [candidates[: i + 1] for i in range(min(len(candidates), longest))]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    counts = df.agg(
        F.count("*").alias("n"),
        *[
            F.count_distinct(F.struct(*[text(c) for c in p])).alias(f"d{i}")
            for i, p in enumerate(prefixes)
        ],
    )
    choice = F.coalesce(
        *[F.when(F.col(f"d{i}") == F.col("n"), F.lit("|".join(p))) for i, p in enumerate(prefixes)],
        F.lit(""),
    )
    return counts.select("n", choice.alias("row_key_columns"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("classification").agg(
        F.count("*").alias("n"), F.count_distinct("row_key").alias("rows_affected")
    )


def schema_rows(df: DataFrame, name: str) -> DataFrame:
    """(table, column) rows of a table's schema, one small row set."""
    columns = F.array(*[F.lit(c) for c in df.columns])
    return df.sparkSession.range(1).select(F.lit(name).alias("name"), F.explode(columns).alias("column"))


def filled_columns(df: DataFrame, name: str) -> DataFrame:
    """(table, column) rows of the columns that hold a value in some row, from one scan."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "name string, column string")
    kept = F.array_compact(F.array(*[F.when(F.count(F.col(f"`{c}`")) > 0, F.lit(c)) for c in df.columns]))
    return df.agg(kept.alias("_c")).select(F.lit(name).alias("name"), F.explode("_c").alias("column"))


def field_acceptance(df: DataFrame, field_class: str, first: str, second: str) -> DataFrame:
    """Accept or reject a pair of values by the rule of its field class.

    Unknown classes fail the job. Non-finite numbers are never accepted.
    """
    cls = F.col(field_class)
    tolerance = F.lit(None).cast("double")
    for name, (kind, value) in FIELD_CLASSES.items():
        tolerance = F.when(cls == name, F.lit(-1.0 if kind == "exact" else value)).otherwise(tolerance)
    checked = F.when(
        tolerance.isNull(), F.raise_error(F.concat(F.lit("unknown field class "), cls))
    ).otherwise(tolerance).cast("double")
    a, b = F.col(first), F.col(second)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    accepted = F.when(checked < 0, a.eqNullSafe(b)).otherwise(
        finite(a) & finite(b) & F.coalesce(F.abs(a - b) <= checked, F.lit(False))
    )
    return df.withColumn("accepted", accepted)
