"""Queries on exports, report tables and run-to-run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import gaps as G
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import report as RP
from ..operators import splits as S
from ..schema import (
    ROBUSTNESS_METRICS,
    SCORED_COLUMNS,
    SCORED_SCHEMA,
    SWEEP_METRICS,
    check_schema,
    robustness_columns,
    sweep_columns,
)
from ..sources.tables import union_tables
from .comparison import LINE_WIDE, ORD_WIDE, line_pairs, order_pairs
from .inference import STUDIES, yearly_gaps
from .registry import (
    A_LINE,
    A_ORD,
    B_LINE,
    B_ORD,
    COUNT_SQL,
    GAP_ROW_NAMES,
    LINE,
    ORD,
    disc_sql,
    gap_row_sql,
    query,
    rates_sql,
    rounded,
    scored_lineitem,
    scored_orders,
)


def scored_table(spark, d):
    """The 12-column exchange table of the two compared segments."""
    rows = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD))
    tokens = S.dense_cluster_token(rows, ["dataset"])
    out = RP.with_cluster_tokens(rows, tokens, ["dataset"]).select(
        F.col("dataset").cast("string").alias("dataset"), F.lit("segment").alias("comparison_type"),
        F.lit(f"{A_ORD}_vs_{B_ORD}").alias("comparison"), F.col("row_id").cast("bigint").alias("row_id"),
        F.col("cluster_token").alias("cluster_id"), "subgroup", F.col("y_true").cast("int").alias("y_true"),
        F.col("prob").alias("prob_calibrated"), (F.col("prob") * 0.5).alias("prob_uncalibrated"),
        F.col("pred").cast("int").alias("y_pred_at_threshold"),
        F.lit("logistic_regression").alias("selected_family"), F.lit(0.5).alias("operating_threshold"),
    )
    return check_schema(out, SCORED_SCHEMA)


@query(
    "export_predictions",
    f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    tok as (select dataset, cluster_id, printf('P%06d', dense_rank() over (partition by dataset order by cluster_id)) token
      from (select distinct dataset, cluster_id from r) u)
    select dataset::varchar dataset, 'segment' comparison_type, '{A_ORD}_vs_{B_ORD}' comparison, row_id, token cluster_id,
    subgroup, y_true, prob prob_calibrated, prob * 0.5 prob_uncalibrated, pred y_pred_at_threshold,
    'logistic_regression' selected_family, 0.5::double operating_threshold from r join tok using (dataset, cluster_id)""",
    "prob_calibrated prob_uncalibrated operating_threshold",
)
def _(spark, d):
    return scored_table(spark, d).select(*SCORED_COLUMNS)


@query(
    "export_checks",
    f"""with {ORD} select count(*)::bigint n_rows, 0::bigint n_unmatched, 0::bigint n_missing_cluster, 0::bigint n_outcome_differs,
    0::bigint n_probability_differs, 0::bigint n_prediction_differs from ord where subgroup in ('{A_ORD}', '{B_ORD}')""",
)
def _(spark, d):
    evaluated = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD)).select(
        "row_id", "y_true", F.col("prob").alias("prob_calibrated")
    )
    return RP.scored_export(scored_table(spark, d), evaluated)


def nested_records(spark, d):
    """One record per comparison with both groups' counts and interval maps."""
    keys = ["dataset", "subgroup"]
    counts = M.confusion_counts(scored_lineitem(spark, d), keys)
    intervals = I.wilson_ci(counts, keys).groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("metric", F.struct("point", "ci_low", "ci_high", "numerator", "denominator"))
            )
        ).alias("metrics")
    )
    group = F.struct(
        F.col("subgroup").alias("label"), F.struct("tp", "fp", "tn", "fn").alias("counts"), "metrics"
    )
    sides = counts.join(intervals, keys).select("dataset", "subgroup", group.alias("g"))
    return sides.groupBy("dataset").agg(
        F.max_by("g", F.col("subgroup") == A_LINE).alias("group_a"),
        F.max_by("g", F.col("subgroup") == B_LINE).alias("group_b"),
    ).select(
        F.col("dataset").cast("string").alias("dataset"), F.lit("years").alias("command_id"),
        F.lit("primary").alias("analysis_role"), F.lit("linestatus").alias("protected_attribute"),
        F.lit(f"{A_LINE} vs {B_LINE}").alias("comparison"), "group_a", "group_b",
    )


@query(
    "report_explode",
    f"""with {LINE}, c as (select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup),
    m as (select *, 'prevalence' metric, tp + fn num, tp + fp + tn + fn den from c
      union all select *, 'sensitivity', tp, tp + fn from c union all select *, 'specificity', tn, tn + fp from c
      union all select *, 'ppv', tp, tp + fp from c union all select *, 'npv', tn, tn + fn from c)
    select dataset::varchar dataset, 'years' command_id, 'primary' analysis_role, 'linestatus' protected_attribute,
    '{A_LINE} vs {B_LINE}' comparison, subgroup as "group", metric, num::double / den estimate, num numerator, den denominator
    from m""",
    "estimate",
)
def _(spark, d):
    return RP.report_explode(nested_records(spark, d))[1].drop("ci_low", "ci_high")


@query(
    "report_denominators",
    f"""with {LINE} select dataset::varchar dataset, 'years' command_id, 'primary' analysis_role, 'linestatus' protected_attribute,
    '{A_LINE} vs {B_LINE}' comparison, subgroup as "group", {COUNT_SQL} from line group by all""",
)
def _(spark, d):
    return RP.report_explode(nested_records(spark, d))[0]


GAP_NAMES = ROBUSTNESS_METRICS


@query(
    "robustness_summary",
    f"""with {ORD}, g as (select dataset, {gap_row_sql()} from (select w.*, 1 one from ({ORD_WIDE}) w) x
      union all select dataset, {gap_row_sql()} from ({ORD_WIDE.replace("'" + A_ORD + "'", "'FURNITURE'")}) y)
    select dataset::varchar dataset, {', '.join(f'avg({m}) {m}_mean, stddev_samp({m}) {m}_std, min({m}) {m}_min, max({m}) {m}_max' for m in GAP_NAMES)}
    from g group by dataset""",
    " ".join(f"{m}_{s}" for m in GAP_NAMES for s in ("mean", "std", "min", "max")),
)
def _(spark, d):
    """Two variants of a comparison per year, summarised under the fixed flat names."""
    rows = scored_orders(spark, d)
    variants = [
        G.gap_row_of_pairs(G.pair_counts(rows, ["dataset"], "subgroup", a, B_ORD), ["dataset"])
        for a in (A_ORD, "FURNITURE")
    ]
    table = union_tables(variants).withColumn("dataset", F.col("dataset").cast("string"))
    return RP.robustness_summary(table)


@query(
    "schema_contract",
    f"""with {LINE}, w as ({LINE_WIDE}) select count(*)::bigint n_comparisons, {len(sweep_columns())} n_sweep_columns,
    {len(robustness_columns())} n_summary_columns from w""",
)
def _(spark, d):
    from ..operators.thresholds import threshold_sweep

    sweep = threshold_sweep(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)
    return sweep.agg(F.count_distinct("dataset").alias("n_comparisons")).select(
        "n_comparisons", F.lit(len(sweep.columns) - 1).alias("n_sweep_columns"),
        F.lit(len(robustness_columns())).alias("n_summary_columns"),
    )


@query(
    "rank_display_order",
    f"""with {STUDIES} select dataset, metric, row_number() over (order by case metric when 'sensitivity' then 0
    when 'specificity' then 1 else 2 end, dataset)::int display_order from studies""",
)
def _(spark, d):
    rank = F.array_position(F.array(F.lit("sensitivity"), F.lit("specificity"), F.lit("ppv")), F.col("metric"))
    return RP.display_order(yearly_gaps(spark, d).select("dataset", "metric"), [rank, F.col("dataset")])


@query(
    "stable_sort_report",
    f"""with {ORD} select comparison_type, dataset, "group", n from (select case dataset % 4 when 0 then 'sex' when 1 then 'age'
    when 2 then 'race' else 'other' end comparison_type, dataset, subgroup as "group", count(*)::bigint n from ord group by all) x
    order by case comparison_type when 'sex' then 0 when 'age' then 1 when 'race' then 2 else 9 end, dataset, "group" """,
)
def _(spark, d):
    kind = F.get(F.array(F.lit("sex"), F.lit("age"), F.lit("race"), F.lit("other")), F.col("dataset") % 4)
    rows = scored_orders(spark, d).groupBy(
        kind.alias("comparison_type"), "dataset", F.col("subgroup").alias("group")
    ).agg(F.count("*").alias("n"))
    return rows.orderBy(RP.type_rank("comparison_type"), "dataset", "group")


@query(
    "performance_tables",
    f"""with {ORD} select dataset, 'age' comparison_type, subgroup as "group", auroc, auprc
    from ({disc_sql('ord', 'dataset, subgroup')}) x""",
    "auroc auprc",
)
def _(spark, d):
    rows = M.subgroup_metrics(scored_orders(spark, d), ["dataset", "subgroup"]).withColumn(
        "comparison_type", F.lit("age")
    ).withColumnRenamed("subgroup", "group")
    columns = ["dataset", "comparison_type", "group", "auroc", "auprc"]
    return RP.performance_tables(rows, columns, ["dataset", "group", "brier", "ece"])[0]


@query(
    "summary_long",
    f"""with {STUDIES}, w as ({LINE_WIDE}), a as (select dataset, ppv_gap_adj from (select dataset, {gap_row_sql()} from w) g)
    select s.dataset, s.metric, estimate raw_gap, ci_low, ci_high, case when s.metric = 'ppv' then ppv_gap_adj end adjusted_gap,
    case when s.metric = 'ppv' then 100.0::double * (1 - ppv_gap_adj / nullif(estimate, 0)) end attenuation_pct
    from studies s join a using (dataset)""",
    "raw_gap ci_low ci_high adjusted_gap attenuation_pct",
    4,
)
def _(spark, d):
    adjusted = G.prevalence_adjusted_gap(line_pairs(spark, d), ["dataset"]).select(
        "dataset", "metric", "adjusted_gap", "attenuation_pct"
    )
    raw = yearly_gaps(spark, d).select("dataset", "metric", F.col("estimate").alias("raw_gap"), "ci_low", "ci_high")
    return raw.join(adjusted, ["dataset", "metric"], "left")


@query(
    "analysis_role",
    f"""with {ORD} select status, subgroup, case when status = 'P' then 'supplement_recomputation'
    when status = 'O' and subgroup not in ('{A_ORD}', '{B_ORD}') then 'prespecified_secondary_supplement'
    else 'primary' end role, count(*)::bigint n from ord group by all""",
)
def _(spark, d):
    role = RP.analysis_role(F.col("status"), F.col("subgroup"), ["F", "O"], "O", [A_ORD, B_ORD])
    return scored_orders(spark, d).groupBy("status", "subgroup", role.alias("role")).agg(F.count("*").alias("n"))


@query(
    "join_report_lookup",
    f"""with {STUDIES} select dataset, metric, estimate sensitivity_gap, (dataset - 1994)::int display_order from studies
    where metric = 'sensitivity'""",
    "sensitivity_gap",
)
def _(spark, d):
    """Rows requested by an ordered table; a missing or repeated row fails the job."""
    results = yearly_gaps(spark, d).select("dataset", "metric", F.col("estimate").alias("sensitivity_gap"))
    wanted = results.where("metric = 'sensitivity'").select(
        "dataset", "metric", (F.col("dataset") - 1994).alias("display_order")
    )
    return RP.report_lookup(results, wanted, ["dataset", "metric"])


def figure(spark, d):
    """Thirteen gap rows: five years per attribute (three for the last)."""
    rows = yearly_gaps(spark, d)
    names = {"sensitivity": "sex", "specificity": "age", "ppv": "race/ethnicity"}
    attribute = F.lit(None).cast("string")
    for m, a in names.items():
        attribute = F.when(F.col("metric") == m, F.lit(a)).otherwise(attribute)
    kept = rows.where((F.col("dataset") <= 1997) | ((F.col("dataset") <= 1999) & (F.col("metric") != "ppv")))
    rank = F.array_position(F.array(*[F.lit(m) for m in names]), F.col("metric"))
    from ..functions.columns import excludes_zero

    flagged = kept.select(
        F.concat(F.lit("year "), F.col("dataset").cast("string")).alias("dataset"),
        attribute.alias("protected_attribute"), F.lit(f"{A_LINE} minus {B_LINE}").alias("comparison_label"),
        F.lit(A_LINE).alias("group_a"), F.lit(B_LINE).alias("group_b"),
        F.col("estimate").alias("sensitivity_gap"), "ci_low", "ci_high",
        excludes_zero(F.col("ci_low"), F.col("ci_high")).alias("significance"),
        F.lit("primary").alias("analysis_status"), rank.alias("_r"), F.lit("years").alias("source_result_path"),
    )
    numbered = RP.display_order(flagged, [F.col("_r"), F.col("dataset")])
    from ..schema import FIGURE_COLUMNS

    return numbered.select(*FIGURE_COLUMNS)


@query(
    "figure_source",
    f"""with {STUDIES}, k as (select * from studies where dataset <= 1997 or (dataset <= 1999 and metric <> 'ppv'))
    select 'year ' || dataset dataset, case metric when 'sensitivity' then 'sex' when 'specificity' then 'age'
      else 'race/ethnicity' end protected_attribute, estimate sensitivity_gap, ci_low, ci_high,
    case when ci_low > 0 or ci_high < 0 then 'significant' else 'not_significant' end significance,
    row_number() over (order by case metric when 'sensitivity' then 0 when 'specificity' then 1 else 2 end, dataset)::int display_order
    from k""",
    "sensitivity_gap ci_low ci_high",
)
def _(spark, d):
    return figure(spark, d).select(
        "dataset", "protected_attribute", "sensitivity_gap", "ci_low", "ci_high", "significance", "display_order"
    )


@query("figure_violations", f"with {STUDIES} select 'x' as rule from studies where false")
def _(spark, d):
    """Rules broken by the complete table: none."""
    return RP.figure_violations(figure(spark, d))


# --- run-to-run comparison -----------------------------------------------------------------


def run_pair(spark, d):
    """A metric table and a copy with planted changes, both rounded to six places."""
    keys = ["dataset", "subgroup"]
    metrics = M.subgroup_metrics(scored_orders(spark, d), keys).select(*keys, "n", "sensitivity", "auroc")
    old = rounded(metrics.withColumn("label", F.lower("subgroup"))).persist()
    first = (F.col("dataset") == 1997) & (F.col("subgroup") == A_ORD)
    new = old.where(~((F.col("dataset") == 1999) & (F.col("subgroup") == B_ORD))).select(
        *keys, "n",
        F.when(first, F.col("sensitivity") + 0.001).otherwise(F.col("sensitivity")).alias("sensitivity"),
        F.when(F.col("dataset") == 1998, F.col("auroc") + 0.000005).otherwise(F.col("auroc")).alias("auroc"),
        F.when(first, F.lit("renamed")).otherwise(F.col("label")).alias("label"),
        F.lit(1).alias("extra"),
    )
    return old, new, keys


RUN_PAIR = f"""{ORD}, c as (select dataset, subgroup, {COUNT_SQL} from ord group by dataset, subgroup),
  old as (select dataset, subgroup, n, round(sensitivity, 6) sensitivity, round(auroc, 6) auroc, lower(subgroup) label
    from (select *, {rates_sql()} from c) r join ({disc_sql('ord', 'dataset, subgroup')}) a using (dataset, subgroup))"""


def diff_sql(name: str, old: str, new: str, on: str, key: str, numbers: list[str], texts: list[str], structure: str = "") -> str:
    """CTE ``name``: the differences of two tables from their full outer join on ``on``."""
    join = f"{old} o full join {new} n on {on}"
    tolerance = lambda c: "1e-5" if "auroc" in c else "0.0"
    rows = [
        f"""select {key} row_key, '{c}' as column, case when o.{c} is null or n.{c} is null then 'CHANGED'
          when abs(n.{c} - o.{c}) <= {tolerance(c)}::double then 'WITHIN_TOLERANCE' else 'CHANGED' end classification
        from {old} o join {new} n on {on} where o.{c} is distinct from n.{c}"""
        for c in numbers
    ]
    rows += [f"select {key}, '{c}', 'TYPE_OR_TEXT' from {old} o join {new} n on {on} where o.{c} is distinct from n.{c}" for c in texts]
    return f"{name} as ({' union all '.join(rows)}{structure.format(join=join, key=key)})"


NEW_RUN = f"""new as (select dataset, subgroup, n, case when dataset = 1997 and subgroup = '{A_ORD}' then sensitivity + 0.001::double else sensitivity end sensitivity,
    case when dataset = 1998 then auroc + 0.000005::double else auroc end auroc,
    case when dataset = 1997 and subgroup = '{A_ORD}' then 'renamed' else label end label, 1 extra
    from old where not (dataset = 1999 and subgroup = '{B_ORD}'))"""
DIFFS = NEW_RUN + ", " + diff_sql(
    "diffs", "old", "new", "o.dataset = n.dataset and o.subgroup = n.subgroup", "o.dataset || '|' || o.subgroup", ["n", "sensitivity", "auroc"], ["label"],
    """ union all select coalesce(o.dataset, n.dataset) || '|' || coalesce(o.subgroup, n.subgroup), '', 'STRUCTURE' from {join}
       where o.dataset is null or n.dataset is null union all select '', 'extra', 'STRUCTURE'""",
)


@query("run_diff", f"with {RUN_PAIR}, {DIFFS} select * from diffs")
def _(spark, d):
    return C.run_diff(*run_pair(spark, d)).select("row_key", "column", "classification")


@query(
    "diff_summary",
    f"with {RUN_PAIR}, {DIFFS} select classification, count(*)::bigint n, count(distinct row_key)::bigint rows_affected from diffs group by 1",
)
def _(spark, d):
    return C.diff_summary(C.run_diff(*run_pair(spark, d)))


def supplier_runs(spark, d):
    """A table without a key and a shorter copy of it with changed cells."""
    from ..sources.tables import read_table

    old = read_table(spark, d, "supplier").select("s_name", "s_acctbal", "s_nationkey")
    last = read_table(spark, d, "supplier").agg(F.max("s_name")).first()[0]
    balance = F.when(F.col("s_nationkey") == 3, F.col("s_acctbal") + 1.0).otherwise(F.col("s_acctbal"))
    name = F.when(F.col("s_nationkey") == 5, F.lower("s_name")).otherwise(F.col("s_name"))
    new = old.where(F.col("s_name") < last).select(name.alias("s_name"), balance.alias("s_acctbal"), "s_nationkey")
    return old, new


POSITIONS = """old as (select row_number() over (order by s_suppkey) - 1 p, s_name, s_acctbal, s_nationkey from supplier),
  new as (select row_number() over (order by p) - 1 p, case when s_nationkey = 5 then lower(s_name) else s_name end s_name,
    case when s_nationkey = 3 then s_acctbal + 1.0::double else s_acctbal end s_acctbal, s_nationkey from old where s_name < (select max(s_name) from old))"""
BY_POSITION = diff_sql(
    "diffs", "old", "new", "o.p = n.p", "o.p::varchar", ["s_acctbal", "s_nationkey"], ["s_name"],
    " union all select '', '', 'STRUCTURE' where (select count(*) from old) <> (select count(*) from new)",
)


@query("run_diff_positions", f"with {POSITIONS}, {BY_POSITION} select * from diffs")
def _(spark, d):
    """Tables without a key, aligned by position."""
    return C.run_diff(*supplier_runs(spark, d), []).select("row_key", "column", "classification")


@query(
    "run_diff_files",
    f"""with {POSITIONS}, {BY_POSITION}, f as (select 'supplier.csv' file, * from diffs union all select 'gone.csv', '', '', 'STRUCTURE'
      where exists (select 1 from supplier) union all select 'added.csv', '', '', 'NEW_OUTPUT' where exists (select 1 from supplier)),
    c as (select file, classification, count(*)::bigint n from f group by 1, 2)
    select *, max(classification = 'CHANGED') over (partition by file) file_has_changed_cells from c""",
)
def _(spark, d):
    """Two runs of files: one compared, one missing, one new."""
    old, new = supplier_runs(spark, d)
    return C.run_summary(C.compare_runs({"supplier.csv": old, "gone.csv": old}, {"supplier.csv": new, "added.csv": new}, {}))


@query(
    "join_full_outer_diff",
    f"""with {ORD}, a as (select dataset, subgroup, count(*)::bigint n from ord where status = 'P' group by 1, 2),
    b as (select dataset, subgroup, count(*)::bigint n from ord where status = 'F' and subgroup <> '{A_ORD}' group by 1, 2)
    select coalesce(a.dataset, b.dataset) dataset, coalesce(a.subgroup, b.subgroup) subgroup, a.n n_old, b.n n_new
    from a full join b on a.dataset = b.dataset and a.subgroup = b.subgroup where a.n is distinct from b.n""",
)
def _(spark, d):
    rows, keys = scored_orders(spark, d), ["dataset", "subgroup"]
    old = rows.where("status = 'P'").groupBy(*keys).agg(F.count("*").alias("n_old"))
    new = rows.where((F.col("status") == "F") & (F.col("subgroup") != A_ORD)).groupBy(*keys).agg(
        F.count("*").alias("n_new")
    )
    return old.join(new, keys, "full_outer").where(~F.col("n_old").eqNullSafe(F.col("n_new")))


@query(
    "infer_row_key",
    f"""with {ORD}, t as (select distinct status, subgroup, dataset from ord)
    select count(*)::bigint n, case when count(distinct status) = count(*) then 'status'
      when count(distinct (status, subgroup)) = count(*) then 'status|subgroup'
      when count(distinct (status, subgroup, dataset)) = count(*) then 'status|subgroup|dataset' else '' end row_key_columns from t""",
)
def _(spark, d):
    table = scored_orders(spark, d).select("status", "subgroup", "dataset").distinct()
    return C.infer_row_key(table, ["status", "subgroup", "dataset"])


@query(
    "except_columns",
    """select 'baseline' side, column_name as column from (select unnest(['o_orderdate', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) column_name)
    where exists (select 1 from orders)""",
)
def _(spark, d):
    """Columns holding values in one table version that the other lacks."""
    from ..sources.tables import read_table

    orders = read_table(spark, d, "orders")
    old, new = C.filled_columns(orders, "run"), C.filled_columns(orders.select("o_orderkey", "o_custkey"), "run")
    only_old = old.exceptAll(new).select(F.lit("baseline").alias("side"), "column")
    only_new = new.exceptAll(old).select(F.lit("candidate").alias("side"), "column")
    return only_old.unionByName(only_new)


CLASSES = {
    "sensitivity": "subgroup_and_event_counts",
    "specificity": "manuscript_metrics_and_bootstrap_confidence_intervals",
    "ppv": "continuous_auroc_and_calibrated_score_diagnostics",
}


@query(
    "field_tolerance",
    f"""with {STUDIES} select dataset, metric, case metric when 'sensitivity' then dataset <> 1998
    when 'specificity' then dataset <> 1998 else true end accepted from studies""",
)
def _(spark, d):
    """One year moved by 5e-6: accepted only for the class that tolerates 1e-5."""
    cls = F.lit(None).cast("string")
    for m, c in CLASSES.items():
        cls = F.when(F.col("metric") == m, F.lit(c)).otherwise(cls)
    rows = yearly_gaps(spark, d).select(
        "dataset", "metric", "estimate", cls.alias("field_class"),
        F.when(F.col("dataset") == 1998, F.col("estimate") + 0.000005).otherwise(F.col("estimate")).alias("again"),
    )
    return C.field_acceptance(rows, "field_class", "estimate", "again").select("dataset", "metric", "accepted")
