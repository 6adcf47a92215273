"""Queries on sources, recodes, joins, set operations, splits and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..functions.columns import hash_text, slug
from ..operators import prep as P
from ..operators import splits as S
from ..operators.metrics import group_counts, missing_data_flow
from ..session import null_safe_join, scratch_folder
from ..sources import sinks, tables
from ..sources.tables import read_table
from .registry import (
    A_ORD,
    B_ORD,
    LINE,
    ORD,
    SURV,
    query,
    scored_lineitem,
    scored_orders,
    survey_events,
)

# --- sources ------------------------------------------------------------------


@query(
    "scan_csv",
    "select o_orderstatus, count(*)::bigint n, sum(o_totalprice) total from orders group by o_orderstatus",
    "total",
    2,
)
def _(spark, d):
    """Round trip of a table through header CSV under a declared schema."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = sinks.write_table(orders, scratch_folder(spark, "orders_csv"), "csv")
    back = tables.read_csv(spark, path, orders.schema)
    return back.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )


@query(
    "scan_column_subset",
    "select s_suppkey, s_nationkey, s_acctbal from supplier",
    "s_acctbal",
    4,
)
def _(spark, d):
    wanted = ["s_suppkey", "s_nationkey", "s_phone", "s_acctbal"]
    return tables.wanted_if_present(read_table(spark, d, "supplier"), wanted)


@query("scan_usecols_strict", "select p_partkey, p_brand, p_size from part")
def _(spark, d):
    return tables.exactly(read_table(spark, d, "part"), ["p_partkey", "p_brand", "p_size"])


COMPONENTS = """select c.c_custkey, c_mktsegment, c_acctbal, n_orders, total, n_late, o_last
  from customer c left join (select o_custkey c_custkey, count(*)::bigint n_orders, sum(o_totalprice) total
    from orders group by 1) a on c.c_custkey = a.c_custkey
  left join (select o_custkey c_custkey, count(*)::bigint n_late from orders where o_orderstatus = 'P' group by 1) b
    on c.c_custkey = b.c_custkey
  left join (select o_custkey c_custkey, max(o_orderkey) o_last from orders group by 1) l on c.c_custkey = l.c_custkey"""


@query("scan_multi_component", COMPONENTS, "c_acctbal total", 4)
def _(spark, d):
    """One-row-per-key modules merged onto a base table, each projected first."""
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    base = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    modules = [
        orders.groupBy("c_custkey").agg(
            F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")
        ),
        orders.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.count("*").alias("n_late")),
        orders.groupBy("c_custkey").agg(F.max("o_orderkey").alias("o_last")),
    ]
    return tables.merge_components(base, modules, "c_custkey")


@query(
    "scan_union_glob",
    f"""with {ORD} select dataset, subgroup, count(*)::bigint n, sum(y_true)::bigint n_pos, avg(y_true) prevalence
    from ord where subgroup in ('{A_ORD}', '{B_ORD}') group by dataset, subgroup""",
    "prevalence",
)
def _(spark, d):
    """Result files of two comparisons written apart and read back as one table."""
    counts = group_counts(scored_orders(spark, d), ["dataset", "subgroup"])
    folder = scratch_folder(spark, "performance")
    for label in (A_ORD, B_ORD):
        part = counts.where(F.col("subgroup") == label)
        sinks.write_table(part, f"{folder}/{label.lower()}_performance.csv", "csv")
    return tables.union_files(spark, f"{folder}/*_performance.csv", counts.schema)


@query(
    "scan_jsonl",
    f"""with {ORD} select dataset, count(*)::bigint n, sum(y_true)::bigint n_pos, avg(y_true) prevalence,
    'pipeline_analysis' record_type from ord group by dataset""",
    "prevalence",
)
def _(spark, d):
    """Provenance records written as strict JSON lines and read back by kind."""
    counts = group_counts(scored_orders(spark, d), ["dataset"]).withColumn(
        "record_type", F.lit("pipeline_analysis")
    )
    folder = sinks.append_provenance(counts, scratch_folder(spark, "records"))
    return tables.read_records(spark, folder, counts.schema)


@query(
    "sink_table",
    f"""with {LINE} select dataset, subgroup, count(*)::bigint n, sum(y_true)::bigint n_pos, avg(y_true) prevalence
    from line group by dataset, subgroup""",
    "prevalence",
)
def _(spark, d):
    counts = group_counts(scored_lineitem(spark, d), ["dataset", "subgroup"])
    path = sinks.write_table(counts, scratch_folder(spark, "sink"))
    return spark.read.parquet(path)


@query(
    "sink_atomic_replace",
    f"with {LINE} select dataset, count(*)::bigint n from line where subgroup = 'O' group by dataset",
)
def _(spark, d):
    """A second write replaces the first as a whole."""
    rows, path = scored_lineitem(spark, d), scratch_folder(spark, "replaced")
    for label in ("F", "O"):
        part = rows.where(F.col("subgroup") == label).groupBy("dataset").agg(F.count("*").alias("n"))
        sinks.write_table(part, path)
    return spark.read.parquet(path)


@query("sink_all_or_nothing", f"with {LINE} select dataset, count(*)::bigint n from line group by dataset")
def _(spark, d):
    """Both components are counted before either is written."""
    counts = group_counts(scored_lineitem(spark, d), ["dataset", "subgroup"])
    years = counts.groupBy("dataset").agg(F.sum("n").alias("n"))
    expected = {"by_group": counts.count(), "by_year": years.count()}
    folder = scratch_folder(spark, "component")
    sinks.write_all_or_nothing({"by_group": counts, "by_year": years}, expected, folder)
    return spark.read.parquet(f"{folder}/by_year")


@query("sink_provenance")
def _(spark, d):
    counts = group_counts(scored_orders(spark, d), ["dataset"]).withColumn(
        "undefined", F.when(F.col("n") > 0, F.lit(float("nan")))
    )
    return sinks.strict_json(counts)


# --- recodes --------------------------------------------------------------------


def code_counts(df, source: str, name: str):
    """Count of rows per source value and its recoded value."""
    return df.groupBy(source, name).agg(F.count("*").alias("n"))


def recode_query(key: str, table: str, source: str, name: str, expression, sql: str, doubles=""):
    @query(
        key,
        f"select {source}, {sql} {name}, count(*)::bigint n from {table} group by 1, 2",
        doubles,
    )
    def _(spark, d):
        return code_counts(read_table(spark, d, table).withColumn(name, expression()), source, name)


recode_query(
    "recode_binary_ge", "lineitem", "l_linenumber", "flag",
    lambda: R.at_least("l_linenumber", 2), "case when l_linenumber >= 2 then 1 else 0 end",
)
recode_query(
    "recode_equals", "events", "event_type", "flag",
    lambda: R.equals("event_type", "purchase"), "case when event_type = 'purchase' then 1 else 0 end",
)
recode_query(
    "recode_in_set", "orders", "o_orderstatus", "flag",
    lambda: R.in_set("o_orderstatus", ["F"], ["F", "O"]),
    "case when o_orderstatus = 'F' then 1 when o_orderstatus = 'O' then 0 end",
)
recode_query(
    "recode_yes_no", "documents", "lang", "flag",
    lambda: R.yes_no("lang", "en", "de"), "case lang when 'en' then 1 when 'de' then 0 end",
)
recode_query(
    "recode_map", "customer", "c_mktsegment", "code",
    lambda: R.mapped("c_mktsegment", {"AUTOMOBILE": 5, "BUILDING": 15, "FURNITURE": 25, "MACHINERY": 35}),
    "case c_mktsegment when 'AUTOMOBILE' then 5 when 'BUILDING' then 15 when 'FURNITURE' then 25 "
    "when 'MACHINERY' then 35 end",
)
recode_query(
    "recode_null_sentinel", "part", "p_size", "level",
    lambda: R.mapped(R.without_sentinels("p_size", [9, 14]), {1: "low", 2: "low", 3: "mid"}, "Unknown"),
    "case when p_size in (1, 2) then 'low' when p_size = 3 then 'mid' else 'Unknown' end",
)
recode_query(
    "recode_days_88", "lineitem", "l_quantity", "day_value",
    lambda: R.day_count("l_quantity", none_code=50, longest=30),
    "case when l_quantity = 50 then 0 when l_quantity <= 30 then l_quantity end",
    "l_quantity day_value",
)
recode_query(
    "recode_valid_range", "lineitem", "l_linenumber", "kept",
    lambda: R.valid_only("l_linenumber", [1, 2, 3]),
    "case when l_linenumber in (1, 2, 3) then l_linenumber end",
)
recode_query(
    "rescale", "lineitem", "l_quantity", "scaled",
    lambda: R.rescaled("l_quantity", 100), "l_quantity / 100.0", "l_quantity scaled",
)
recode_query(
    "band_map", "lineitem", "l_linenumber", "band",
    lambda: R.mapped("l_linenumber", {1: "18_44", 2: "18_44", 3: "45_64", 4: "45_64", 5: "65_plus"}),
    "case when l_linenumber <= 2 then '18_44' when l_linenumber <= 4 then '45_64' "
    "when l_linenumber = 5 then '65_plus' end",
)
recode_query(
    "band_cut", "lineitem", "l_quantity", "band",
    lambda: R.half_open_bands("l_quantity", [0, 15, 35, 50], ["under_15", "15_34", "35_plus"]),
    "case when l_quantity < 15 then 'under_15' when l_quantity < 35 then '15_34' "
    "when l_quantity < 50 then '35_plus' end",
    "l_quantity",
)
recode_query(
    "band_rule", "part", "p_size", "band",
    lambda: R.upper_closed_rule("p_size", [5], [25, 40], ["under_30", "30_59", "60_plus"]),
    "case when p_size = 5 then null when p_size <= 25 then 'under_30' when p_size <= 40 then '30_59' "
    "else '60_plus' end",
)
recode_query(
    "slug", "part", "p_type", "slug",
    lambda: slug(F.concat(F.lit(" "), F.col("p_type"), F.lit(" (BRFSS 2022)"))),
    "trim(regexp_replace(lower(' ' || p_type || ' (BRFSS 2022)'), '[^a-z0-9]+', '_', 'g'), '_')",
)
recode_query(
    "cast_numeric_coerce", "part", "p_brand", "number",
    lambda: R.numeric_or_null(F.regexp_replace("p_brand", "Brand#1", "1")),
    "try_cast(replace(p_brand, 'Brand#1', '1') as double)", "number",
)


@query(
    "recode_flag_null_aware",
    f"""with {SURV} select subgroup, case when num is not null then case when cat = 'view' then 1 else 0 end end flag,
    count(*)::bigint n from surv group by 1, 2""",
)
def _(spark, d):
    rows = survey_events(spark, d).withColumn("known", F.when(F.col("num").isNotNull(), F.col("cat")))
    return code_counts(rows.withColumn("flag", R.flag_if_known("known", "view")), "subgroup", "flag")


@query(
    "fill_sentinel",
    f"""with {SURV} select subgroup, case when num is null then 'None' when cat = 'error' then 'Unknown' else cat end cat,
    count(*)::bigint n from surv group by 1, 2""",
)
def _(spark, d):
    rows = survey_events(spark, d).withColumn("known", F.when(F.col("num").isNotNull(), F.col("cat")))
    filled = R.relabelled(R.filled("known", "None"), "error", "Unknown")
    return code_counts(rows.withColumn("cat", filled), "subgroup", "cat")


@query(
    "filter_valid_outcome",
    f"""with {SURV} select subgroup, count(*)::bigint n, sum(y_true)::bigint n_pos, sum(num) total from surv
    where num is not null and cat in ('purchase', 'view', 'click') group by subgroup""",
    "total",
    4,
)
def _(spark, d):
    rows = survey_events(spark, d).where(
        F.col("num").isNotNull() & F.col("cat").isin("purchase", "view", "click")
    )
    return rows.groupBy("subgroup").agg(
        F.count("*").alias("n"), F.sum("y_true").alias("n_pos"), F.sum("num").alias("total")
    )


@query(
    "filter_two_groups",
    f"""with {ORD} select dataset, subgroup, count(*)::bigint n, sum(y_true)::bigint n_pos, avg(y_true) prevalence
    from ord where subgroup in ('{A_ORD}', '{B_ORD}') group by dataset, subgroup""",
    "prevalence",
)
def _(spark, d):
    rows = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD))
    return group_counts(rows, ["dataset", "subgroup"])


@query("project_blinded", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'", "o_totalprice", 2)
def _(spark, d):
    """The protected attribute and its indicators never reach the feature list."""
    spec = P.DesignSpec(
        ["o_totalprice", "race", "Race_Other"], [P.Categorical("race")]
    )
    features, _blocks, _spec = P.blinded(spec.features, {"all": spec.features}, spec, "race")
    return read_table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", *features)


@query("project_blinded_all", "select o_orderkey, o_totalprice from orders", "o_totalprice", 2)
def _(spark, d):
    """Every order, blinded to a column that the table has."""
    spec = P.DesignSpec(["o_totalprice", "o_orderpriority"], [P.Categorical("o_orderpriority")])
    features, _blocks, _spec = P.blinded(spec.features, {"all": spec.features}, spec, "o_orderpriority")
    return read_table(spark, d, "orders").select("o_orderkey", *features)


@query("drop_columns", "select n_nationkey, n_regionkey from nation")
def _(spark, d):
    return read_table(spark, d, "nation").drop("n_name", "n_comment")


# --- joins and set operations ------------------------------------------------------


@query(
    "join_left_chain",
    """select c_custkey, n_name, r_name, n_orders, last_order from customer
    left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
    left join (select o_custkey, count(*)::bigint n_orders, max(o_orderkey) last_order from orders group by 1) o
      on c_custkey = o_custkey""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.max("o_orderkey").alias("last_order")
    )
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return (
        read_table(spark, d, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select("c_custkey", "n_name", "r_name", "n_orders", "last_order")
    )


@query(
    "join_by_row_id",
    f"""with {ORD} select count(*)::bigint n, count_if(o_custkey is null)::bigint n_missing,
    count(distinct o_custkey)::bigint n_clusters from ord left join orders on row_id = o_orderkey""",
)
def _(spark, d):
    """Cluster ids aligned to scored rows by id; missing ones are counted, not dropped."""
    ids = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    joined = scored_orders(spark, d).join(ids, "row_id", "left")
    return joined.agg(
        F.count("*").alias("n"), F.count_if(F.col("o_custkey").isNull()).alias("n_missing"),
        F.count_distinct("o_custkey").alias("n_clusters"),
    )


@query(
    "join_concat_cols",
    f"""with {ORD}, g as (select row_id, y_true, subgroup from ord), x as (select row_id, price, balance from ord)
    select subgroup, y_true, count(*)::bigint n, avg(price) price, avg(balance) balance
    from x join g using (row_id) group by 1, 2""",
    "price balance",
    4,
)
def _(spark, d):
    rows = scored_orders(spark, d)
    design, target = rows.select("row_id", "price", "balance"), rows.select("row_id", "y_true", "subgroup")
    return design.join(target, "row_id").groupBy("subgroup", "y_true").agg(
        F.count("*").alias("n"), F.avg("price").alias("price"), F.avg("balance").alias("balance")
    )


SPLIT_CLUSTER = f"""cl as (select dataset, cluster_id, row_number() over (partition by dataset
    order by md5('42|' || cluster_id), cluster_id) rn, count(*) over (partition by dataset) g
    from (select distinct dataset, cluster_id from ord) u),
  sp as (select ord.*, case when rn <= ceil(0.3::double * g) then 'test' else 'train' end split
    from ord join cl using (dataset, cluster_id))"""


@query(
    "join_anti_cluster",
    f"""with {ORD}, {SPLIT_CLUSTER} select dataset, count(*)::bigint n, count(distinct cluster_id)::bigint n_clusters
    from sp t where not exists (select 1 from sp r where r.split = 'train' and r.dataset = t.dataset
      and r.cluster_id = t.cluster_id) group by dataset""",
)
def _(spark, d):
    parts = S.split_grouped(scored_orders(spark, d), ["dataset"])
    train = parts.where("split = 'train'").select("dataset", "cluster_id").distinct()
    left = null_safe_join(parts, train, ["dataset", "cluster_id"], "left_anti")
    per = left.groupBy("dataset", "cluster_id").agg(F.count("*").alias("n"))
    return per.groupBy("dataset").agg(F.sum("n").alias("n"), F.count("*").alias("n_clusters"))


@query(
    "join_semi_groups",
    f"""with {ORD} select subgroup, count(*)::bigint n from ord where subgroup in
    (select c_mktsegment from customer group by 1 having avg(c_acctbal) > 4500) group by subgroup""",
)
def _(spark, d):
    wanted = (
        read_table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("subgroup"))
        .agg(F.avg("c_acctbal").alias("m")).where("m > 4500").select("subgroup")
    )
    return scored_orders(spark, d).join(wanted, "subgroup", "left_semi").groupBy("subgroup").agg(
        F.count("*").alias("n")
    )


@query(
    "union_results",
    f"""with {ORD}, {LINE} select 'ord' source, dataset, subgroup, count(*)::bigint n, null::bigint n_clusters from ord group by all
    union all select 'line', dataset, subgroup, count(*)::bigint, count(distinct cluster_id)::bigint from line group by all""",
)
def _(spark, d):
    a = scored_orders(spark, d).groupBy("dataset", "subgroup").agg(F.count("*").alias("n"))
    b = scored_lineitem(spark, d).groupBy("dataset", "subgroup").agg(
        F.count("*").alias("n"), F.count_distinct("cluster_id").alias("n_clusters")
    )
    both = tables.union_tables(
        [a.withColumn("source", F.lit("ord")), b.withColumn("source", F.lit("line"))]
    )
    return both.select("source", "dataset", "subgroup", "n", "n_clusters")


@query(
    "union_index",
    f"""with {ORD} select row_id, 1::bigint copies from ord where subgroup in ('{A_ORD}', '{B_ORD}')
    union all select row_id, 1 from ord where subgroup = 'FURNITURE'""",
)
def _(spark, d):
    rows = scored_orders(spark, d)
    return S.union_holdouts(
        [
            rows.where(F.col("subgroup").isin(A_ORD, B_ORD)).select("row_id"),
            rows.where("subgroup = 'FURNITURE'").select("row_id"),
        ],
        ["row_id"],
    )


@query(
    "intersect_ids",
    """select o_custkey cluster_id from orders where o_orderstatus = 'F'
    intersect select o_custkey from orders where o_orderpriority = '1-URGENT'""",
)
def _(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "cluster_id")
    return S.shared_rows(
        orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'"), ["cluster_id"]
    )


# --- splits ---------------------------------------------------------------------------

SPLIT_ROW = """sp as (select *, case when rn <= ceil(0.3::double * g) then 'test' else 'train' end split from (
    select *, row_number() over (partition by dataset, y_true order by md5('42|' || row_id), row_id::varchar) rn,
      count(*) over (partition by dataset, y_true) g from ord) u)"""


@query("split_stratified", f"with {ORD}, {SPLIT_ROW} select dataset, row_id, y_true, split from sp")
def _(spark, d):
    return S.split_stratified(
        scored_orders(spark, d).select("dataset", "row_id", "y_true"), ["dataset"]
    )


@query("split_grouped", f"with {ORD}, {SPLIT_CLUSTER} select dataset, cluster_id, row_id, split from sp")
def _(spark, d):
    return S.split_grouped(
        scored_orders(spark, d).select("dataset", "cluster_id", "row_id"), ["dataset"]
    )


DIAGNOSTICS = """count_if(split = 'train')::bigint n_train, count_if(split = 'test')::bigint n_test,
  sum(y_true) filter (split = 'train')::bigint n_train_events, sum(y_true) filter (split = 'test')::bigint n_test_events,
  avg(y_true) filter (split = 'train') train_event_rate, avg(y_true) filter (split = 'test') test_event_rate,
  avg(case when split = 'test' then 1 else 0 end) realized_test_fraction"""


@query(
    "split_diagnostics",
    f"""with {ORD}, {SPLIT_CLUSTER} select dataset, {DIAGNOSTICS},
    count(distinct cluster_id) filter (split = 'train')::bigint n_train_clusters,
    count(distinct cluster_id) filter (split = 'test')::bigint n_test_clusters,
    count(distinct cluster_id)::bigint n_total_clusters, 0::bigint cluster_overlap_train_test
    from sp group by dataset""",
    "train_event_rate test_event_rate realized_test_fraction",
)
def _(spark, d):
    parts = S.split_grouped(scored_orders(spark, d), ["dataset"])
    return S.split_diagnostics(parts, ["dataset"], cluster="cluster_id")


@query(
    "overlap_rows",
    f"""with {ORD}, {SPLIT_ROW} select count(*)::bigint n_shared from (
    select row_id from sp where split = 'train' intersect select row_id from sp where split = 'test') x""",
)
def _(spark, d):
    parts = S.split_stratified(scored_orders(spark, d), ["dataset"])
    return S.shared_rows(
        parts.where("split = 'train'"), parts.where("split = 'test'"), ["row_id"]
    ).agg(F.count("*").alias("n_shared"))


@query(
    "overlap_clusters",
    f"""with {ORD}, {SPLIT_ROW} select dataset, count(*)::bigint n_shared from (
    select dataset, cluster_id from sp where split = 'train'
    intersect select dataset, cluster_id from sp where split = 'test') x group by dataset""",
)
def _(spark, d):
    """A row-level split of repeated encounters does share clusters; this counts them."""
    parts = S.split_stratified(scored_orders(spark, d), ["dataset"])
    shared = S.shared_rows(
        parts.where("split = 'train'"), parts.where("split = 'test'"), ["dataset", "cluster_id"]
    )
    return shared.groupBy("dataset").agg(F.count("*").alias("n_shared"))


@query(
    "kfold_stratified",
    f"""with {ORD} select dataset, row_id, y_true, (ntile(5) over (partition by dataset, y_true
    order by md5('42|' || row_id), row_id::varchar) - 1)::int fold from ord""",
)
def _(spark, d):
    rows = scored_orders(spark, d).select("dataset", "row_id", "y_true")
    return S.kfold_stratified(rows, ["dataset"])


FOLD_CLUSTER = """cf as (select dataset, cluster_id, (ntile(5) over (partition by dataset, level
    order by md5('42|' || cluster_id), cluster_id) - 1)::int fold from (
      select dataset, cluster_id, least(sum(y_true), 2) as level from ord group by 1, 2) u)"""


@query(
    "kfold_stratified_group",
    f"with {ORD}, {FOLD_CLUSTER} select dataset, cluster_id, row_id, fold from ord join cf using (dataset, cluster_id)",
)
def _(spark, d):
    rows = scored_orders(spark, d).select("dataset", "cluster_id", "row_id", "y_true")
    return S.kfold_grouped(rows, ["dataset"]).drop("y_true")


@query(
    "assert_fold_isolation",
    f"with {ORD} select dataset, count(distinct cluster_id)::bigint n_clusters, 0::bigint n_spanning from ord group by dataset",
)
def _(spark, d):
    return S.fold_violations(S.kfold_grouped(scored_orders(spark, d), ["dataset"]), ["dataset"])


@query(
    "auxiliary_holdout",
    f"""with {ORD}, rest as (select * from ord where subgroup not in ('{A_ORD}', '{B_ORD}')),
    cls as (select dataset, subgroup, least(sum(y_true), count(*) - sum(y_true)) m from rest group by 1, 2),
    st as (select rest.*, case when m >= 2 then y_true else -1 end stratum from rest join cls using (dataset, subgroup))
    select dataset, row_id, subgroup, y_true from (select *, row_number() over (partition by dataset, subgroup, stratum
      order by md5('42|' || row_id), row_id::varchar) rn, count(*) over (partition by dataset, subgroup, stratum) g from st) u
    where rn <= ceil(0.3::double * g)""",
)
def _(spark, d):
    rows = scored_orders(spark, d).select("dataset", "row_id", "subgroup", "y_true")
    return S.auxiliary_holdout(rows, ["dataset"], "subgroup", [A_ORD, B_ORD])


@query(
    "stratified_order",
    f"""with {ORD} select dataset, y_true, row_id, rank::bigint as rank from (select *, row_number() over (
    partition by dataset, y_true order by md5('7|' || row_id), row_id::varchar) as rank from ord) u""",
)
def _(spark, d):
    """Full pseudo-random rank inside each stratum, by hash bucket with offsets."""
    from ..operators.ranking import prefix_sums

    rows = scored_orders(spark, d).select("dataset", "y_true", "row_id").withColumn(
        "_h", hash_text(["row_id"], 7)
    ).withColumn("_b", F.substring("_h", 1, 3)).withColumn("one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(rows, ["dataset", "y_true"], "_b", "_h", ["one"], descending=False)
    return ranked.select("dataset", "y_true", "row_id", F.col("cum_one").alias("rank"))


@query(
    "dense_cluster_token",
    f"""with {ORD} select dataset, cluster_id, printf('P%06d', dense_rank() over (partition by dataset order by cluster_id))
    cluster_token from (select distinct dataset, cluster_id from ord) u""",
)
def _(spark, d):
    return S.dense_cluster_token(scored_orders(spark, d), ["dataset"])


def balanced_sql() -> str:
    order = lambda seed: f"order by md5('{seed}|' || row_id), row_id::varchar"
    return f"""with {ORD}, r as (select dataset, row_id, subgroup, y_true from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    z as (select dataset, count_if(subgroup = '{A_ORD}') na, count_if(subgroup = '{B_ORD}') nb,
      count_if(subgroup = '{A_ORD}' and y_true = 1) pa, count_if(subgroup = '{B_ORD}' and y_true = 1) pb,
      count_if(y_true = 1) p, count(*) n from r group by dataset),
    x as (select r.*, z.* exclude (dataset), case when subgroup = '{A_ORD}' then na else nb end own_n,
      case when subgroup = '{A_ORD}' then pa else pb end own_p,
      row_number() over (partition by r.dataset, subgroup {order(42)}) r0,
      row_number() over (partition by r.dataset, subgroup, y_true {order(43)}) r1,
      row_number() over (partition by r.dataset, subgroup, y_true {order(44)}) r2 from r join z on r.dataset = z.dataset)
    select dataset, row_id, subgroup, y_true, 1.0::double w_original,
      case when r0 <= least(na, nb) then 1.0::double end w_equal_sample_size,
      case when y_true = 0 or r1 <= least(pa, pb) then 1.0::double end w_equal_positive_cases,
      case when y_true = 0 or r2 <= round_even(least(pa::double / na, pb::double / nb) * own_n, 0) then 1.0::double end w_equal_prevalence,
      n::double / (2 * case when y_true = 1 then p else n - p end) w_class_balanced_weighting,
      n::double / (2 * own_n) w_group_balanced_weighting,
      case when y_true = 1 then greatest(pa, pb)::double / own_p else 1.0 end w_positive_reweighting from x"""


@query(
    "balanced_training",
    balanced_sql(),
    " ".join(f"w_{s}" for s in S.SCHEMES),
)
def _(spark, d):
    rows = scored_orders(spark, d).select("dataset", "row_id", "subgroup", "y_true")
    return S.balanced_training(rows, ["dataset"], "subgroup", A_ORD, B_ORD)


# --- preprocessing -----------------------------------------------------------------------

FOLDS = ["train_fold"]
SPEC = P.DesignSpec(["num", "cat", "hour"], [P.Categorical("cat", "cat", True)])
SURV_FOLD = """sf as (select *, (ntile(5) over (partition by y_true order by md5('42|' || row_id), row_id::varchar) - 1)::int fold
    from surv)"""


def survey_folds(spark, d):
    rows = survey_events(spark, d).withColumn("dataset", F.col("subgroup"))
    return S.kfold_stratified(rows, [])


@query(
    "fit_medians",
    f"""with {SURV} select subgroup, 'num' as column, count_if(num is null)::bigint n_missing, median(num) is null zero_filled,
      coalesce(median(num), 0) median from surv group by subgroup
    union all select subgroup, 'hour', count_if(hour is null)::bigint, median(hour) is null, coalesce(median(hour), 0)
      from surv group by subgroup
    union all select subgroup, 'cat', count(*)::bigint, true, 0.0 from surv group by subgroup""",
    "median",
)
def _(spark, d):
    return P.fit_medians(survey_events(spark, d), ["subgroup"], ["num", "hour", "cat"])


CATEGORIES = """select {keys}, 'cat' source, cat category, position::int position, position = 1 is_reference,
  case when position > 1 then 'cat_' || cat end as indicator from (
    select {keys}, cat, row_number() over (partition by {keys} order by cat) position
    from (select distinct {keys}, cat from {src} where cat is not null) u) v"""


@query("fit_categories", f"with {SURV} {CATEGORIES.format(keys='subgroup', src='surv')}")
def _(spark, d):
    return P.fit_categories(survey_events(spark, d), ["subgroup"], SPEC.categorical)


@query(
    "fit_per_fold",
    f"""with {SURV}, {SURV_FOLD} select train_fold, count_if(num is null)::bigint n_missing, median(num) median
    from sf join (select i::int train_fold from generate_series(0, 4) g(i)) f on f.train_fold <> sf.fold group by train_fold""",
    "median",
)
def _(spark, d):
    """Medians of every fold's training half; the fold is just another key."""
    train = P.training_folds(survey_folds(spark, d), 5)
    return P.fit_medians(train, FOLDS, ["num"]).select("train_fold", "n_missing", "median")


@query(
    "transform_impute_onehot",
    f"""with {SURV}, md as (select subgroup, median(num) mn, median(hour) mh from surv where hour < 20 group by subgroup)
    select row_id, coalesce(num, mn) num, case when cat = 'error' then 1.0 else 0.0 end::double cat_error,
    case when cat = 'purchase' then 1.0 else 0.0 end::double cat_purchase,
    case when cat = 'signup' then 1.0 else 0.0 end::double cat_signup,
    case when cat = 'view' then 1.0 else 0.0 end::double cat_view, coalesce(hour::double, mh) as hour
    from surv join md using (subgroup)""",
    "num cat_error cat_purchase cat_signup cat_view hour",
)
def _(spark, d):
    rows, keys = survey_events(spark, d), ["subgroup"]
    train = rows.where("hour < 20")
    medians = P.fit_medians(train, keys, SPEC.numeric)
    levels = P.level_lists(P.fit_categories(train, keys, SPEC.categorical), SPEC)
    return P.apply_design(rows, keys, SPEC, medians, levels, ["row_id"])


@query(
    "unseen_categories",
    f"""with {SURV} select subgroup, 'cat' source, cat category, count(*)::bigint n_rows from surv s
    where not exists (select 1 from surv t where t.subgroup = s.subgroup and t.cat = s.cat and t.num < 30 and t.cat <> 'error')
    group by 1, 2, 3""",
)
def _(spark, d):
    rows, keys = survey_events(spark, d), ["subgroup"]
    train = rows.where("num < 30 and cat <> 'error'")
    return P.unseen_categories(rows, keys, SPEC.categorical, P.fit_categories(train, keys, SPEC.categorical))


@query(
    "expand_blocks",
    f"""with {SURV}, b as (select 'time' block, 'hour' as column union all select 'activity', 'num'
      union all select 'activity', 'cat_' || cat from (select distinct cat from surv where cat <> (select min(cat) from surv)) c)
    select block, b.column, (select count(*)::bigint from surv) n_rows from b""",
)
def _(spark, d):
    """Covariate blocks with categorical sources replaced by learned indicators."""
    rows = survey_events(spark, d)
    levels = P.level_lists(P.fit_categories(rows, ["subgroup"], SPEC.categorical), SPEC)
    blocks = P.expand_blocks({"time": ["hour"], "activity": ["cat", "num"]}, SPEC, levels)
    counts = rows.agg(F.count("*").alias("n_rows"))
    entries = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(c).alias("column")) for b, cs in blocks.items() for c in cs])
    return counts.select("n_rows", F.explode(entries).alias("_e")).select("_e.*", "n_rows")


#: Subgroup A learns from early hours without errors, so the subgroups' levels and references differ.
OWN_LEVELS = "subgroup = 'B' or (hour < 12 and cat <> 'error')"
LAYOUT_SQL = f"""with {SURV}, tr as (select * from surv where {OWN_LEVELS}),
    md as (select subgroup, coalesce(median(num), 0) mn, coalesce(median(hour), 0) mh from tr group by subgroup),
    lv as (select subgroup, cat, row_number() over (partition by subgroup order by cat) - 1 pos from (select distinct subgroup, cat from tr where cat is not null) u),
    wd as (select subgroup, count(*) - 1 w from lv group by subgroup)"""


@query(
    "transform_per_key",
    f"""{LAYOUT_SQL}, v as (select s.row_id, s.subgroup, (w + 2)::int size, 0 column_no, coalesce(num, mn) v from surv s join md using (subgroup) join wd using (subgroup)
      union all select s.row_id, s.subgroup, (w + 2)::int, pos, 1.0 from surv s join wd using (subgroup) join lv on lv.subgroup = s.subgroup and lv.cat = s.cat where pos > 0
      union all select s.row_id, s.subgroup, (w + 2)::int, w + 1, coalesce(hour::double, mh) from surv s join md using (subgroup) join wd using (subgroup))
    select row_id, subgroup, size, column_no::int column_no, v::double as value from v""",
    "value",
)
def _(spark, d):
    """Design vectors over each subgroup's own columns, one row per stored entry."""
    rows, keys = survey_events(spark, d), ["subgroup"]
    train = rows.where(OWN_LEVELS)
    medians, categories = P.fit_medians(train, keys, SPEC.numeric), P.fit_categories(train, keys, SPEC.categorical)
    found = P.sparse_design(rows, keys, SPEC, medians, categories, ["row_id", "subgroup"])
    cells = F.explode(F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v")))
    return found.select("row_id", "subgroup", "size", cells.alias("_c")).select(
        "row_id", "subgroup", "size", F.col("_c.i").alias("column_no"), F.col("_c.v").alias("value")
    )


@query(
    "expand_blocks_per_key",
    f"""{LAYOUT_SQL} select subgroup, 'time' block, 'hour' as column from md union all select subgroup, 'activity', 'num' from md
    union all select subgroup, 'activity', 'cat_' || cat from lv where pos > 0""",
)
def _(spark, d):
    """Covariate blocks of each subgroup with its own indicators."""
    rows, keys = survey_events(spark, d), ["subgroup"]
    train = rows.where(OWN_LEVELS)
    medians, categories = P.fit_medians(train, keys, SPEC.numeric), P.fit_categories(train, keys, SPEC.categorical)
    return P.expand_blocks_by_key({"time": ["hour"], "activity": ["cat", "num"]}, medians, categories, keys)


@query(
    "cumulative_blocks",
    """select region_no, block, string_agg(member, ',' order by o_no, member) members from (
      select a.r_regionkey region_no, a.r_name block, b.r_regionkey o_no, n.n_name member
      from region a join region b on b.r_regionkey <= a.r_regionkey join nation n on n.n_regionkey = b.r_regionkey) x
    group by 1, 2""",
)
def _(spark, d):
    """Ordered blocks with the members of all blocks up to each (nations by region here)."""
    members = read_table(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    blocks = (
        read_table(spark, d, "region").join(members, "r_regionkey")
        .groupBy(F.col("r_regionkey").alias("region_no"), F.col("r_name").alias("block"))
        .agg(F.sort_array(F.collect_list("n_name")).alias("columns"))
    )
    return P.cumulative_blocks(blocks, "region_no").select(
        "region_no", "block", F.concat_ws(",", "cumulative").alias("members")
    )


@query("preprocess_schema")
def _(spark, d):
    rows, keys = survey_events(spark, d), ["subgroup"]
    return P.learned_state(
        P.fit_medians(rows, keys, SPEC.numeric), P.fit_categories(rows, keys, SPEC.categorical), keys
    )


@query(
    "missing_data_flow",
    f"""with {SURV} select subgroup, count(*)::bigint raw_rows, count_if(cat <> 'error')::bigint analysis_rows,
    count_if(cat = 'error')::bigint rows_excluded, count_if(num is null)::bigint raw_missing_cells,
    count_if(cat <> 'error' and num is null)::bigint analysis_missing_cells,
    count_if(cat <> 'error' and num is null)::bigint predictor_missing_cells from surv group by subgroup""",
)
def _(spark, d):
    raw = survey_events(spark, d)
    return missing_data_flow(raw, raw.where("cat <> 'error'"), ["subgroup"], ["num", "hour"])
