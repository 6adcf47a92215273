"""Registry of named queries and the helpers both dialects share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Moves exact decimal ties off the rounding boundary, where the last bit of a sum would decide.
TIE_BREAK = 3.7e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles for comparison across engines (partial sums arrive in any order)."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") + F.lit(TIE_BREAK), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def rounded_sql(inner: str, doubles: str, digits: int = 6) -> str:
    """The same rounding around a SQL query; ``doubles`` lists its DOUBLE columns."""
    parts = ", ".join(f"round({c} + {TIE_BREAK!r}::double, {digits}) + 0.0 as {c}" for c in doubles.split())
    return f"select * replace ({parts}) from ({inner}) final_rows"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; its SQL gets the rounding wrapper when it has doubles."""

    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(spark, sf_dir), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        run.__doc__, run.__name__ = build.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = rounded_sql(sql, doubles, digits) if doubles else sql
        return build

    return wrap


# --- views -----------------------------------------------------------------

A_LINE, B_LINE = "F", "O"
A_ORD, B_ORD = "BUILDING", "MACHINERY"


def scored_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows clustered by order; one comparison per ship year."""
    y = (F.col("l_returnflag") == "R").cast("int")
    return read_table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("dataset"),
        F.col("l_orderkey").alias("cluster_id"),
        F.col("l_linestatus").alias("subgroup"),
        y.alias("y_true"),
        F.round(F.lit(0.25) * y + F.lit(0.015) * F.col("l_quantity"), 4).alias("prob"),
    ).withColumn("pred", (F.col("prob") >= 0.4).cast("int"))


LINE = """line as (
  select *, case when prob >= cast(0.4 as double) then 1 else 0 end pred from (
    select cast(year(l_shipdate) as int) dataset, l_orderkey cluster_id, l_linestatus subgroup,
           case when l_returnflag = 'R' then 1 else 0 end y_true,
           round(cast(0.25 as double) * (case when l_returnflag = 'R' then 1 else 0 end)
                 + cast(0.015 as double) * l_quantity, 4) prob
    from lineitem) raw_line)"""


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows with five subgroups, clustered by customer; one comparison per order year."""
    y = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    orders = read_table(spark, d, "orders")
    customer = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.year("o_orderdate").alias("dataset"),
            F.col("o_orderkey").alias("row_id"),
            F.col("o_custkey").cast("string").alias("cluster_id"),
            F.col("c_mktsegment").alias("subgroup"),
            y.alias("y_true"),
            F.round(F.lit(0.3) * y + F.lit(0.0069) * (F.col("o_orderkey") % 101), 4).alias("prob"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"),
            F.col("c_acctbal").alias("balance"),
        )
        .withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    )


ORD = """ord as (
  select *, case when prob >= cast(0.5 as double) then 1 else 0 end pred from (
    select cast(year(o_orderdate) as int) dataset, o_orderkey row_id,
           cast(o_custkey as varchar) cluster_id, c_mktsegment subgroup,
           case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end y_true,
           round(cast(0.3 as double) * (case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end)
                 + cast(0.0069 as double) * (o_orderkey % 101), 4) prob,
           o_orderstatus status, o_totalprice price, c_acctbal balance
    from orders join customer on o_custkey = c_custkey) raw_ord)"""


def survey_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows with missing values: amounts of 100 and more stand for "not stated"."""
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").cast("string").alias("cluster_id"),
        F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("subgroup"),
        (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        F.col("event_type").alias("cat"),
        F.when(F.col("value") < 100, F.col("value")).alias("num"),
        F.hour("ts").alias("hour"),
    )


SURV = """surv as (
  select event_id row_id, cast(user_id as varchar) cluster_id,
         case when user_id % 2 = 0 then 'A' else 'B' end subgroup,
         case when event_type = 'purchase' then 1 else 0 end y_true,
         event_type cat, case when value < 100 then value end num,
         cast(hour(ts) as int) as hour
  from events)"""


def scored_docs(spark: SparkSession, d: str) -> DataFrame:
    """Small subgroups: labelled documents by language, strata by source."""
    documents = read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, d, "labels")
    raw = F.round(F.lit(0.25) * F.col("toxic") + F.lit(0.0001) * (F.col("n_chars") % 5000), 4)
    return (
        labels.join(documents, "doc_id")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("lang").alias("subgroup"),
            F.col("toxic").alias("y_true"),
            "quality", "source", "n_chars",
            F.least(F.lit(0.99), F.greatest(F.lit(0.01), raw)).alias("prob"),
        )
        .withColumn("pred", (F.col("prob") >= 0.3).cast("int"))
    )


DOCS = """docs as (
  select *, case when prob >= cast(0.3 as double) then 1 else 0 end pred from (
    select l.doc_id row_id, lang subgroup, toxic y_true, quality, source, n_chars,
           least(cast(0.99 as double), greatest(cast(0.01 as double),
             round(cast(0.25 as double) * toxic + cast(0.0001 as double) * (n_chars % 5000), 4))) prob
    from labels l join documents d on l.doc_id = d.doc_id) raw_docs)"""


# --- SQL text for the comparison statements ---------------------------------

COUNT_SQL = """count_if(pred = 1 and y_true = 1)::bigint tp, count_if(pred = 1 and y_true = 0)::bigint fp,
  count_if(pred = 0 and y_true = 0)::bigint tn, count_if(pred = 0 and y_true = 1)::bigint fn"""


def rates_sql(suffix: str = "") -> str:
    """Rates from columns tp, fp, tn, fn (with an optional common suffix)."""
    s = suffix
    tp, fp, tn, fn = f"tp{s}", f"fp{s}", f"tn{s}", f"fn{s}"
    sens = f"({tp}::double / nullif({tp} + {fn}, 0))"
    spec = f"({tn}::double / nullif({tn} + {fp}, 0))"
    ppv = f"({tp}::double / nullif({tp} + {fp}, 0))"
    npv = f"({tn}::double / nullif({tn} + {fn}, 0))"
    n = f"({tp} + {fp} + {tn} + {fn})"
    return f"""{n}::bigint n{s}, ({tp} + {fn})::bigint n_pos{s}, ({tn} + {fp})::bigint n_neg{s},
  ({tp} + {fn})::double / nullif({n}, 0) prevalence{s},
  ({tp} + {fp})::double / nullif({n}, 0) predicted_positive_rate{s},
  {sens} sensitivity{s}, {spec} specificity{s}, 1 - {spec} fpr{s}, 1 - {sens} fnr{s},
  {ppv} ppv{s}, {npv} npv{s},
  case when {ppv} + {sens} > 0 then 2 * {ppv} * {sens} / ({ppv} + {sens}) end f1{s}"""


RATE_NAMES = (
    "prevalence predicted_positive_rate sensitivity specificity fpr fnr ppv npv f1"
)


def pairs_sql(source: str, keys: str, group: str, a: str, b: str) -> str:
    """One row per comparison with tp_a .. fn_b."""
    cols = []
    for side, label in (("a", a), ("b", b)):
        for c, (p, y) in {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}.items():
            cols.append(
                f"count_if({group} = '{label}' and pred = {p} and y_true = {y})::bigint {c}_{side}"
            )
    return (
        f"select {keys}, {', '.join(cols)} from {source} "
        f"where {group} in ('{a}', '{b}') group by {keys}"
    )


def wide_sql(source: str, keys: str, group: str, a: str, b: str) -> str:
    """Pairs with both sides' rates and the pooled prevalence."""
    return f"""select *, (n_pos_a + n_pos_b)::double / nullif(n_a + n_b, 0) target_prevalence from (
  select *, {rates_sql('_a')}, {rates_sql('_b')} from ({pairs_sql(source, keys, group, a, b)}) p0) p1"""


def bayes_sql(metric: str, sens: str, spec: str, prev: str) -> str:
    """PPV, NPV or predicted-positive rate at a prevalence."""
    hit, alarm = f"({sens} * {prev})", f"((1 - {spec}) * (1 - {prev}))"
    rest, miss = f"({spec} * (1 - {prev}))", f"((1 - {sens}) * {prev})"
    if metric == "ppv":
        return f"({hit} / nullif({hit} + {alarm}, 0))"
    if metric == "npv":
        return f"({rest} / nullif({rest} + {miss}, 0))"
    return f"({hit} + {alarm})"


def attenuation_sql(raw: str, adj: str) -> str:
    return f"(100.0::double * ({raw} - {adj}) / nullif({raw}, 0))"


GAP_ROW_NAMES = (
    "sensitivity_A sensitivity_B sensitivity_gap fnr_gap specificity_gap fpr_gap ppr_gap "
    "disparate_impact_ratio ppv_gap_raw ppv_gap_adj ppv_attenuation_pct npv_gap_raw npv_gap_adj "
    "npv_attenuation_pct"
)


def gap_row_sql() -> str:
    """Gap columns over the columns of :func:`wide_sql`."""
    t = "target_prevalence"
    adj = {
        m: f"({bayes_sql(m, 'sensitivity_a', 'specificity_a', t)} - {bayes_sql(m, 'sensitivity_b', 'specificity_b', t)})"
        for m in ("ppv", "npv")
    }
    return f"""sensitivity_a "sensitivity_A", sensitivity_b "sensitivity_B",
  sensitivity_a - sensitivity_b sensitivity_gap, fnr_a - fnr_b fnr_gap,
  specificity_a - specificity_b specificity_gap, fpr_a - fpr_b fpr_gap,
  predicted_positive_rate_a - predicted_positive_rate_b ppr_gap,
  predicted_positive_rate_a / nullif(predicted_positive_rate_b, 0) disparate_impact_ratio,
  ppv_a - ppv_b ppv_gap_raw, {adj['ppv']} ppv_gap_adj,
  {attenuation_sql('(ppv_a - ppv_b)', adj['ppv'])} ppv_attenuation_pct,
  npv_a - npv_b npv_gap_raw, {adj['npv']} npv_gap_adj,
  {attenuation_sql('(npv_a - npv_b)', adj['npv'])} npv_attenuation_pct"""


def curve_sql(source: str, keys: str, where: str = "true") -> str:
    """Cumulative positives and negatives by descending score."""
    return f"""select *, sum(pos) over (partition by {keys}) p_all, sum(neg) over (partition by {keys}) n_all,
  sum(pos) over (partition by {keys} order by prob desc) cum_pos,
  sum(neg) over (partition by {keys} order by prob desc) cum_neg from (
  select {keys}, prob, count_if(y_true = 1)::double pos, count_if(y_true = 0)::double neg
  from {source} where {where} group by {keys}, prob) cells"""


def disc_sql(source: str, keys: str, where: str = "true") -> str:
    return f"""select {keys}, sum(neg * (cum_pos - pos / 2)) / nullif(max(p_all) * max(n_all), 0) auroc,
  case when max(n_all) > 0 then sum(pos * cum_pos / (cum_pos + cum_neg)) / nullif(max(p_all), 0) end auprc
  from ({curve_sql(source, keys, where)}) curve group by {keys}"""


def linspace_sql(start: float, stop: float, num: int, name: str = "t") -> str:
    """Rows (i, t) of an evenly spaced grid with NumPy's end-point rule."""
    step = f"((cast({stop!r} as double) - cast({start!r} as double)) / {num - 1})"
    return (
        f"select i::int i, case when i = {num - 1} then cast({stop!r} as double) "
        f"else i * {step} + cast({start!r} as double) end {name} "
        f"from generate_series(0, {num - 1}) g(i)"
    )


def bin_sql(p: str = "prob", bins: int = 10) -> str:
    """Equal-width bin through comparisons with the edge doubles."""
    terms = " + ".join(
        f"(case when {p} >= {float(e)!r}::double then 1 else 0 end)"
        for e in [i * 0.1 for i in range(1, bins)]
    )
    return f"({terms})"
