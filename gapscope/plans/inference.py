"""Queries on intervals, pooling over studies and multiple testing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import excludes_zero, ratio
from ..functions.tails import Z95, Z975
from ..operators import gaps as G
from ..operators import intervals as I
from ..operators import meta as X
from ..operators import metrics as M
from ..operators import report as RP
from ..operators import resample_design as RD
from .registry import (
    A_LINE,
    B_LINE,
    COUNT_SQL,
    LINE,
    query,
    rates_sql,
    scored_lineitem,
    scored_orders,
    ORD,
)

Z = f"{Z975!r}::double"


@query(
    "wilson_ci",
    f"""with {LINE}, c as (select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup),
    m as (select dataset, subgroup, 'prevalence' metric, tp + fn numerator, tp + fp + tn + fn denominator from c
      union all select dataset, subgroup, 'sensitivity', tp, tp + fn from c
      union all select dataset, subgroup, 'specificity', tn, tn + fp from c
      union all select dataset, subgroup, 'ppv', tp, tp + fp from c
      union all select dataset, subgroup, 'npv', tn, tn + fn from c),
    p as (select *, numerator::double / nullif(denominator, 0) point, nullif(denominator, 0)::double n, {Z} z from m)
    select dataset, subgroup, metric, point,
      greatest(0.0, (point + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(point * (1 - point) / n + z * z / (4 * n * n)) / (1 + z * z / n)) ci_low,
      least(1.0, (point + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(point * (1 - point) / n + z * z / (4 * n * n)) / (1 + z * z / n)) ci_high,
      'wilson' method, numerator, denominator from p""",
    "point ci_low ci_high",
)
def _(spark, d):
    keys = ["dataset", "subgroup"]
    return I.wilson_ci(M.confusion_counts(scored_lineitem(spark, d), keys), keys)


METRICS = ("sensitivity", "specificity", "ppv")
DENOMINATORS = {"sensitivity": ("tp", "fn"), "specificity": ("tn", "fp"), "ppv": ("tp", "fp")}


def yearly_gaps(spark, d):
    """Seven studies: the gap of three rates per ship year, with its normal interval."""
    pairs = G.pair_counts(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)
    rows = []
    for m, (hit, miss) in DENOMINATORS.items():
        p, n = {}, {}
        for s in "ab":
            total = F.col(f"{hit}_{s}") + F.col(f"{miss}_{s}")
            p[s], n[s] = ratio(F.col(f"{hit}_{s}"), total), total.cast("double")
        low, high = I.difference_interval(p["a"], n["a"], p["b"], n["b"])
        rows.append(
            F.struct(
                F.lit(m).alias("metric"), (p["a"] - p["b"]).alias("estimate"),
                low.alias("ci_low"), high.alias("ci_high"),
            )
        )
    long = pairs.select("dataset", F.explode(F.array(*rows)).alias("_r")).select("dataset", "_r.*")
    return long.withColumn("se", I.ci_to_se(F.col("ci_low"), F.col("ci_high")))


def yearly_sql() -> str:
    parts = []
    for m, (hit, miss) in DENOMINATORS.items():
        p = {s: f"({hit}_{s}::double / ({hit}_{s} + {miss}_{s}))" for s in "ab"}
        n = {s: f"({hit}_{s} + {miss}_{s})" for s in "ab"}
        sd = f"sqrt({p['a']} * (1 - {p['a']}) / {n['a']} + {p['b']} * (1 - {p['b']}) / {n['b']})"
        g = f"({p['a']} - {p['b']})"
        parts.append(f"select dataset, '{m}' metric, {g} estimate, {g} - {Z} * {sd} ci_low, {g} + {Z} * {sd} ci_high from pr")
    sides = ", ".join(
        f"count_if(subgroup = '{label}' and pred = {p} and y_true = {y}) {c}_{s}"
        for s, label in (("a", A_LINE), ("b", B_LINE))
        for c, (p, y) in {"tp": (1, 1), "fp": (1, 0), "tn": (0, 0), "fn": (0, 1)}.items()
    )
    return f"""{LINE}, pr as (select dataset, {sides} from line group by dataset),
    studies as (select *, (ci_high - ci_low) / (2 * {Z}) se from ({' union all '.join(parts)}) x)"""


STUDIES = yearly_sql()


@query("ci_to_se", f"with {STUDIES} select * from studies", "estimate ci_low ci_high se")
def _(spark, d):
    return yearly_gaps(spark, d).select("dataset", "metric", "estimate", "ci_low", "ci_high", "se")


@query(
    "significance_flag",
    f"""with {STUDIES} select dataset, metric, case when ci_low > 0 or ci_high < 0 then 'significant'
    else 'not_significant' end significance from studies""",
)
def _(spark, d):
    return yearly_gaps(spark, d).select(
        "dataset", "metric", excludes_zero(F.col("ci_low"), F.col("ci_high")).alias("significance")
    )


@query(
    "tost",
    f"""with {STUDIES}, t as (select dataset, metric, estimate, ci_low, ci_high, se, estimate - {Z95!r}::double * se tost_ci_low,
      estimate + {Z95!r}::double * se tost_ci_high, 0.04::double margin from studies)
    select *, tost_ci_low > -0.04 and tost_ci_high < 0.04 equivalent,
    case when tost_ci_low > -0.04 and tost_ci_high < 0.04 then 'statistically equivalent to zero within +/-0.04'
      when abs(estimate) <= 1e-12 and ci_high - ci_low > 0.08 then 'non-significant but underpowered -- not equivalence'
      else 'not equivalent to zero within +/-0.04' end interpretation from t""",
    "estimate ci_low ci_high se tost_ci_low tost_ci_high margin",
)
def _(spark, d):
    rows = yearly_gaps(spark, d).drop("se")
    return I.equivalence(rows, "estimate", "ci_low", "ci_high", 0.04)


def dl_sql(src: str, keys: str) -> str:
    """DerSimonian-Laird from the definition of Q around the fixed-effect mean."""
    return f"""select {keys}, any_value(k)::bigint k, any_value(q) q, any_value(tau2) tau2,
      sum(estimate / (se * se + tau2)) / sum(1 / (se * se + tau2)) pooled_estimate,
      sqrt(1 / sum(1 / (se * se + tau2))) pooled_se from (
      select s.*, k, q, case when c > 0 then greatest(0.0, (q - (k - 1)) / c) else 0 end tau2 from {src} s join (
        select {keys}, count(*) k, sum((estimate - m) * (estimate - m) / (se * se)) q,
          sum(1 / (se * se)) - sum(1 / (se * se * se * se)) / sum(1 / (se * se)) c from (
          select *, sum(estimate / (se * se)) over (partition by {keys}) / sum(1 / (se * se)) over (partition by {keys}) m
          from {src}) a group by {keys}) h using ({keys})) z group by {keys}"""


@query(
    "meta_random_effects",
    f"""with {STUDIES} select metric, k, pooled_estimate, pooled_se, pooled_estimate - {Z} * pooled_se pooled_ci_low,
    pooled_estimate + {Z} * pooled_se pooled_ci_high, tau2, q, k - 1 q_df,
    case when k > 1 and q > 0 then greatest(0.0, (q - (k - 1)) / q) * 100 else 0 end i2
    from ({dl_sql('studies', 'metric')}) x""",
    "pooled_estimate pooled_se pooled_ci_low pooled_ci_high tau2 q i2",
)
def _(spark, d):
    return X.random_effects(yearly_gaps(spark, d), ["metric"], tails=False)


@query("meta_random_effects_tails")
def _(spark, d):
    """With Q's p-value and the prediction interval, which DuckDB has no functions for."""
    return X.random_effects(yearly_gaps(spark, d), ["metric"])


@query(
    "meta_study_weights",
    f"""with {STUDIES} select s.metric, dataset, estimate, se,
    100 * (1 / (se * se)) / sum(1 / (se * se)) over (partition by s.metric) weight_fixed_pct,
    100 * (1 / (se * se + tau2)) / sum(1 / (se * se + tau2)) over (partition by s.metric) weight_random_pct
    from studies s join ({dl_sql('studies', 'metric')}) x on s.metric = x.metric""",
    "estimate se weight_fixed_pct weight_random_pct",
)
def _(spark, d):
    return X.study_weights(yearly_gaps(spark, d), ["metric"], "dataset")


@query(
    "leave_one_out",
    f"""with {STUDIES}, o as (select s.*, n.dataset excluded from studies s join studies n
      on s.metric = n.metric and s.dataset <> n.dataset)
    select metric, excluded, pooled_estimate, pooled_se, pooled_estimate - {Z} * pooled_se ci_low,
    pooled_estimate + {Z} * pooled_se ci_high, tau2 from ({dl_sql('o', 'metric, excluded')}) x""",
    "pooled_estimate pooled_se ci_low ci_high tau2",
)
def _(spark, d):
    return X.leave_one_out(yearly_gaps(spark, d), ["metric"], "dataset")


@query(
    "meta_subset",
    f"""with {STUDIES}, o as (select *, 'all_studies' analysis from studies
      union all select *, 'excluding_exploratory' from studies where dataset < 2000)
    select analysis, metric, k, pooled_estimate, pooled_se, tau2, q from ({dl_sql('o', 'analysis, metric')}) x""",
    "pooled_estimate pooled_se tau2 q",
)
def _(spark, d):
    studies = X.analysis_sets(yearly_gaps(spark, d), F.col("dataset") >= 2000)
    pooled = X.random_effects(studies, ["analysis", "metric"], tails=False)
    return pooled.select("analysis", "metric", "k", "pooled_estimate", "pooled_se", "tau2", "q")


BOUND = "case when dataset <> 1996 then exp(-(estimate / se) * (estimate / se) / 2) end"


@query(
    "bh_fdr",
    f"""with {STUDIES}, t as (select metric, dataset, {BOUND} p_value from studies),
    r as (select *, case when p_value is not null then row_number() over (partition by metric, p_value is not null
        order by p_value, dataset) end as rank, count(p_value) over (partition by metric) n from t)
    select metric, dataset, p_value, rank::int as rank, rank::double / n * 0.05 bh_critical_value,
    case when rank is not null then least(1.0, min(p_value * n / rank) over (partition by metric, p_value is not null
      order by rank rows between current row and unbounded following)) end q_value,
    coalesce(p_value <= rank::double / n * 0.05, false) significant_bh from r""",
    "p_value bh_critical_value q_value",
)
def _(spark, d):
    """Ranks a tail bound of each gap's z statistic; one year has no p-value."""
    z = F.col("estimate") / F.col("se")
    tests = yearly_gaps(spark, d).select(
        "metric", "dataset", F.when(F.col("dataset") != 1996, F.exp(-z * z / 2.0)).alias("p_value")
    )
    return X.bh_fdr(tests, ["metric"], tie=["dataset"])


MONTHLY = """mon as (select cast(year(l_shipdate) as int) dataset, cast(month(l_shipdate) as int) replicate,
    avg(case when 0.25::double + 0.015::double * l_quantity >= 0.4::double then 1.0::double else 0 end) as value
    from lineitem where l_returnflag = 'R' and l_linestatus = 'F' group by 1, 2)"""


def monthly(spark, d):
    """Twelve replicate-like values per year: monthly detection rates."""
    from ..sources.tables import read_table

    hit = F.lit(0.25) + F.lit(0.015) * F.col("l_quantity") >= 0.4
    return (
        read_table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'")
        .groupBy(F.year("l_shipdate").alias("dataset"), F.month("l_shipdate").alias("replicate"))
        .agg(F.avg(hit.cast("double")).alias("value"))
    )


@query(
    "percentile_interval",
    f"""with {MONTHLY} select dataset, quantile_cont(v, 0.025) ci_low, quantile_cont(v, 0.975) ci_high,
    count(v)::bigint n_valid_replicates, 12 - count(v)::bigint n_failed_replicates
    from (select dataset, case when replicate <> 12 then value end v from mon) x group by dataset""",
    "ci_low ci_high",
)
def _(spark, d):
    reps = monthly(spark, d).withColumn("value", F.when(F.col("replicate") != 12, F.col("value")))
    return I.percentile_interval(reps, ["dataset"], "value", 12)


@query(
    "stability_direction",
    f"""with {STUDIES}, s as (select metric, avg(estimate) mean_gap, stddev_pop(estimate) sd_gap, min(estimate) min_gap,
      max(estimate) max_gap, count_if(estimate > 0)::bigint n_positive_dir, count_if(estimate < 0)::bigint n_negative_dir
      from studies group by metric)
    select *, case when n_positive_dir > n_negative_dir then 'positive' else 'negative' end majority_direction,
    greatest(n_positive_dir, n_negative_dir) n_seeds_majority, greatest(n_positive_dir, n_negative_dir) >= 9 stable from s""",
    "mean_gap sd_gap min_gap max_gap",
)
def _(spark, d):
    return RP.stability_direction(yearly_gaps(spark, d), ["metric"], "estimate")


@query(
    "bootstrap_design",
    f"""with {LINE}, u as (select dataset, cluster_id, count(*) n, count(distinct subgroup) g from line group by 1, 2)
    select dataset, 'patient_cluster' resampling_unit, 'joint_patient_cluster_whole_test_set' resampling_design,
    count(*)::bigint n_resampling_units, sum(n)::bigint n_observations, count_if(g > 1)::bigint n_units_spanning_subgroups
    from u group by dataset""",
)
def _(spark, d):
    return RD.bootstrap_design(scored_lineitem(spark, d), ["dataset"], "subgroup", "cluster_id")


@query(
    "status_counts",
    f"""with {ORD}, c as (select dataset, status, count(*) n from ord group by 1, 2)
    select dataset, '{{' || string_agg('"' || status || '":' || n, ',' order by status) || '}}' status_counts from c group by dataset""",
)
def _(spark, d):
    return RP.status_counts(scored_orders(spark, d), ["dataset"])
