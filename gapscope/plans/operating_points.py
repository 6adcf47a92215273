"""Queries on decision thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gaps as G
from ..operators import metrics as M
from ..operators import thresholds as H
from ..schema import SWEEP_METRICS
from .comparison import POOLED, pooled_sql
from .registry import (
    A_LINE,
    A_ORD,
    B_LINE,
    B_ORD,
    COUNT_SQL,
    GAP_ROW_NAMES,
    LINE,
    ORD,
    curve_sql,
    gap_row_sql,
    linspace_sql,
    query,
    rates_sql,
    scored_lineitem,
    scored_orders,
    wide_sql,
)


def grid_counts_sql(src: str, keys: str, start: float, stop: float, num: int) -> str:
    """Counts at every grid threshold by joining score cells with the grid."""
    prefixed = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    return f"""select {keys}, i step, t threshold,
      sum(case when prob >= t then pos else 0 end)::bigint tp, sum(case when prob >= t then neg else 0 end)::bigint fp,
      sum(case when prob < t then neg else 0 end)::bigint tn, sum(case when prob < t then pos else 0 end)::bigint fn
    from (select {prefixed}, prob, count_if(y_true = 1) pos, count_if(y_true = 0) neg from {src} c group by all) cells
    cross join ({linspace_sql(start, stop, num)}) grid group by all"""


@query(
    "threshold_curve",
    f"with {LINE} select dataset, subgroup, (step + 1)::int step, threshold, tp, fp, tn, fn from "
    f"({grid_counts_sql('line', 'dataset, subgroup', 0.01, 0.99, 99)}) x",
    "threshold",
)
def _(spark, d):
    return H.threshold_curve(scored_lineitem(spark, d), ["dataset", "subgroup"], H.SWEEP_GRID)


def sweep_sql() -> str:
    sides = []
    for s, label in (("a", A_LINE), ("b", B_LINE)):
        sides += [f"max({c}) filter (subgroup = '{label}') {c}_{s}" for c in ("tp", "fp", "tn", "fn")]
    cols = ", ".join(f'{m}_a "{m}_A", {m}_b "{m}_B", {m}_a - {m}_b {m}_gap' for m in SWEEP_METRICS)
    return f"""with {LINE}, curve as ({grid_counts_sql('line', 'dataset, subgroup', 0.01, 0.99, 99)}),
    p as (select dataset, step, threshold, {', '.join(sides)} from curve group by all),
    w as (select *, {rates_sql('_a')}, {rates_sql('_b')} from p)
    select dataset, round(threshold, 4) threshold, {cols},
      predicted_positive_rate_a / nullif(predicted_positive_rate_b, 0) disparate_impact_ratio from w"""


@query(
    "threshold_sweep",
    sweep_sql(),
    "threshold disparate_impact_ratio "
    + " ".join(f'"{m}_A" "{m}_B" {m}_gap' for m in SWEEP_METRICS),
)
def _(spark, d):
    return H.threshold_sweep(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)


def nearest_sql(curve: str, keys: str, metric: str, target: str) -> str:
    return f"""select {keys}, coalesce(first(threshold order by diff, threshold) filter (diff is not null), 0.5) threshold
    from (select *, abs({metric} - {target}) diff from (select *, {rates_sql()} from ({curve}) c0) c1) c2 group by {keys}"""


ORD_SEARCH = grid_counts_sql("ord", "dataset, subgroup", 0.001, 0.999, 999)


@query(
    "find_threshold_for_metric",
    f"with {ORD} {nearest_sql(ORD_SEARCH, 'dataset, subgroup', 'specificity', '0.8::double')}",
    "threshold",
)
def _(spark, d):
    return H.find_threshold_for_metric(
        scored_orders(spark, d), ["dataset", "subgroup"], "specificity", 0.8
    )


@query(
    "equal_sensitivity_threshold",
    f"""with {ORD}, pos as (select dataset, subgroup, prob,
      row_number() over (partition by dataset, subgroup order by prob desc) rn,
      count(*) over (partition by dataset, subgroup) n from ord where y_true = 1)
    select dataset, subgroup, prob threshold from pos where rn = ceil(0.8::double * n)""",
    "threshold",
)
def _(spark, d):
    return H.equal_sensitivity_threshold(scored_orders(spark, d), ["dataset", "subgroup"], 0.8)


@query(
    "top_k_threshold",
    f"with {ORD} select dataset, quantile_cont(price, 0.8) threshold from ord group by dataset",
    "threshold",
    4,
)
def _(spark, d):
    return H.top_k_threshold(scored_orders(spark, d), ["dataset"], 0.20, prob="price")


@query(
    "youden_threshold",
    f"""with {ORD} select dataset, subgroup, case when max(cum_pos / p_all - cum_neg / n_all) > 0 then
      first(prob order by cum_pos / p_all - cum_neg / n_all desc, prob desc) else 'infinity'::double end threshold
    from ({curve_sql('ord', 'dataset, subgroup')}) c group by dataset, subgroup""",
    "threshold",
)
def _(spark, d):
    return H.youden_threshold(scored_orders(spark, d), ["dataset", "subgroup"])


@query(
    "cost_threshold",
    f"""with {ORD} select dataset, subgroup, first(threshold order by 5 * fn + fp, threshold) threshold
    from ({grid_counts_sql('ord', 'dataset, subgroup', 0.01, 0.99, 199)}) c group by dataset, subgroup""",
    "threshold",
)
def _(spark, d):
    return H.cost_threshold(scored_orders(spark, d), ["dataset", "subgroup"])


@query(
    "two_group_thresholds",
    f"""with {LINE}, t as (select dataset, subgroup, avg(y_true) threshold from line group by dataset, subgroup)
    select dataset, subgroup, any_value(threshold) threshold, count_if(prob >= threshold)::bigint n_flagged
    from line join t using (dataset, subgroup) group by dataset, subgroup""",
    "threshold",
)
def _(spark, d):
    rows, keys = scored_lineitem(spark, d), ["dataset", "subgroup"]
    moved = H.with_thresholds(rows, H.train_prevalence_threshold(rows, keys), keys)
    return moved.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.sum("pred").alias("n_flagged")
    )


EQUAL_NAMES = ("sensitivity", "fnr", "specificity", "fpr", "ppv", "npv", "predicted_positive_rate")


def equal_metric_sql() -> str:
    wide = wide_sql("r", "dataset", "subgroup", A_ORD, B_ORD)
    pooled = "(tn_a + tn_b)::double / nullif(tn_a + tn_b + fp_a + fp_b, 0)"
    rows = " union all ".join(
        f"""select dataset, target_value, threshold_a, threshold_b, '{m}' metric, b.{m}_a before_a, b.{m}_b before_b,
        b.{m}_a - b.{m}_b gap_before, x.{m}_a after_a, x.{m}_b after_b, x.{m}_a - x.{m}_b gap_after,
        (x.{m}_a - x.{m}_b) - (b.{m}_a - b.{m}_b) gap_change,
        b.predicted_positive_rate_a / nullif(b.predicted_positive_rate_b, 0) dir_before,
        x.predicted_positive_rate_a / nullif(x.predicted_positive_rate_b, 0) dir_after
        from bef b join tgt using (dataset) join aft x using (dataset)
        join (select dataset, max(threshold) filter (subgroup = '{A_ORD}') threshold_a,
          max(threshold) filter (subgroup = '{B_ORD}') threshold_b from chosen group by dataset) th using (dataset)"""
        for m in EQUAL_NAMES
    )
    return f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    bef as ({wide}), tgt as (select dataset, {pooled} target_value from bef),
    curve as ({grid_counts_sql('r', 'dataset, subgroup', 0.001, 0.999, 999)}),
    chosen as (select dataset, subgroup, first(threshold order by abs(specificity - target_value), threshold) threshold
      from (select *, {rates_sql()} from curve) c join tgt using (dataset) group by dataset, subgroup),
    moved as (select r.* replace (case when prob >= threshold then 1 else 0 end as pred) from r join chosen using (dataset, subgroup)),
    aft as ({wide_sql('moved', 'dataset', 'subgroup', A_ORD, B_ORD)})
    {rows}"""


@query(
    "equal_metric_thresholds",
    equal_metric_sql(),
    "target_value threshold_a threshold_b before_a before_b gap_before after_a after_b gap_after "
    "gap_change dir_before dir_after",
)
def _(spark, d):
    return H.equal_metric_thresholds(
        scored_orders(spark, d), ["dataset"], "subgroup", A_ORD, B_ORD, "specificity", 0.5
    )


GAP_EXPR = {
    "equal_opportunity_diff": "{t}.sensitivity_a - {t}.sensitivity_b",
    "equalized_odds_diff": "greatest(abs({t}.sensitivity_a - {t}.sensitivity_b), abs({t}.fpr_a - {t}.fpr_b))",
    "demographic_parity_diff": "{t}.predicted_positive_rate_a - {t}.predicted_positive_rate_b",
    "disparate_impact_ratio": "{t}.predicted_positive_rate_a / nullif({t}.predicted_positive_rate_b, 0)",
    "ppv_diff": "{t}.ppv_a - {t}.ppv_b",
    "npv_diff": "{t}.npv_a - {t}.npv_b",
    "fnr_diff": "{t}.fnr_a - {t}.fnr_b",
}


@query(
    "equal_sensitivity_analysis",
    f"""with {LINE}, bef as ({wide_sql('line', 'dataset', 'subgroup', A_LINE, B_LINE)}),
    pos as (select dataset, subgroup, prob, row_number() over (partition by dataset, subgroup order by prob desc) rn,
      count(*) over (partition by dataset, subgroup) n from line where y_true = 1),
    th as (select p.dataset, p.subgroup, prob threshold from pos p join bef using (dataset)
      where rn = ceil(((tp_a + tp_b)::double / (n_pos_a + n_pos_b)) * p.n)),
    moved as (select line.* replace (case when prob >= threshold then 1 else 0 end as pred) from line join th using (dataset, subgroup)),
    aft as ({wide_sql('moved', 'dataset', 'subgroup', A_LINE, B_LINE)})
    {' union all '.join(f"select dataset, '{n}' gap, {e.format(t='bef')} shared_threshold, {e.format(t='aft')} equal_sensitivity, 'exploratory_descriptive' analysis_status from bef join aft using (dataset)" for n, e in GAP_EXPR.items())}""",
    "shared_threshold equal_sensitivity",
)
def _(spark, d):
    return H.equal_sensitivity_analysis(
        scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE
    )


def policies_sql() -> str:
    """Training rows are those with an earlier order status; test rows the open orders."""
    pick = {
        "fixed_050": "select dataset, 0.5::double threshold from tr group by dataset",
        "prevalence": "select dataset, avg(y_true) threshold from tr group by dataset",
        "youden": f"""select dataset, case when max(cum_pos / p_all - cum_neg / n_all) > 0 then
          first(prob order by cum_pos / p_all - cum_neg / n_all desc, prob desc) else 'infinity'::double end threshold
          from ({curve_sql('tr', 'dataset')}) c group by dataset""",
        "fixed_sensitivity": nearest_sql("select * from search", "dataset", "sensitivity", "0.8::double"),
        "fixed_specificity": nearest_sql("select * from search", "dataset", "specificity", "0.8::double"),
        "top_k": "select dataset, quantile_cont(prob, 0.8) threshold from tr group by dataset",
        "cost_sensitive": f"""select dataset, first(threshold order by 5 * fn + fp, threshold) threshold
          from ({grid_counts_sql('tr', 'dataset', 0.01, 0.99, 199)}) c group by dataset""",
    }
    th = " union all ".join(f"select dataset, '{p}' policy, threshold from ({q}) q" for p, q in pick.items())
    return f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    tr as (select * from r where status <> 'O'), te as (select * from r where status = 'O'),
    search as ({grid_counts_sql('tr', 'dataset', 0.001, 0.999, 999)}), th as ({th}),
    moved as (select te.* replace (case when prob >= threshold then 1 else 0 end as pred), policy, threshold
      from te join th using (dataset)),
    w as ({wide_sql('moved', 'dataset, policy, threshold', 'subgroup', A_ORD, B_ORD)})
    select * from (select dataset, policy, threshold, {gap_row_sql()} from w) g
    join ({pooled_sql('te', 'dataset')}) p using (dataset)"""


@query("threshold_policies", policies_sql(), "threshold " + GAP_ROW_NAMES + " " + POOLED, 4)
def _(spark, d):
    rows = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD))
    return H.threshold_policies(
        rows.where("status <> 'O'"), rows.where("status = 'O'"), ["dataset"], "subgroup", A_ORD, B_ORD
    )


def grid_sql() -> str:
    side = lambda s, label: (
        f"(select dataset, threshold threshold_{s}, n_pos n_pos_{s}, n_neg n_neg_{s}, sensitivity sensitivity_{s}, "
        f"specificity specificity_{s}, ppv ppv_{s}, npv npv_{s}, predicted_positive_rate ppr_{s} "
        f"from (select *, {rates_sql()} from curve) c where subgroup = '{label}')"
    )
    return f"""select dataset, threshold_a, threshold_b, abs(sensitivity_a - sensitivity_b) eo_violation,
      abs(ppr_a - ppr_b) dp_violation, abs(ppv_a - ppv_b) ppv_violation, abs(npv_a - npv_b) npv_violation,
      ((sensitivity_a * n_pos_a + sensitivity_b * n_pos_b) / (n_pos_a + n_pos_b)
       + (specificity_a * n_neg_a + specificity_b * n_neg_b) / (n_neg_a + n_neg_b)) / 2 utility
      from {side('a', A_LINE)} a join {side('b', B_LINE)} b using (dataset)
      where ppv_a is not null and ppv_b is not null and npv_a is not null and npv_b is not null"""


LINE_GRID = grid_counts_sql("line", "dataset, subgroup", 0.01, 0.99, 25)
GRID_NAMES = "threshold_a threshold_b eo_violation dp_violation ppv_violation npv_violation utility"


@query("join_grid_cross", f"with {LINE}, curve as ({LINE_GRID}) {grid_sql()}", GRID_NAMES)
def _(spark, d):
    return H.two_threshold_grid(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)


@query(
    "pareto_grid",
    f"""with {LINE}, curve as ({LINE_GRID}), g as materialized ({grid_sql()})
    select *, not exists (select 1 from g o where o.dataset = g.dataset
      and o.eo_violation <= g.eo_violation and o.dp_violation <= g.dp_violation
      and o.ppv_violation <= g.ppv_violation and o.npv_violation <= g.npv_violation and o.utility >= g.utility
      and (o.eo_violation < g.eo_violation or o.dp_violation < g.dp_violation or o.ppv_violation < g.ppv_violation
        or o.npv_violation < g.npv_violation or o.utility > g.utility)) pareto_optimal from g""",
    GRID_NAMES,
)
def _(spark, d):
    return H.pareto_grid(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)


@query(
    "join_dominance_anti",
    f"""with {LINE}, curve as ({LINE_GRID}), g as materialized ({grid_sql()})
    select dataset, count(*)::bigint n_optimal, max(utility) best_utility from g where not exists (
      select 1 from g o where o.dataset = g.dataset
      and o.eo_violation <= g.eo_violation and o.dp_violation <= g.dp_violation
      and o.ppv_violation <= g.ppv_violation and o.npv_violation <= g.npv_violation and o.utility >= g.utility
      and (o.eo_violation < g.eo_violation or o.dp_violation < g.dp_violation or o.ppv_violation < g.ppv_violation
        or o.npv_violation < g.npv_violation or o.utility > g.utility)) group by dataset""",
    "best_utility",
)
def _(spark, d):
    points = H.two_threshold_grid(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)
    best = H.non_dominated(points, ["dataset"]).where("pareto_optimal")
    return best.groupBy("dataset").agg(
        F.count("*").alias("n_optimal"), F.max("utility").alias("best_utility")
    )


@query(
    "train_prevalence_threshold",
    f"""with {ORD} select dataset, avg(y_true) threshold from ord
    where status <> 'O' and subgroup in ('{A_ORD}', '{B_ORD}') group by dataset""",
    "threshold",
)
def _(spark, d):
    rows = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD) & (F.col("status") != "O"))
    return H.train_prevalence_threshold(rows, ["dataset"])
