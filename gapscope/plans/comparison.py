"""Queries on A minus B gaps, prevalence standardisation and decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import attenuation
from ..operators import gaps as G
from ..operators import metrics as M
from .registry import (
    A_LINE,
    A_ORD,
    B_LINE,
    B_ORD,
    COUNT_SQL,
    DOCS,
    GAP_ROW_NAMES,
    LINE,
    ORD,
    attenuation_sql,
    bayes_sql,
    disc_sql,
    gap_row_sql,
    linspace_sql,
    query,
    rates_sql,
    scored_docs,
    scored_lineitem,
    scored_orders,
    wide_sql,
)
from .performance import ece_sql

LINE_WIDE = wide_sql("line", "dataset", "subgroup", A_LINE, B_LINE)
ORD_WIDE = wide_sql("ord", "dataset", "subgroup", A_ORD, B_ORD)
THREE = ("ppv", "npv", "predicted_positive_rate")


def line_pairs(spark, d):
    return G.pair_counts(scored_lineitem(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE)


def order_pairs(spark, d):
    return G.pair_counts(scored_orders(spark, d), ["dataset"], "subgroup", A_ORD, B_ORD)


@query(
    "fairness_gaps",
    f"""with {LINE}, au as (select dataset, max(auroc) filter (subgroup = '{A_LINE}')
      - max(auroc) filter (subgroup = '{B_LINE}') auroc_diff
      from ({disc_sql('line', 'dataset, subgroup')}) x group by dataset)
    select dataset, sensitivity_a - sensitivity_b equal_opportunity_diff,
    greatest(abs(sensitivity_a - sensitivity_b), abs(fpr_a - fpr_b)) equalized_odds_diff,
    predicted_positive_rate_a - predicted_positive_rate_b demographic_parity_diff,
    predicted_positive_rate_a / nullif(predicted_positive_rate_b, 0) disparate_impact_ratio,
    ppv_a - ppv_b ppv_diff, npv_a - npv_b npv_diff, fnr_a - fnr_b fnr_diff, auroc_diff
    from ({LINE_WIDE}) w join au using (dataset)""",
    "equal_opportunity_diff equalized_odds_diff demographic_parity_diff disparate_impact_ratio "
    "ppv_diff npv_diff fnr_diff auroc_diff",
)
def _(spark, d):
    rows = scored_lineitem(spark, d)
    gaps = G.fairness_gaps(line_pairs(spark, d), ["dataset"])
    return gaps.join(G.auroc_gap(rows, ["dataset"], "subgroup", A_LINE, B_LINE), "dataset")


@query(
    "bayes_at_prevalence",
    f"""with {LINE}, m as (select *, {rates_sql()} from (
      select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup) c)
    select dataset, subgroup, 0.1::double at_prevalence,
    {bayes_sql('ppv', 'sensitivity', 'specificity', '0.1::double')} ppv,
    {bayes_sql('npv', 'sensitivity', 'specificity', '0.1::double')} npv,
    {bayes_sql('ppr', 'sensitivity', 'specificity', '0.1::double')} predicted_positive_rate from m""",
    "ppv npv predicted_positive_rate",
)
def _(spark, d):
    metrics = M.threshold_metrics(scored_lineitem(spark, d), ["dataset", "subgroup"])
    return G.bayes_at_prevalence(metrics, ["dataset", "subgroup"], F.lit(0.1))


def adjusted_sql(m: str) -> tuple[str, str]:
    return tuple(
        bayes_sql(m, f"sensitivity_{s}", f"specificity_{s}", "target_prevalence") for s in "ab"
    )


def prevalence_gap_sql(wide: str) -> str:
    parts = []
    di = "predicted_positive_rate_a / nullif(predicted_positive_rate_b, 0)"
    pa, pb = adjusted_sql("ppr")
    for m in THREE:
        a, b = adjusted_sql(m)
        raw = f"({m}_a - {m}_b)"
        parts.append(
            f"""select dataset, target_prevalence, '{m}' metric, {m}_a raw_a, {m}_b raw_b, {raw} raw_gap,
            {a} adjusted_a, {b} adjusted_b, {a} - {b} adjusted_gap,
            {attenuation_sql(raw, f'({a} - {b})')} attenuation_pct,
            {di} disparate_impact_raw, {pa} / nullif({pb}, 0) disparate_impact_adjusted from w"""
        )
    return f"w as ({wide}) " + " union all ".join(parts)


PREV_NAMES = (
    "target_prevalence raw_a raw_b raw_gap adjusted_a adjusted_b adjusted_gap attenuation_pct "
    "disparate_impact_raw disparate_impact_adjusted"
)


@query("prevalence_adjusted_gap", f"with {LINE}, {prevalence_gap_sql(LINE_WIDE)}", PREV_NAMES)
def _(spark, d):
    return G.prevalence_adjusted_gap(line_pairs(spark, d), ["dataset"])


@query(
    "attenuation_pct",
    f"""with {ORD}, w as ({ORD_WIDE}) select dataset, ppv_a - ppv_b raw_gap,
    {adjusted_sql('ppv')[0]} - {adjusted_sql('ppv')[1]} adjusted_gap,
    {attenuation_sql('(ppv_a - ppv_b)', f"({adjusted_sql('ppv')[0]} - {adjusted_sql('ppv')[1]})")} attenuation_pct
    from w""",
    "raw_gap adjusted_gap attenuation_pct",
    4,
)
def _(spark, d):
    wide = G.with_adjusted(G.with_side_rates(order_pairs(spark, d), G.CORE))
    raw, adj = F.col("ppv_a") - F.col("ppv_b"), F.col("ppv_adj_a") - F.col("ppv_adj_b")
    return wide.select(
        "dataset", raw.alias("raw_gap"), adj.alias("adjusted_gap"),
        attenuation(raw, adj).alias("attenuation_pct"),
    )


@query(
    "ipw_prevalence",
    f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    prev as (select dataset, subgroup, avg(y_true) p from r group by dataset, subgroup),
    tgt as (select dataset, avg(y_true) target_prevalence from r group by dataset),
    wt as (select r.*, target_prevalence, case when y_true = 1 then target_prevalence / p
      else (1 - target_prevalence) / (1 - p) end wgt
      from r join prev using (dataset, subgroup) join tgt using (dataset)),
    g as (select dataset, subgroup, target_prevalence,
      sum(wgt) filter (pred = 1 and y_true = 1) / sum(wgt) filter (pred = 1) ppv,
      sum(wgt) filter (pred = 0 and y_true = 0) / sum(wgt) filter (pred = 0) npv,
      sum(wgt) filter (pred = 1) / sum(wgt) predicted_positive_rate from wt group by all),
    ab as (select a.dataset, a.target_prevalence, a.ppv - b.ppv ppv, a.npv - b.npv npv,
      a.predicted_positive_rate - b.predicted_positive_rate predicted_positive_rate
      from g a join g b on a.dataset = b.dataset and a.subgroup = '{A_ORD}' and b.subgroup = '{B_ORD}'),
    lng as (unpivot ab on ppv, npv, predicted_positive_rate into name metric value ipw_adj_gap),
    w as ({ORD_WIDE}),
    bay as ({' union all '.join(f"select dataset, '{m}' metric, {adjusted_sql(m)[0]} - {adjusted_sql(m)[1]} bayes_adj_gap from w" for m in THREE)})
    select lng.dataset, target_prevalence, lng.metric, bayes_adj_gap, ipw_adj_gap,
    abs(bayes_adj_gap - ipw_adj_gap) absolute_diff
    from lng join bay on lng.dataset = bay.dataset and lng.metric = bay.metric""",
    "target_prevalence bayes_adj_gap ipw_adj_gap absolute_diff",
)
def _(spark, d):
    return G.ipw_prevalence(order_pairs(spark, d), ["dataset"])


def sweep_parts() -> str:
    out = []
    for m, short in (("ppv", "ppv"), ("npv", "npv"), ("ppr", "ppr")):
        a, b = (bayes_sql(m, f"sensitivity_{s}", f"specificity_{s}", "t") for s in "ab")
        out += [f"{a} {short}_a", f"{b} {short}_b", f"{a} - {b} {short}_gap"]
    return ", ".join(out)


@query(
    "prevalence_sweep",
    f"""with {LINE}, w as ({LINE_WIDE}), g as ({linspace_sql(0.01, 0.5, 50)})
    select *, ppr_a / nullif(ppr_b, 0) disparate_impact_ratio from (
      select dataset, t target_prevalence, {sweep_parts()} from w cross join g) x""",
    "target_prevalence ppv_a ppv_b ppv_gap npv_a npv_b npv_gap ppr_a ppr_b ppr_gap disparate_impact_ratio",
)
def _(spark, d):
    return G.prevalence_sweep(line_pairs(spark, d), ["dataset"])


def shapley_sql() -> str:
    """Average of the marginal contributions over all six orders of switching inputs."""
    from itertools import permutations

    names = ("sensitivity", "specificity", "prevalence")
    parts = []
    for m in THREE:
        total = {n: [] for n in names}
        for order in permutations(names):
            state = {n: f"{n}_b" for n in names}
            for n in order:
                before = bayes_sql(m, *[state[x] for x in names])
                state[n] = f"{n}_a"
                total[n].append(f"({bayes_sql(m, *[state[x] for x in names])} - {before})")
        shares = ", ".join(f"({' + '.join(v)}) / 6 shapley_{n}" for n, v in total.items())
        parts.append(f"select dataset, '{m}' metric, {m}_a - {m}_b raw_gap, {shares} from w")
    return " union all ".join(parts)


@query(
    "shapley_gap",
    f"""with {LINE}, w as ({LINE_WIDE}), s as ({shapley_sql()})
    select *, shapley_sensitivity + shapley_specificity + shapley_prevalence check_sum from s""",
    "raw_gap shapley_sensitivity shapley_specificity shapley_prevalence check_sum",
)
def _(spark, d):
    return G.shapley_gap(line_pairs(spark, d), ["dataset"])


POOLED = "auroc auprc brier ece"


def pooled_sql(src: str, keys: str) -> str:
    return f"""select * from ({disc_sql(src, keys)}) da join ({ece_sql(src, keys)}) e using ({keys})
    join (select {keys}, avg((prob - y_true) * (prob - y_true)) brier from {src} group by {keys}) b using ({keys})"""


@query(
    "gap_row",
    f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')), w as ({ORD_WIDE})
    select * from (select dataset, {gap_row_sql()} from w) g join ({pooled_sql('r', 'dataset')}) p using (dataset)""",
    GAP_ROW_NAMES + " " + POOLED,
    4,
)
def _(spark, d):
    return G.gap_row(scored_orders(spark, d), ["dataset"], "subgroup", A_ORD, B_ORD)


def noted_sql(src: str, keys: str, group: str, a: str, b: str) -> str:
    names = (GAP_ROW_NAMES + " " + POOLED).split()
    cols = ", ".join(f'case when ok then "{n}" end "{n}"' for n in names)
    return f"""select {keys}, n_a, n_b, {cols},
      case when ok then '' else 'insufficient sample size' end note from (
      select *, n_a >= 10 and n_b >= 10 ok from (
        select {keys}, n_a, n_b, {gap_row_sql()} from ({wide_sql(src, keys, group, a, b)}) ww) g
      join ({pooled_sql(f"(select * from {src} where {group} in ('{a}', '{b}')) kept", keys)}) p using ({keys})) z"""


@query(
    "intersectional_gap",
    f"with {DOCS} {noted_sql('docs', 'source', 'subgroup', 'en', 'fr')}",
    GAP_ROW_NAMES + " " + POOLED,
    4,
)
def _(spark, d):
    return G.stratum_gaps(scored_docs(spark, d), ["source"], "subgroup", "en", "fr")


ATTRIBUTES = {"status": ("F", "O"), "subgroup": (A_ORD, B_ORD)}


@query(
    "additional_attribute_gap",
    f"""with {ORD}, lng as (
      select dataset, y_true, prob, pred, 'status' attribute, case status when 'F' then 'A' when 'O' then 'B' end side from ord
      union all select dataset, y_true, prob, pred, 'subgroup',
        case subgroup when '{A_ORD}' then 'A' when '{B_ORD}' then 'B' end from ord)
    {noted_sql('lng', 'dataset, attribute', 'side', 'A', 'B')}""",
    GAP_ROW_NAMES + " " + POOLED,
    4,
)
def _(spark, d):
    return G.additional_attributes(scored_orders(spark, d), ["dataset"], ATTRIBUTES)
