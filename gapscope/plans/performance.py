"""Queries on per-group performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import (
    clipped_logit,
    equal_width_bin,
    is_clipped,
    predicted,
)
from ..operators import metrics as M
from .registry import (
    A_LINE,
    A_ORD,
    B_LINE,
    B_ORD,
    COUNT_SQL,
    DOCS,
    LINE,
    ORD,
    RATE_NAMES,
    bin_sql,
    curve_sql,
    disc_sql,
    query,
    rates_sql,
    scored_docs,
    scored_lineitem,
    scored_orders,
)

KEYS = ["dataset", "subgroup"]


@query(
    "group_counts",
    f"""with {LINE} select dataset, subgroup, count(*)::bigint n, sum(y_true)::bigint n_pos,
    avg(y_true) prevalence from line group by dataset, subgroup""",
    "prevalence",
)
def _(spark, d):
    return M.group_counts(scored_lineitem(spark, d), KEYS)


@query(
    "confusion_counts",
    f"with {LINE} select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup",
)
def _(spark, d):
    return M.confusion_counts(scored_lineitem(spark, d), KEYS)


@query(
    "confusion_table",
    f"""with {ORD} select *, tp + fn n_pos, fp + tn n_neg, tp + fp + tn + fn n from (
    select dataset, subgroup, {COUNT_SQL} from ord where subgroup in ('{A_ORD}', '{B_ORD}')
    group by dataset, subgroup) c""",
)
def _(spark, d):
    rows = scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD))
    return M.confusion_table(rows, KEYS)


@query(
    "threshold_metrics",
    f"""with {LINE} select *, {rates_sql()} from (
    select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup) c""",
    RATE_NAMES,
)
def _(spark, d):
    return M.threshold_metrics(scored_lineitem(spark, d), KEYS)


@query("auroc", f"with {LINE} select dataset, subgroup, auroc from ({disc_sql('line', 'dataset, subgroup')}) x", "auroc")
def _(spark, d):
    return M.discrimination(scored_lineitem(spark, d), KEYS).drop("auprc")


@query("auprc", f"with {ORD} select dataset, subgroup, auprc from ({disc_sql('ord', 'dataset, subgroup')}) x", "auprc")
def _(spark, d):
    return M.discrimination(scored_orders(spark, d), KEYS).drop("auroc")


@query(
    "brier",
    f"""with {LINE} select dataset, subgroup, avg((prob - y_true) * (prob - y_true)) brier
    from line group by dataset, subgroup""",
    "brier",
)
def _(spark, d):
    return M.brier(scored_lineitem(spark, d), KEYS)


ECE_SQL = """select {keys}, sum(abs(sp - sy)) / sum(n) ece from (
  select {keys}, {bin} b, sum(prob) sp, sum(y_true) sy, count(*)::double n from {src}
  group by all) bins group by {keys}"""


def ece_sql(src: str, keys: str) -> str:
    return ECE_SQL.format(src=src, keys=keys, bin=bin_sql())


@query("ece", f"with {LINE} {ece_sql('line', 'dataset, subgroup')}", "ece")
def _(spark, d):
    return M.ece(scored_lineitem(spark, d), KEYS)


@query(
    "bin_equal_width",
    f"""with {LINE} select {bin_sql()}::int as bin, count(*)::bigint n, min(prob) low, max(prob) high
    from line group by 1""",
    "low high",
)
def _(spark, d):
    rows = scored_lineitem(spark, d).select(equal_width_bin("prob").alias("bin"), "prob")
    return rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.min("prob").alias("low"), F.max("prob").alias("high")
    )


@query(
    "calibration_curve",
    f"""with {LINE}, filled as (select dataset, subgroup, {bin_sql()}::int as bin, count(*)::bigint n,
      avg(prob) mean_predicted, avg(y_true) observed_rate from line group by all),
    spine as (select dataset, subgroup, i::int as bin from
      (select distinct dataset, subgroup from filled) k, generate_series(0, 9) g(i))
    select s.dataset, s.subgroup, s.bin, coalesce(n, 0)::bigint n, mean_predicted, observed_rate
    from spine s left join filled f on s.dataset = f.dataset and s.subgroup = f.subgroup and s.bin = f.bin""",
    "mean_predicted observed_rate",
)
def _(spark, d):
    return M.calibration_curve(scored_lineitem(spark, d), KEYS)


@query(
    "subgroup_metrics",
    f"""with {ORD}, c as (select dataset, subgroup, {COUNT_SQL},
      avg((prob - y_true) * (prob - y_true)) brier,
      count_if(prob <= 1e-6::double or prob >= 1 - 1e-6::double)::bigint calib_n_clipped
      from ord group by dataset, subgroup)
    select c.*, {rates_sql()}, ece, auroc, auprc from c
    join ({ece_sql('ord', 'dataset, subgroup')}) e using (dataset, subgroup)
    join ({disc_sql('ord', 'dataset, subgroup')}) a using (dataset, subgroup)""",
    RATE_NAMES + " brier ece auroc auprc",
)
def _(spark, d):
    return M.subgroup_metrics(scored_orders(spark, d), KEYS)


@query(
    "overall_and_subgroup",
    f"""with {LINE}, both_levels as (
      select dataset, subgroup, y_true, prob, pred from line
      union all select dataset, 'overall', y_true, prob, pred from line),
    c as (select dataset, subgroup, {COUNT_SQL},
      avg((prob - y_true) * (prob - y_true)) brier,
      count_if(prob <= 1e-6::double or prob >= 1 - 1e-6::double)::bigint calib_n_clipped
      from both_levels group by dataset, subgroup)
    select c.*, {rates_sql()}, ece, auroc, auprc from c
    join ({ece_sql('both_levels', 'dataset, subgroup')}) e using (dataset, subgroup)
    join ({disc_sql('both_levels', 'dataset, subgroup')}) a using (dataset, subgroup)""",
    RATE_NAMES + " brier ece auroc auprc",
)
def _(spark, d):
    return M.overall_and_subgroup(scored_lineitem(spark, d), ["dataset"])


@query(
    "roc_points",
    f"""with {LINE} select dataset, subgroup, prob threshold, cum_pos::bigint tp, cum_neg::bigint fp,
    cum_pos / nullif(p_all, 0) tpr, cum_neg / nullif(n_all, 0) fpr
    from ({curve_sql('line', 'dataset, subgroup')}) x""",
    "threshold tpr fpr",
)
def _(spark, d):
    return M.roc_points(scored_lineitem(spark, d), KEYS)


@query(
    "clip_logit",
    f"""with {DOCS}, p as (select subgroup, case when quality = 1 then prob else
        case when prob < 0.05::double then 0.0::double else prob end end q from docs)
    select subgroup, count(*)::bigint n, count_if(q <= 1e-6::double or q >= 1 - 1e-6::double)::bigint n_clipped,
    avg(ln(least(greatest(q, 1e-6::double), 1 - 1e-6::double) / (1 - least(greatest(q, 1e-6::double), 1 - 1e-6::double)))) mean_logit
    from p group by subgroup""",
    "mean_logit",
)
def _(spark, d):
    rows = scored_docs(spark, d).withColumn(
        "q", F.when((F.col("quality") != 1) & (F.col("prob") < 0.05), 0.0).otherwise(F.col("prob"))
    )
    return rows.groupBy("subgroup").agg(
        F.count("*").alias("n"),
        F.count_if(is_clipped("q")).alias("n_clipped"),
        F.avg(clipped_logit("q")).alias("mean_logit"),
    )


@query(
    "threshold_predict",
    f"""with {LINE} select dataset, subgroup,
    sum(case when prob >= 0.55::double then 1 else 0 end)::bigint n_flagged, count(*)::bigint n
    from line group by dataset, subgroup""",
)
def _(spark, d):
    rows = scored_lineitem(spark, d).withColumn("flag", predicted("prob", 0.55))
    return rows.groupBy(*KEYS).agg(
        F.sum("flag").alias("n_flagged"), F.count("*").alias("n")
    )


@query(
    "risk_decile_table",
    f"""with {LINE}, s as (select * from line where subgroup in ('{A_LINE}', '{B_LINE}')),
    edges as (select dataset, list_sort(list_distinct(quantile_cont(prob,
      [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) e from s group by dataset),
    lab as (select s.*, greatest(1, len(list_filter(e, lambda x: x < prob)))::int decile
      from s join edges using (dataset)),
    c as (select dataset, decile, subgroup, {COUNT_SQL}, min(prob) score_range_low, max(prob) score_range_high,
      avg(prob) mean_predicted_score from lab group by all)
    select dataset, decile, subgroup, score_range_low, score_range_high, n, n_pos, n_neg,
      prevalence observed_prevalence, mean_predicted_score, sensitivity, fnr, specificity, fpr, ppv, npv
    from (select *, {rates_sql()} from c) m""",
    "score_range_low score_range_high observed_prevalence mean_predicted_score sensitivity fnr "
    "specificity fpr ppv npv",
)
def _(spark, d):
    return M.risk_decile_table(scored_lineitem(spark, d), ["dataset"])


@query(
    "bin_quantile",
    f"""with {ORD}, edges as (select dataset, list_sort(list_distinct(quantile_cont(price,
      [0.0, 0.25, 0.5, 0.75, 1.0]))) e from ord group by dataset)
    select dataset, greatest(1, len(list_filter(e, lambda x: x < price)))::int quartile, count(*)::bigint n,
      min(price) low, max(price) high from ord join edges using (dataset) group by 1, 2""",
    "low high",
)
def _(spark, d):
    rows = scored_orders(spark, d).select("dataset", "price", "y_true", F.lit("all").alias("subgroup"), "pred")
    table = M.risk_decile_table(rows, ["dataset"], prob="price", parts=4)
    return table.select(
        "dataset", F.col("decile").alias("quartile"), "n",
        F.col("score_range_low").alias("low"), F.col("score_range_high").alias("high"),
    )


@query(
    "covariate_balance",
    f"""with {ORD}, w as (select dataset, subgroup, covariate, value from ord
      unpivot (value for covariate in (price, balance, prob)) where subgroup in ('{A_ORD}', '{B_ORD}')),
    g as (select dataset, covariate,
      avg(value) filter (subgroup = '{A_ORD}') mean_a, stddev_samp(value) filter (subgroup = '{A_ORD}') sd_a,
      count(value) filter (subgroup = '{A_ORD}')::bigint n_a,
      avg(value) filter (subgroup = '{B_ORD}') mean_b, stddev_samp(value) filter (subgroup = '{B_ORD}') sd_b,
      count(value) filter (subgroup = '{B_ORD}')::bigint n_b from w group by dataset, covariate),
    s as (select *, (mean_a - mean_b) / nullif(sqrt((sd_a * sd_a + sd_b * sd_b) / 2), 0) smd from g)
    select *, coalesce(abs(smd) > 0.1, false) meaningful_imbalance from s""",
    "mean_a sd_a mean_b sd_b smd",
    4,
)
def _(spark, d):
    return M.covariate_balance(
        scored_orders(spark, d), ["dataset"], ["price", "balance", "prob"], "subgroup", A_ORD, B_ORD
    )


@query(
    "score_distribution",
    f"""with {LINE} select dataset, subgroup, count(prob)::bigint n, avg(prob) mean, stddev_pop(prob) sd,
    quantile_cont(prob, 0.25) q25, quantile_cont(prob, 0.5) median, quantile_cont(prob, 0.75) q75
    from line where y_true = 1 group by dataset, subgroup""",
    "mean sd q25 median q75",
)
def _(spark, d):
    return M.score_distribution(scored_lineitem(spark, d), KEYS)


@query(
    "score_distribution_negatives",
    f"""with {LINE} select dataset, subgroup, count(prob)::bigint n, avg(prob) mean, stddev_pop(prob) sd,
    quantile_cont(prob, 0.25) q25, quantile_cont(prob, 0.5) median, quantile_cont(prob, 0.75) q75
    from line where y_true = 0 group by dataset, subgroup""",
    "mean sd q25 median q75",
)
def _(spark, d):
    return M.score_distribution(scored_lineitem(spark, d), KEYS, outcome=0)


@query(
    "all_groups_metrics",
    f"""with {ORD}, c as (select dataset, subgroup, {COUNT_SQL} from ord group by dataset, subgroup)
    select dataset, subgroup, case when subgroup in ('{A_ORD}', '{B_ORD}') then 'primary_heldout_test'
      else 'independent_nonprimary_holdout' end evaluation_partition,
    '{A_ORD}|{B_ORD}' model_training_groups, n, n_pos, prevalence, sensitivity, specificity, fnr, fpr,
    ppv, npv, predicted_positive_rate from (select *, {rates_sql()} from c) m""",
    "prevalence sensitivity specificity fnr fpr ppv npv predicted_positive_rate",
)
def _(spark, d):
    return M.all_groups_metrics(
        scored_orders(spark, d), ["dataset"], "subgroup", [A_ORD, B_ORD]
    )


@query(
    "metric_ci_counts",
    f"""with {LINE}, c as (select dataset, subgroup, {COUNT_SQL} from line group by dataset, subgroup)
    select dataset, subgroup, 'prevalence' metric, tp + fn numerator, tp + fp + tn + fn denominator from c
    union all select dataset, subgroup, 'sensitivity', tp, tp + fn from c
    union all select dataset, subgroup, 'specificity', tn, tn + fp from c
    union all select dataset, subgroup, 'ppv', tp, tp + fp from c
    union all select dataset, subgroup, 'npv', tn, tn + fn from c""",
)
def _(spark, d):
    return M.metric_denominators(M.confusion_counts(scored_lineitem(spark, d), KEYS), KEYS)


@query(
    "rank_separation",
    f"""with {LINE}, cells as (select dataset, prob, count_if(subgroup = '{A_LINE}')::double a,
      count_if(subgroup = '{B_LINE}')::double b from line where y_true = 1 group by dataset, prob),
    cum as (select *, sum(a) over w ca, sum(b) over w cb, sum(a) over (partition by dataset) na,
      sum(b) over (partition by dataset) nb from cells window w as (partition by dataset order by prob))
    select dataset, max(na)::bigint n_a, max(nb)::bigint n_b, max(abs(ca / na - cb / nb)) ks_stat,
      sum(a * (cb - b / 2)) u_stat, sum(a * (cb - b / 2)) / (max(na) * max(nb)) prob_a_higher
    from cum group by dataset""",
    "ks_stat u_stat prob_a_higher",
)
def _(spark, d):
    positives = scored_lineitem(spark, d).where("y_true = 1")
    return M.rank_separation(positives, ["dataset"], "subgroup", A_LINE, B_LINE).drop(
        "ks_p", "mwu_p_less"
    )


@query("ks_mwu")
def _(spark, d):
    """With the p-values, which have no SQL function to compare with."""
    positives = scored_lineitem(spark, d).where("y_true = 1")
    return M.rank_separation(positives, ["dataset"], "subgroup", A_LINE, B_LINE)
