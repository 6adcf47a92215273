"""Queries on resampling, regressions and models (compared by row count only, unless noted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import permute as PM
from ..operators import regress as RG
from ..operators import report as RP
from ..operators import resample as RS
from ..operators import resample_design as RD
from ..operators import splits as S
from ..operators import metrics as M
from ..operators.prep import Categorical, DesignSpec
from ..functions.tails import Z975
from ..session import scratch_folder
from .comparison import POOLED, pooled_sql
from .registry import (
    A_LINE,
    A_ORD,
    B_LINE,
    B_ORD,
    GAP_ROW_NAMES,
    LINE,
    ORD,
    disc_sql,
    gap_row_sql,
    query,
    scored_lineitem,
    scored_orders,
    wide_sql,
)

REPLICATES = 1000
IPW_REPLICATES = 500
CURVE_REPLICATES = 300
OUTCOME_PERMUTATIONS = 200
POOL = L.PoolSettings()
SPLIT_SEEDS = list(range(10))
SPEC = DesignSpec(["prob", "price", "balance", "status"], [Categorical("status", "status", True)])
BLOCKS = {"amounts": ["price_k", "balance_k"], "score": ["prob"]}


def lines(spark, d):
    return scored_lineitem(spark, d)


def two_segments(spark, d):
    """Orders of the two compared segments, amounts in thousands."""
    return scored_orders(spark, d).where(F.col("subgroup").isin(A_ORD, B_ORD)).withColumn(
        "price_k", F.col("price") / 1000.0
    ).withColumn("balance_k", F.col("balance") / 1000.0)


def train_test(spark, d):
    parts = S.split_grouped(two_segments(spark, d), []).persist()
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")


def folded_train(spark, d):
    train, test = train_test(spark, d)
    return S.kfold_grouped(train, []), test


# --- resampling -----------------------------------------------------------------------


@query("bootstrap_rows")
def _(spark, d):
    return RS.bootstrap_comparison(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, n_boot=REPLICATES)[0]


@query("bootstrap_clusters")
def _(spark, d):
    return RS.bootstrap_comparison(
        lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, "cluster_id", n_boot=REPLICATES
    )[0]


@query("calibration_status_counts")
def _(spark, d):
    return RS.bootstrap_comparison(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, n_boot=REPLICATES)[1]


POINTS_SQL = f"""with {LINE}, c as (select dataset,
    count_if(subgroup = 'F' and pred = 1 and y_true = 1)::double tpa, count_if(subgroup = 'F' and y_true = 1) pa,
    count_if(subgroup = 'O' and pred = 1 and y_true = 1)::double tpb, count_if(subgroup = 'O' and y_true = 1) pb,
    avg((prob - y_true) * (prob - y_true)) brier from line group by dataset),
  o as (select dataset, auroc from ({disc_sql('line', 'dataset')}) x)
  select dataset, tpa / pa sensitivity_a, tpb / pb sensitivity_b, tpa / pa - tpb / pb sensitivity_gap, brier, auroc
  from c join o using (dataset)"""


@query("bootstrap_points", POINTS_SQL, "sensitivity_a sensitivity_b sensitivity_gap brier auroc")
def _(spark, d):
    """Replicate 0 of the score bootstrap: the observed statistics through the same path."""
    packed = RS.weighted_cells_by_cluster(
        lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, "cluster_id", 2, 42, "y_true", "prob", "pred"
    )
    stats = RS.count_statistics(RS.score_replicates(packed, ["dataset"], 2), ["dataset"])
    return stats.where("replicate = 0").select(
        "dataset", F.col("subgroup_a__sensitivity").alias("sensitivity_a"),
        F.col("subgroup_b__sensitivity").alias("sensitivity_b"),
        F.col("gap__sensitivity").alias("sensitivity_gap"),
        F.col("calibration__brier_overall").alias("brier"),
        F.col("discrimination__auroc_overall").alias("auroc"),
    )


@query("bootstrap_gap")
def _(spark, d):
    return RS.bootstrap_gap(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, "ppv", REPLICATES, adjust=True)


@query("bootstrap_auroc")
def _(spark, d):
    table, _ = RS.bootstrap_comparison(
        lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, n_boot=REPLICATES, calibration=False
    )
    return table.where("block = 'discrimination'")


@query("bootstrap_auroc_gap")
def _(spark, d):
    table, _ = RS.bootstrap_comparison(
        scored_orders(spark, d), ["dataset"], "subgroup", A_ORD, B_ORD, n_boot=REPLICATES, calibration=False
    )
    return table.where("metric = 'auroc_gap'")


@query("cluster_vs_naive")
def _(spark, d):
    return RS.cluster_vs_naive(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, "cluster_id", REPLICATES)


@query("ipw_interval")
def _(spark, d):
    return RS.ipw_interval(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, IPW_REPLICATES)


@query("calibration_curve_ci")
def _(spark, d):
    return RS.calibration_curve_ci(lines(spark, d), ["dataset", "subgroup"], CURVE_REPLICATES)


NEWTON_SQL = f"""with recursive {LINE},
  cells as (select dataset, subgroup, ln(p / (1 - p)) x, count(*)::double n, sum(y_true)::double pos from (
    select dataset, subgroup, y_true, least(greatest(prob, 1e-6::double), 1 - 1e-6::double) p from line) q group by all),
  fit as (select 0 it, dataset, subgroup, 0.0::double a, 0.0::double b from (select distinct dataset, subgroup from cells) k
    union all
    select it + 1, dataset, subgroup, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
      b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) from (
      select f.it, f.dataset, f.subgroup, f.a, f.b, sum(pos - n * mu) g0, sum((pos - n * mu) * x) g1,
        sum(n * mu * (1 - mu)) h00, sum(n * mu * (1 - mu) * x) h01, sum(n * mu * (1 - mu) * x * x) h11
      from (select f.*, c.x, c.n, c.pos, 1 / (1 + exp(-(f.a + f.b * c.x))) mu from fit f
        join cells c on c.dataset = f.dataset and c.subgroup = f.subgroup where f.it < 12) f
      group by f.it, f.dataset, f.subgroup, f.a, f.b) s)
  select dataset, subgroup, a calib_intercept, b calib_slope, 'ok' calib_status from fit where it = 12"""


@query("calibration_fit", NEWTON_SQL, "calib_intercept calib_slope")
def _(spark, d):
    return RS.calibration_fit(lines(spark, d), ["dataset", "subgroup"])


@query("permutation_group")
def _(spark, d):
    return RS.permutation_group(lines(spark, d), ["dataset"], "subgroup", A_LINE, B_LINE, 1000)


@query("permutation_outcome")
def _(spark, d):
    train, test = train_test(spark, d)
    return PM.outcome_permutation(
        train, test, ["prob", "price_k", "balance_k"], "subgroup", A_ORD, B_ORD, n_perm=OUTCOME_PERMUTATIONS, threshold=0.4
    )


def performance_file(spark, d, n_boot: int):
    """The performance file of the yearly comparison of both segments, clustered by customer."""
    rows, keys = scored_orders(spark, d), ["dataset"]
    kept = rows.where(F.col("subgroup").isin(A_ORD, B_ORD))
    table, statuses = RS.bootstrap_comparison(kept, keys, "subgroup", A_ORD, B_ORD, cluster="cluster_id", n_boot=n_boot)
    found = RP.performance_rows(M.overall_and_subgroup(kept, keys), table, statuses, keys, {"a": A_ORD, "b": B_ORD})
    named = {
        "dataset": F.col("dataset").cast("string"), "comparison_type": F.lit("segment"), "comparison": F.lit(f"{A_ORD}_vs_{B_ORD}"),
        "group": F.initcap("subgroup"), "selected_family": F.lit("logistic_regression"), "operating_threshold": F.lit(0.5),
    }
    return RP.performance_export(found, RD.bootstrap_design(kept, keys, "subgroup", "cluster_id"), keys, named, n_boot)


@query("export_performance")
def _(spark, d):
    """Overall, A and B rows with bootstrap limits and replicate status counts, all columns of the contract."""
    return performance_file(spark, d, REPLICATES)


PERFORMANCE_POINTS = f"""with {ORD}, k as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    g as (select dataset, 'overall' grp, y_true, prob, cluster_id from k union all select dataset, subgroup, y_true, prob, cluster_id from k),
    c as (select dataset, grp, count(*)::bigint n, sum(y_true)::bigint n_events, avg((prob - y_true) * (prob - y_true)) brier from g group by 1, 2),
    u as (select dataset, cluster_id, count(distinct subgroup) s from k group by 1, 2),
    r as (select dataset, count(*)::bigint n_resampling_units, count_if(s > 1)::bigint n_units_spanning_subgroups from u group by 1)
    select dataset::varchar dataset, 'segment' comparison_type, '{A_ORD}_vs_{B_ORD}' comparison,
      upper(grp[1]) || lower(grp[2:]) as "group", grp group_value, n, n_events, 'logistic_regression' selected_family, 0.5::double operating_threshold,
      auroc, brier, 'percentile' ci_method, 'patient_cluster' resampling_unit, n_resampling_units, n_units_spanning_subgroups
    from c join ({disc_sql('g', 'dataset, grp')}) x using (dataset, grp) join r using (dataset)"""


@query("export_performance_points", PERFORMANCE_POINTS, "operating_threshold auroc brier")
def _(spark, d):
    """Everything in the performance files that does not depend on a draw, through both reporting tables."""
    first, second = RP.united_performance([performance_file(spark, d, 2)])
    on = ["dataset", "comparison_type", "comparison", "group", "group_value", "n", "n_events", "ci_method", "resampling_unit"]
    return first.join(second.select(*on, "brier"), on).select(
        *on, "selected_family", "operating_threshold", "auroc", "brier", "n_resampling_units", "n_units_spanning_subgroups"
    )


# --- regressions ----------------------------------------------------------------------


PAIR = f"""{ORD}, pair as (select *, price / 1000.0 price_k, balance / 1000.0 balance_k,
    (subgroup = '{A_ORD}')::int::double in_a, 1 - pred miss, pred alarm
  from ord where subgroup in ('{A_ORD}', '{B_ORD}'))"""


def z_sql(columns: list[str]) -> str:
    """z-scores over the comparison's rows of a subquery."""
    return ", ".join(
        f"({c} - avg({c}) over (partition by dataset)) / coalesce(nullif(stddev_pop({c}) over (partition by dataset), 0), 1) z_{c}"
        for c in columns
    )


def newton_sql(name: str, source: str, label: str, terms: list[str], ridge: float = 0.0, steps: int = 14) -> str:
    """CTE ``name``: dataset, b0 .. bp and the Wald variances v1 .. vp of a logistic regression by Newton's method.

    Each step solves its linear system by elimination, one nested query a pivot.
    """
    x = ["1.0::double", *terms]
    n = len(x)
    idx = range(n)
    b = ", ".join(f"b{i}" for i in idx)
    sums = [f"sum((yy - mu) * x{i}) - {ridge if i else 0.0}::double * any_value(b{i}) g{i}" for i in idx]
    sums += [
        f"sum(mu * (1 - mu) * x{i} * x{j}) + {ridge if i == j and i else 0.0}::double m{i}_{j}" for i in idx for j in idx
    ]
    inner = (
        f"select f.it, f.dataset, {', '.join(f'f.b{i}' for i in idx)}, {', '.join(sums)} from ("
        f"select s.*, 1 / (1 + exp(-({' + '.join(f's.b{i} * s.x{i}' for i in idx)}))) mu from ("
        f"select w.it, w.dataset, {', '.join(f'w.b{i}' for i in idx)}, {label}::double yy, {', '.join(f'({t})::double x{i}' for i, t in enumerate(x))} "
        f"from {name}_fit w join {source} r on w.dataset = r.dataset where w.it < {steps}) s) f group by f.it, f.dataset, {', '.join(f'f.b{i}' for i in idx)}"
    )
    # augmented with the identity, so that the inverse's diagonal comes out as well
    extra = [f"e{k}" for k in idx]
    q = "select *, " + ", ".join(f"{1.0 if i == k else 0.0}::double e{k}_{i}" for k in idx for i in idx) + f" from ({inner}) a0"
    for p in idx:
        out = []
        for i in idx:
            factor = f"(m{i}_{p} / m{p}_{p})"
            for c in [f"m{i}_{j}" for j in idx] + [f"g{i}"] + [f"{e}_{i}" for e in extra]:
                pivot = c.replace(f"m{i}_", f"m{p}_") if c.startswith("m") else f"g{p}" if c.startswith("g") else c.rsplit("_", 1)[0] + f"_{p}"
                out.append(f"{pivot} / m{p}_{p} {c}" if i == p else f"{c} - {factor} * {pivot} {c}")
        q = f"select it, dataset, {b}, {', '.join(out)} from ({q}) q{p}"
    start = f"select 0 it, dataset, {', '.join(f'0.0::double b{i}' for i in idx)}, {', '.join(f'0.0::double v{i}' for i in idx)} from (select distinct dataset from {source}) d"
    step = f"select it + 1, dataset, {', '.join(f'b{i} + g{i}' for i in idx)}, {', '.join(f'e{i}_{i}' for i in idx)} from ({q}) z"
    return f"{name}_fit as ({start} union all {step}), {name} as (select * from {name}_fit where it = {steps})"


def normal_p_sql(z: str, parts: int = 800) -> str:
    """Two-sided tail of the normal law by Simpson's rule."""
    w = f"(abs({z}) / {parts})"
    body = f"list_sum(list_transform(range(0, {parts + 1}), lambda i: (case when i in (0, {parts}) then 1 when i % 2 = 1 then 4 else 2 end) * exp(-0.5 * (i * {w}) * (i * {w}))))"
    return f"(1 - 2 * {w} / 3 * {body} / sqrt(2 * pi()))"


def error_sql(kind: str) -> str:
    label, y = ("miss", 1) if kind == "fn" else ("alarm", 0)
    base = "in_a, z_price_k, z_balance_k"
    z = f"errs as (select *, {label} err, {z_sql(['price_k', 'balance_k', 'prob'])} from pair where y_true = {y})"
    raw = newton_sql("raw", "errs", "err", ["in_a"])
    amounts = newton_sql("amounts", "errs", "err", base.split(", "))
    head = """head as (select dataset, count(*)::bigint n_obs, sum(err)::bigint n_error, avg(err) filter (in_a = 1) error_rate_a,
      avg(err) filter (in_a = 0) error_rate_b, max(prob) filter (err = 1) < min(prob) filter (err = 0)
      or min(prob) filter (err = 1) > max(prob) filter (err = 0) split from errs group by dataset)"""
    steps = """steps as (select 0 step_no, 'raw (group only)' step, 1 n_features, dataset, b1, v1, b1 raw_b from raw
      union all select 1, 'amounts', 3, a.dataset, a.b1, a.v1, r.b1 from amounts a join raw r using (dataset)
      union all select 2, 'score', 4, dataset, null, null, null from head where split)"""
    return f"""with recursive {PAIR}, {z}, {head}, {raw}, {amounts}, {steps}
      select dataset, step_no::int step_no, step, n_obs, n_error, error_rate_a, error_rate_b, b1 log_or, exp(b1) odds_ratio,
        exp(b1 - {Z975!r}::double * sqrt(v1)) or_ci_low, exp(b1 + {Z975!r}::double * sqrt(v1)) or_ci_high,
        {normal_p_sql('b1 / sqrt(v1)')} p_value, n_features::int n_features,
        100 * (raw_b - b1) / nullif(raw_b, 0) pct_of_raw_coef_explained,
        case when step = 'score' then 'separation' else 'ok' end status
      from steps join head using (dataset)"""


ERROR_DOUBLES = "error_rate_a error_rate_b log_or odds_ratio or_ci_low or_ci_high p_value pct_of_raw_coef_explained"
CASE_MIX_SQL = f"""with recursive {PAIR}, {newton_sql("m0", "pair", "y_true", ["in_a"], 1.0)},
  {newton_sql("m1", "pair", "y_true", ["in_a", "price_k", "balance_k"], 1.0)},
  {newton_sql("m2", "pair", "y_true", ["in_a", "price_k", "balance_k", "prob"], 1.0)},
  steps as (select 0 step_no, 'raw (group only)' step, 1 n_features, dataset, b1, b1 raw_b from m0
    union all select 1, 'amounts', 3, m1.dataset, m1.b1, m0.b1 from m1 join m0 using (dataset)
    union all select 2, 'score', 4, m2.dataset, m2.b1, m0.b1 from m2 join m0 using (dataset))
  select dataset, step_no::int step_no, step, n_features::int n_features, b1 group_coef_logodds,
    100 * (raw_b - b1) / nullif(raw_b, 0) pct_of_raw_gap_explained, 'ok' status from steps"""


@query("case_mix_waterfall", CASE_MIX_SQL, "group_coef_logodds pct_of_raw_gap_explained")
def _(spark, d):
    return RG.case_mix_waterfall(two_segments(spark, d), "subgroup", A_ORD, B_ORD, BLOCKS, keys=["dataset"])


@query("error_waterfall_fn", error_sql("fn"), ERROR_DOUBLES)
def _(spark, d):
    """The score decides the prediction, so its block splits the errors: a status, no estimate."""
    return RG.error_waterfall(two_segments(spark, d), "subgroup", A_ORD, B_ORD, BLOCKS, "fn", keys=["dataset"])


@query("error_waterfall_fp", error_sql("fp"), ERROR_DOUBLES)
def _(spark, d):
    return RG.error_waterfall(two_segments(spark, d), "subgroup", A_ORD, B_ORD, BLOCKS, "fp", keys=["dataset"])


def interaction_sql() -> str:
    parts = []
    for m in ("price_k", "balance_k"):
        parts.append(f"e_{m} as (select *, miss err, {z_sql([m])} from pair where y_true = 1)")
        parts.append(newton_sql(f"i_{m}", f"e_{m}", "err", ["in_a", f"z_{m}", f"in_a * z_{m}"]))
    rows = " union all ".join(f"select '{m}' moderator, * from i_{m}" for m in ("price_k", "balance_k"))
    return f"""with recursive {PAIR}, {', '.join(parts)}, fits as ({rows}),
      head as (select dataset, count(*)::bigint n_obs, sum(miss)::bigint n_error,
        count(*) < 20 or sum(miss) < 5 or sum(in_a) < 5 few from pair where y_true = 1 group by dataset),
      rows_ as (select dataset, moderator, n_obs, n_error, few, case when not few then b1 end b1, case when not few then b2 end b2,
        case when not few then b3 end b3, case when not few then v3 end v3 from fits join head using (dataset))
      select dataset, moderator, case when few then 'nonestimable' else 'estimable' end status, b3 interaction_log_or, exp(b3) interaction_or,
        exp(b3 - {Z975!r}::double * sqrt(v3)) interaction_or_ci_low, exp(b3 + {Z975!r}::double * sqrt(v3)) interaction_or_ci_high,
        {normal_p_sql('b3 / sqrt(v3)')} interaction_p, exp(b1) group_or, exp(b2) moderator_or, n_obs, n_error,
        '' warning, '' error, case when few then 'insufficient sample size' else '' end note from rows_"""


@query("interaction_test", interaction_sql(), " ".join(RG.INTERACTION_VALUES))
def _(spark, d):
    return RG.interaction_test(
        two_segments(spark, d), "subgroup", A_ORD, B_ORD, ["price_k", "balance_k"], "fn", keys=["dataset"]
    )


def standardised_sql(kind: str) -> str:
    label, y = ("miss", 1) if kind == "fn" else ("alarm", 0)
    z = f"errs as (select *, {label} err, {z_sql(['price_k', 'balance_k'])} from pair where y_true = {y})"
    outcome = newton_sql("om", "errs", "err", ["in_a", "z_price_k", "z_balance_k"], 1.0)
    propensity = newton_sql("pm", "errs", "in_a", ["z_price_k", "z_balance_k"], 1.0)
    return f"""with recursive {PAIR}, {z}, {outcome}, {propensity},
      heads as (select dataset, count_if(in_a = 1)::bigint n_a, count_if(in_a = 0)::bigint n_b,
        avg(err) filter (in_a = 1) - avg(err) filter (in_a = 0) raw_gap from errs group by dataset),
      g as (select dataset, avg(1 / (1 + exp(-(b0 + b1 + b2 * z_price_k + b3 * z_balance_k)))
        - 1 / (1 + exp(-(b0 + b2 * z_price_k + b3 * z_balance_k)))) g_computation_gap from errs join om using (dataset) group by dataset),
      w as (select dataset, in_a, err, case when in_a = 1 then 1 / p else 1 / (1 - p) end w from (select dataset, in_a, err,
        least(greatest(1 / (1 + exp(-(b0 + b1 * z_price_k + b2 * z_balance_k))), 0.01), 0.99) p from errs join pm using (dataset)) q),
      i as (select dataset, sum(w * err) filter (in_a = 1) / sum(w) filter (in_a = 1)
        - sum(w * err) filter (in_a = 0) / sum(w) filter (in_a = 0) ipw_gap from w group by dataset)
      select dataset, '{kind}' error_type, raw_gap, {'g_computation_gap, 100 * (raw_gap - g_computation_gap) / nullif(raw_gap, 0) attenuation_pct' if kind == 'fn' else 'ipw_gap'},
        n_a, n_b, '' note from heads join g using (dataset) join i using (dataset)"""


@query("g_computation", standardised_sql("fn"), "raw_gap g_computation_gap attenuation_pct")
def _(spark, d):
    return RG.standardised_error_gap(
        two_segments(spark, d), "subgroup", A_ORD, B_ORD, ["price_k", "balance_k"], "fn", keys=["dataset"]
    ).select("dataset", "error_type", "raw_gap", "g_computation_gap", "attenuation_pct", "n_a", "n_b", "note")


@query("ipw_propensity", standardised_sql("fp"), "raw_gap ipw_gap")
def _(spark, d):
    return RG.standardised_error_gap(
        two_segments(spark, d), "subgroup", A_ORD, B_ORD, ["price_k", "balance_k"], "fp", keys=["dataset"]
    ).select("dataset", "error_type", "raw_gap", "ipw_gap", "n_a", "n_b", "note")


# --- models ------------------------------------------------------------------------------


@query("model_pool")
def _(spark, d):
    """Every family fitted on the training rows and scored on the test rows."""
    train, test = train_test(spark, d)
    pool = L.fit_pool(train, SPEC, settings=POOL)
    return M.discrimination(pool.all_models(test, ["y_true"]), ["family"])


FOLDED = f"""{ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    cl as (select cluster_id, row_number() over (order by md5('42|' || cluster_id), cluster_id) rn, count(*) over () g
      from (select distinct cluster_id from r) u),
    test as (select r.* from r join cl using (cluster_id) where rn <= ceil(0.3::double * g)),
    train as (select r.* from r join cl using (cluster_id) where rn > ceil(0.3::double * g)),
    cf as (select cluster_id, (ntile(5) over (partition by level order by md5('42|' || cluster_id), cluster_id) - 1)::int fold
      from (select cluster_id, least(sum(y_true), 2) as level from train group by 1) u),
    folded as (select train.*, fold, (status = 'O')::int o, (status = 'P')::int p from train join cf using (cluster_id))"""


LINEAR_TERMS = ("prob", "price", "balance", "o", "p")
FOLD_LINK = " + ".join(["b0", *[f"b{i} * (({t} - m_{t}) / s_{t})" for i, t in enumerate(LINEAR_TERMS, 1)]])


def fold_fits_sql() -> str:
    """CTEs ``st`` and ``lr``: every fold's moments and ridge regression over the other folds' rows."""
    stats = ", ".join(f"avg({t}) m_{t}, coalesce(nullif(stddev_pop({t}), 0), 1) s_{t}" for t in LINEAR_TERMS)
    z = ", ".join(f"({t} - m_{t}) / s_{t} z_{t}" for t in LINEAR_TERMS)
    return f"""with recursive {FOLDED}, parts as (select folded.* exclude (dataset), k dataset from folded, generate_series(0, 4) g(k) where k <> fold),
      st as (select dataset, {stats} from parts group by dataset),
      zs as (select dataset, y_true, {z} from parts join st using (dataset)),
      {newton_sql("lr", "zs", "y_true", [f"z_{t}" for t in LINEAR_TERMS], 1.0)}"""


CV_LINEAR_SQL = f"""{fold_fits_sql()},
    held as (select fold, y_true, 1 / (1 + exp(-({FOLD_LINK}))) prob from folded join lr on fold = lr.dataset join st on fold = st.dataset),
    n as (select fold, count(*)::bigint n from held group by fold)
    select fold, n, auroc from n join ({disc_sql('held', 'fold')}) x using (fold)"""


@query("cv_linear", CV_LINEAR_SQL, "auroc")
def _(spark, d):
    """Held-out rows and AUROC of each fold of the logistic family."""
    train, _test = folded_train(spark, d)
    scores = L.cross_validated_scores(train, SPEC, ("logistic_regression",), settings=POOL)
    counts = scores.groupBy("fold").agg(F.count("*").alias("n"))
    return counts.join(M.discrimination(scores, ["fold"]).select("fold", "auroc"), "fold").select(F.col("fold").cast("int").alias("fold"), "n", "auroc")


@query(
    "cv_coverage",
    f"""with {FOLDED}, f as (select unnest({list(L.FAMILIES)}) family)
    select family, fold, count(*)::bigint n_rows, count(distinct row_id)::bigint n_ids, 0::bigint n_unscored, true in_unit
    from folded, f group by all""",
)
def _(spark, d):
    """Every training row has one held-out score of every family, by the model of its own fold."""
    train, _test = folded_train(spark, d)
    small = L.PoolSettings(forest_trees=20, boosted_rounds=10, vote_trees=10, vote_rounds=10)
    scores = L.cross_validated_scores(train, SPEC, settings=small)
    return scores.groupBy("family", F.col("fold").cast("int").alias("fold")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("row_id").alias("n_ids"), F.count_if(F.col("prob").isNull()).alias("n_unscored"),
        (F.min("prob").between(0, 1) & F.max("prob").between(0, 1)).alias("in_unit"),
    )


@query("cv_auroc")
def _(spark, d):
    train, _test = folded_train(spark, d)
    return L.cv_auroc(L.cross_validated_scores(train, SPEC, settings=POOL))


@query(
    "select_best_model",
    f"""with {ORD}, s as (select dataset, subgroup family, auroc mean_auroc from ({disc_sql('ord', 'dataset, subgroup')}) x)
    select dataset, first(family order by mean_auroc desc, family) filter (mean_auroc > 0.5) selected_family,
    max(mean_auroc) filter (mean_auroc > 0.5) selected_score,
    count_if(not coalesce(mean_auroc > 0.5, false))::bigint n_ineligible from s group by dataset""",
    "selected_score",
)
def _(spark, d):
    """The selection rule on a table of candidate scores, one candidate per segment."""
    scores = M.discrimination(scored_orders(spark, d), ["dataset", "subgroup"]).select(
        "dataset", F.col("subgroup").alias("family"), F.col("auroc").alias("mean_auroc")
    )
    order = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return L.select_best(scores, ["dataset"], order=order)


def isotonic_sql(name: str, source: str) -> str:
    """CTE ``name``: (dataset, s, v) of the isotonic fit by the min-max formula, from (dataset, s, y) of ``source``."""
    return f"""{name}_c as (select *, sum(w) over (partition by dataset order by s) cw, sum(t) over (partition by dataset order by s) ct
        from (select dataset, s, count(*)::double w, sum(y)::double t from {source} group by dataset, s) q),
      {name}_p as (select a.dataset, a.s lo, b.s hi, (b.ct - a.ct + a.t) / (b.cw - a.cw + a.w) v
        from {name}_c a join {name}_c b on a.dataset = b.dataset and a.s <= b.s),
      {name} as (select dataset, hi s, max(m) v from (select dataset, lo, hi, min(v) over (partition by dataset, lo order by hi desc) m
        from {name}_p) q group by dataset, hi)"""


ENSEMBLE_SQL = f"""{fold_fits_sql()},
    hs as (select fold dataset, {FOLD_LINK} s, y_true y from folded join lr on fold = lr.dataset join st on fold = st.dataset),
    {isotonic_sql('iso', 'hs')},
    ts as (select lr.dataset, row_id, subgroup, y_true, {FOLD_LINK} s from (select * exclude (dataset), (status = 'O')::int o, (status = 'P')::int p from test) t, lr
      join st on lr.dataset = st.dataset),
    lo as (select ts.dataset, ts.row_id, iso.s s0, iso.v v0 from ts asof join iso on ts.dataset = iso.dataset and ts.s >= iso.s),
    hi as (select ts.dataset, ts.row_id, iso.s s1, iso.v w1 from ts asof join iso on ts.dataset = iso.dataset and ts.s <= iso.s)
    select row_id, subgroup, y_true, avg(case when s0 is null then w1 when s1 is null or s1 = s0 then v0 else v0 + (w1 - v0) * (s - s0) / (s1 - s0) end) prob_calibrated
    from ts left join lo using (dataset, row_id) left join hi using (dataset, row_id) group by row_id, subgroup, y_true"""


@query("isotonic_fold_ensemble", ENSEMBLE_SQL, "prob_calibrated")
def _(spark, d):
    """All folds' regressions from one iteration over the rows, all folds' isotonic maps from one job."""
    train, test = folded_train(spark, d)
    pool = L.fit_pool(train, SPEC, ("logistic_regression",), fold="fold", settings=POOL)
    scored = L.calibrated_scores(train, test, pool, ["subgroup", "y_true"])
    return scored.select("row_id", "subgroup", "y_true", F.col("prob").alias("prob_calibrated"))


def recalibrated_sql() -> str:
    """CTEs up to ``al``: (strategy, subgroup, r, y_true) of every test row."""
    units = lambda t: f"(select 'pooled' dataset, * from {t} union all select subgroup, * from {t})"
    platt = newton_sql("pl", "us", "y", ["x"], 1.0)
    x = "ln(least(greatest(prob, 1e-6::double), 1 - 1e-6::double) / (1 - least(greatest(prob, 1e-6::double), 1 - 1e-6::double)))"
    return f"""with recursive {FOLDED}, us as (select dataset, prob s, y_true y, {x} x from {units('train')} q),
      {isotonic_sql('iso', 'us')}, {platt},
      ts as (select dataset, subgroup, prob, y_true, row_id, {x} x from {units('test')} q),
      under as (select ts.dataset, row_id, max(s) s0, arg_max(v, s) w0 from ts join iso on ts.dataset = iso.dataset and s <= prob group by 1, 2),
      over_ as (select ts.dataset, row_id, min(s) s1, arg_min(v, s) w1 from ts join iso on ts.dataset = iso.dataset and s >= prob group by 1, 2),
      sc as (select ts.*, case when s0 is null then w1 when s1 is null or s1 = s0 then w0 else w0 + (w1 - w0) * (prob - s0) / (s1 - s0) end iso_p,
        1 / (1 + exp(-(b0 + b1 * x))) platt_p from ts left join under using (dataset, row_id) left join over_ using (dataset, row_id)
        join pl using (dataset)),
      al as (select 'uncalibrated' strategy, subgroup, prob r, y_true from sc where dataset = 'pooled'
        union all select case when dataset = 'pooled' then 'pooled_isotonic' else 'group_isotonic' end, subgroup, iso_p, y_true from sc
        union all select case when dataset = 'pooled' then 'pooled_platt' else 'group_platt' end, subgroup, platt_p, y_true from sc)"""


@query(
    "recalibrate",
    f"{recalibrated_sql()} select strategy, subgroup, count(*)::bigint n, avg(r) mean_score, avg(y_true) event_rate from al group by all",
    "mean_score event_rate",
)
def _(spark, d):
    train, test = train_test(spark, d)
    return L.recalibrate(train, test, "subgroup", A_ORD, B_ORD).groupBy("strategy", "subgroup").agg(
        F.count("*").alias("n"), F.avg("recalibrated").alias("mean_score"), F.avg("y_true").alias("event_rate")
    )


def gap_rows_sql(source: str, key: str) -> str:
    """Gap rows of the two segments by ``key``, from (key, subgroup, y_true, prob, pred)."""
    return f"""select * from (select {key}, {gap_row_sql()} from ({wide_sql(source, key, 'subgroup', A_ORD, B_ORD)}) ww) g
      join ({pooled_sql(source, key)}) p using ({key})"""


@query(
    "recalibration_table",
    f"""{recalibrated_sql()}, rc as (select strategy, subgroup, y_true, r prob, (r >= 0.5)::int pred from al where r is not null)
    {gap_rows_sql('rc', 'strategy')}""",
    GAP_ROW_NAMES + " " + POOLED,
    4,
)
def _(spark, d):
    train, test = train_test(spark, d)
    scored = L.recalibrate(train, test, "subgroup", A_ORD, B_ORD)
    return L.recalibration_table(scored, "subgroup", A_ORD, B_ORD)[1]


@query("batch_score")
def _(spark, d):
    """Model saved, loaded and applied to rows that carry predictors only."""
    train, test = train_test(spark, d)
    threshold = float(train.agg(F.avg("y_true")).first()[0])
    fitted = L.fit_family(train, SPEC, "logistic_regression", settings=POOL)
    folder = scratch_folder(spark, "model")
    L.save_fitted(fitted, folder)
    loaded = L.load_fitted(folder, fitted.family, 1, fitted.required)
    return L.batch_score(loaded, test.select("row_id", *SPEC.features), threshold, fitted.family).select(
        "row_id", "prob_calibrated", "y_pred_at_threshold", "operating_threshold", "selected_family"
    )


@query(
    "verify_scoring",
    f"""with {ORD}, r as (select * from ord where subgroup in ('{A_ORD}', '{B_ORD}')),
    cl as (select cluster_id, row_number() over (order by md5('42|' || cluster_id), cluster_id) rn, count(*) over () g
      from (select distinct cluster_id from r) u)
    select count(*)::bigint n_rows, 0.0::double max_abs_deviation, 0::bigint n_unmatched, true verified
    from r join cl using (cluster_id) where rn <= ceil(0.3::double * g)""",
    "max_abs_deviation",
)
def _(spark, d):
    train, test = train_test(spark, d)
    fitted = L.fit_family(train, SPEC, "shallow_tree", settings=POOL)
    folder = scratch_folder(spark, "model")
    L.save_fitted(fitted, folder)
    loaded = L.load_fitted(folder, fitted.family, 1, fitted.required)
    return L.verify_scoring(
        fitted.score(test, "prob_calibrated"), loaded.score(test, "prob_calibrated")
    )


NULL_MODELS_SQL = f"""with recursive {FOLDED}, tr as (select 'all' dataset, y_true, prob, price / 1000.0 price_k, balance / 1000.0 balance_k from train),
    {newton_sql('n1', 'tr', 'y_true', ['prob'], 1.0)}, {newton_sql('n2', 'tr', 'y_true', ['price_k', 'balance_k'], 1.0)},
    sc as (select 'intercept_only' model, subgroup, y_true, (select avg(y_true) from train) prob from test
      union all select 'single_feature', subgroup, y_true, 1 / (1 + exp(-(b0 + b1 * prob))) from test, n1
      union all select 'simple_baseline', subgroup, y_true, 1 / (1 + exp(-(b0 + b1 * (price / 1000.0) + b2 * (balance / 1000.0)))) from test, n2
      union all select 'random_score', subgroup, y_true, ('0x' || md5('42|' || row_id)[1:13])::bigint / 4503599627370496.0::double from test),
    sp as (select *, (prob >= 0.4::double)::int pred from sc) {gap_rows_sql('sp', 'model')}"""


@query("null_models", NULL_MODELS_SQL, GAP_ROW_NAMES + " " + POOLED, 4)
def _(spark, d):
    train, test = train_test(spark, d)
    return L.null_models(
        train, test, "subgroup", A_ORD, B_ORD, "prob", ["price_k", "balance_k"], threshold=0.4
    )


@query("family_robustness")
def _(spark, d):
    train, test = folded_train(spark, d)
    return L.family_robustness(
        train, test, SPEC, "subgroup", A_ORD, B_ORD, folds=5, settings=POOL, threshold=0.4
    )


@query("attribute_inclusion")
def _(spark, d):
    train, test = train_test(spark, d)
    return L.attribute_inclusion(
        train, test, ["prob", "price_k", "balance_k"], "subgroup", A_ORD, B_ORD, threshold=0.4
    )


@query("repeated_splits")
def _(spark, d):
    return L.repeated_splits(
        two_segments(spark, d), SPEC, "subgroup", A_ORD, B_ORD, SPLIT_SEEDS, folds=5, cluster="cluster_id",
        settings=POOL,
    )
