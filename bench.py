"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from gapscope.plans.catalog import QUERIES
from gapscope.session import local_session

HEADLINE = (
    "group_counts", "threshold_metrics", "overall_and_subgroup", "auroc", "roc_points",
    "calibration_curve", "risk_decile_table", "score_distribution", "rank_separation", "gap_row",
    "prevalence_adjusted_gap", "shapley_gap", "threshold_sweep", "find_threshold_for_metric",
    "equal_sensitivity_threshold", "threshold_policies", "pareto_grid", "split_stratified",
    "split_grouped", "kfold_stratified_group", "fit_medians", "transform_impute_onehot",
    "dense_cluster_token", "meta_random_effects", "bh_fdr", "run_diff", "bootstrap_gap",
    "bootstrap_auroc", "cluster_vs_naive", "permutation_group", "calibration_fit",
    "case_mix_waterfall", "error_waterfall_fn", "recalibrate", "balanced_training", "model_pool",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(os.path.join(folder, "lineitem.parquet")).selectExpr(
        "count_if(l_quantity > 0)"
    ).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
