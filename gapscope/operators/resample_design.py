"""Description of the resampling scheme of a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the two resampling designs.
CLUSTER_UNIT, CLUSTER_DESIGN = "patient_cluster", "joint_patient_cluster_whole_test_set"
ROW_UNIT, ROW_DESIGN = "observation", "row_level_within_subgroup_resampling"


def bootstrap_design(
    df: DataFrame, keys: list[str], group: str, cluster: str | None = None
) -> DataFrame:
    """Resampling unit, number of units and rows, and clusters found in both groups."""
    if cluster is None:
        return df.groupBy(*keys).agg(
            F.lit(ROW_UNIT).alias("resampling_unit"), F.lit(ROW_DESIGN).alias("resampling_design"),
            F.count("*").alias("n_resampling_units"), F.count("*").alias("n_observations"),
            F.lit(0).cast("bigint").alias("n_units_spanning_subgroups"),
        )
    units = df.groupBy(*keys, cluster).agg(
        F.count("*").alias("_n"), (F.min(group) != F.max(group)).alias("_spans")
    )
    return units.groupBy(*keys).agg(
        F.lit(CLUSTER_UNIT).alias("resampling_unit"),
        F.lit(CLUSTER_DESIGN).alias("resampling_design"),
        F.count("*").alias("n_resampling_units"),
        F.sum("_n").cast("bigint").alias("n_observations"),
        F.count_if(F.col("_spans")).alias("n_units_spanning_subgroups"),
    )
