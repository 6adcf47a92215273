"""Session helpers for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", app: str = "gapscope") -> SparkSession:
    """A local session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("GAPSCOPE_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a scratch one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables, on the shared storage when one is named."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def sized_broadcast(table: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a summary table only after counting it.

    The table is cached and counted; above ``max_rows`` the cached table is
    returned without a hint, so the join falls back to a shuffle.
    """
    kept = table.persist()
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def null_safe_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Equi-join whose keys may be null; the right-hand key columns are dropped."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = None
    for c in on:
        term = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{c}" for c in on])
