"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A word is a maximal run of characters other than these blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return wrap


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    context = spark.sparkContext
    base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:///tmp/spark-checkpoints-{context.applicationId}"
        context.setCheckpointDir(base)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage is cut and executors may be lost."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """What is written inside reaches Python in batches of about ``size`` bytes, however long its texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def released(spark: SparkSession) -> None:
    """Have the files of exchanges that no live plan refers to removed now.

    Spark removes them when the driver's JVM collects the finished plans, which on a driver with
    memory to spare may be long after; a job of many stages would keep all its shuffles on disk.
    """
    spark.sparkContext._jvm.System.gc()


def fold(key: str = "doc_id", parts: int = 5):
    """crc32 of the key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % parts


def row_keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with a unique long ``_row``.

    The key itself where it is unique and never null; else the table is written once with running
    row numbers, so that every later scan sees the same numbers.
    """
    seen = (
        docs.groupBy(key).count()
        .agg(F.max("count").alias("most"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    )
    if (seen["most"] or 0) <= 1 and not seen["nulls"] and dict(docs.dtypes)[key] in ("bigint", "int"):
        return docs.withColumn("_row", F.col(key).cast("long"))
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _directions(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node with an edge.

    Alternating large-star and small-star steps: an edge list never grows, a step is one grouped
    minimum and one join, and each round is checkpointed. Ends when a round changes nothing.
    """
    current = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    print_of = lambda df: tuple(
        df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
    last = print_of(current)
    while last[0]:
        both = _directions(current)
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        )
        current = written(small, "edges")
        now = print_of(current)
        if now == last:
            break
        last = now
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
