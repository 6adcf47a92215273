"""Table readers; column pruning and filters are left to Catalyst."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Header CSV under a declared schema (no inference pass over the data)."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def wanted_if_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def exactly(df: DataFrame, wanted: list[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*wanted)


def merge_components(base: DataFrame, modules: list[DataFrame], key: str) -> DataFrame:
    """Left-join one-row-per-key modules onto a base table."""
    return reduce(lambda left, right: left.join(right, key, "left"), modules, base)


def union_files(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All files matching a glob as one table."""
    return spark.read.csv(pattern, schema=schema, header=True)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Provenance records of the analysis kind from JSON lines."""
    return spark.read.schema(schema).json(path).where("record_type = 'pipeline_analysis'")
