"""Writers. Spark's file committer makes each table write atomic."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite_or_null


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def strict_json(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row; non-finite numbers become null."""

    def clean(column, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite_or_null(column)
        if isinstance(kind, T.StructType):
            inner = F.struct(
                *[clean(column[f.name], f.dataType).alias(f.name) for f in kind.fields]
            )
            return F.when(column.isNotNull(), inner)
        if isinstance(kind, T.MapType):
            return F.transform_values(column, lambda _k, v: clean(v, kind.valueType))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda v: clean(v, kind.elementType))
        return column

    fields = [clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name)
    )


def append_provenance(records: DataFrame, path: str) -> str:
    """Append one strict-JSON line per comparison."""
    strict_json(records, "value").write.mode("append").text(path)
    return path


def completeness(parts: dict[str, DataFrame], expected: dict[str, int]) -> dict[str, tuple]:
    """Components whose row count is not the expected one, as (expected, found)."""
    found = {}
    for name, df in parts.items():
        found[name] = df.count()
    names = sorted(set(found) | set(expected))
    return {
        n: (expected.get(n), found.get(n)) for n in names if expected.get(n) != found.get(n)
    }


def write_all_or_nothing(
    parts: dict[str, DataFrame], expected: dict[str, int], folder: str
) -> list[str]:
    """Write every component, but only after all of them proved complete.

    Components are cached while counted, so the rows written are the rows that
    were checked.
    """
    kept = {n: df.persist() for n, df in parts.items()}
    try:
        wrong = completeness(kept, expected)
        if wrong:
            raise RuntimeError(f"incomplete components, nothing written: {wrong}")
        return [write_table(df, os.path.join(folder, n)) for n, df in kept.items()]
    finally:
        for df in kept.values():
            df.unpersist()
