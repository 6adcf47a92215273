"""Preprocessing learned from training rows: medians, categories, design matrix.

Folds are ordinary key columns, so the states of all folds come from one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import null_safe_join, sized_broadcast
from .ranking import exact_quantiles



@dataclass(frozen=True)
class Categorical:
    """A categorical source column expanded to indicators at its declared place."""

    source: str
    prefix: str | None = None
    drop_first: bool = True

    @property
    def stem(self) -> str:
        return self.prefix or self.source


@dataclass(frozen=True)
class DesignSpec:
    """Declared feature order; names of categorical sources are expansion points."""

    features: list[str]
    categorical: list[Categorical] = field(default_factory=list)

    def __post_init__(self):
        unplaced = {c.source for c in self.categorical} - set(self.features)
        if unplaced:
            raise ValueError(f"categorical sources without a declared position: {sorted(unplaced)}")

    @property
    def numeric(self) -> list[str]:
        sources = {c.source for c in self.categorical}
        return [f for f in self.features if f not in sources]


def training_folds(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Repeat each row for the folds whose training half contains it."""
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array(F.col(fold).cast("int")))
    return df.withColumn("train_fold", F.explode(others))


def fit_medians(train: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Exact median of every numeric column; a column without values gets 0.0."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("value"))
                for c in columns
            ]
        )
    )
    long = train.select(*keys, cells.alias("_c")).select(*keys, "_c.*")
    seen = long.groupBy(*keys, "column").agg(
        F.count_if(F.col("value").isNull()).cast("bigint").alias("n_missing")
    )
    medians = exact_quantiles(long, [*keys, "column"], "value", {"median": 0.5})
    joined = null_safe_join(seen, medians, [*keys, "column"], "left")
    return joined.select(
        *keys, "column", "n_missing",
        F.col("median").isNull().alias("zero_filled"),
        F.coalesce(F.col("median"), F.lit(0.0)).alias("median"),
    )


def fit_categories(train: DataFrame, keys: list[str], spec: list[Categorical]) -> DataFrame:
    """Observed training levels in text order; the first is the reference if dropped."""
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c.source).alias("source"),
                    F.col(c.source).cast("string").alias("category"),
                    F.lit(c.drop_first).alias("_drop"),
                    F.lit(c.stem).alias("_stem"),
                )
                for c in spec
            ]
        )
    )
    levels = (
        train.select(*keys, cells.alias("_c")).select(*keys, "_c.*")
        .where(F.col("category").isNotNull()).distinct()
    )
    order = Window.partitionBy(*keys, "source").orderBy("category")
    placed = levels.withColumn("position", F.row_number().over(order))
    reference = F.col("_drop") & (F.col("position") == 1)
    return placed.select(
        *keys, "source", "category", F.col("position").cast("int").alias("position"),
        reference.alias("is_reference"),
        F.when(~reference, F.concat_ws("_", "_stem", "category")).alias("indicator"),
    )


def level_lists(categories: DataFrame, spec: DesignSpec, part: str | None = None) -> dict:
    """Levels per source on the driver, where they name the columns of the design.

    With ``part`` the result is one such table per value of that key column. Without it, keys whose
    levels differ have no common columns (nor reference), which is an error; :func:`sparse_design`
    gives every key its own.
    """
    columns = ["source", "category", "position"] + ([part] if part else [])
    rows = categories.select(*columns).distinct().collect()
    rows.sort(key=lambda r: r["position"])
    out = {}
    for v in {r[part] for r in rows} if part else {None}:
        found = {c.source: [] for c in spec.categorical}
        places: dict = {}
        for r in rows:
            if part is None or r[part] == v:
                if places.setdefault((r["source"], r["position"]), r["category"]) != r["category"]:
                    raise ValueError(f"the keys' levels of {r['source']} differ; use sparse_design")
                found[r["source"]].append(r["category"])
        empty = [s for s, levels in found.items() if not levels]
        if empty:
            raise ValueError(f"no category observed in training rows for {empty}")
        out[v] = found
    return out if part else out[None]


def design_columns(spec: DesignSpec, levels: dict[str, list[str]]) -> list[str]:
    by_source = {c.source: c for c in spec.categorical}
    out = []
    for f in spec.features:
        if f in by_source:
            c = by_source[f]
            kept = levels[f][1:] if c.drop_first else levels[f]
            out += [f"{c.stem}_{v}" for v in kept]
        else:
            out.append(f)
    return out


def expand_blocks(
    blocks: dict[str, list[str]], spec: DesignSpec, levels: dict[str, list[str]]
) -> dict[str, list[str]]:
    """Replace categorical sources inside covariate blocks by their indicators."""
    by_source = {c.source: c for c in spec.categorical}
    out = {}
    for name, columns in blocks.items():
        expanded = []
        for col in columns:
            expanded += (
                design_columns(DesignSpec([col], [by_source[col]]), levels)
                if col in by_source
                else [col]
            )
        out[name] = expanded
    return out


def cumulative_blocks(blocks: DataFrame, order: str, columns: str = "columns") -> DataFrame:
    """Feature set of every step as covariate blocks accumulate (one row per block)."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("cumulative", F.flatten(F.collect_list(columns).over(upto)))


def apply_design(
    df: DataFrame, keys: list[str], spec: DesignSpec, medians: DataFrame,
    levels: dict[str, list[str]], carry: list[str],
) -> DataFrame:
    """Impute with the learned medians and expand indicators in the declared order.

    A missing category has all indicators zero. Medians arrive as one row per
    key, broadcast only after their number was counted.
    """
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_m_{c}") for c in spec.numeric]
    )
    joined = null_safe_join(df, sized_broadcast(wide), keys)
    by_source = {c.source: c for c in spec.categorical}
    columns = []
    for f in spec.features:
        if f in by_source:
            c = by_source[f]
            for v in levels[f][1:] if c.drop_first else levels[f]:
                hit = F.coalesce(F.col(f).cast("string") == F.lit(v), F.lit(False))
                columns.append(hit.cast("double").alias(f"{c.stem}_{v}"))
        else:
            columns.append(F.coalesce(F.col(f).try_cast("double"), F.col(f"_m_{f}")).alias(f))
    return joined.select(*carry, *columns)


def column_layout(
    medians: DataFrame, categories: DataFrame, keys: list[str], spec: DesignSpec
) -> tuple[DataFrame, DataFrame]:
    """Every key's own columns: the features' places, and the places of the levels.

    The first table has (keys, feature, width, offset): a number takes one column, a categorical
    source one for each of the key's levels but the reference. The second has (keys, source,
    category, column_no, indicator), without references. Both come from grouped jobs; neither
    levels nor keys reach the driver.
    """
    order = F.create_map(*[F.lit(x) for i, f in enumerate(spec.features) for x in (f, i)])
    numbers = medians.select(*keys, F.col("column").alias("feature"), F.lit(1).alias("width"))
    levels = categories.groupBy(*keys, F.col("source").alias("feature")).agg(F.count_if(~F.col("is_reference")).cast("int").alias("width"))
    upto = Window.partitionBy(*keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    layout = numbers.unionByName(levels).withColumn("_no", order[F.col("feature")]).where("_no is not null").withColumn(
        "offset", F.coalesce(F.sum("width").over(upto), F.lit(0)).cast("int")
    ).drop("_no")
    placed = null_safe_join(
        categories.where("not is_reference"), layout.select(*keys, F.col("feature").alias("source"), "offset"), [*keys, "source"]
    )
    inside = Window.partitionBy(*keys, "source").orderBy("position")
    return layout, placed.select(
        *keys, "source", "category", (F.col("offset") + F.row_number().over(inside) - 1).alias("column_no"), "indicator"
    )


def sparse_design(
    df: DataFrame, keys: list[str], spec: DesignSpec, medians: DataFrame, categories: DataFrame, carry: list[str]
) -> DataFrame:
    """carry, size, indices, values: each row's design vector over the columns of its own key.

    Missing numbers get the key's median; a missing level, the reference and a level unseen in
    training set no indicator. Levels are joined, so their number is not bounded; the join is a
    broadcast only after the levels were counted.
    """
    layout, levels = column_layout(medians, categories, keys, spec)
    wide = layout.groupBy(*keys).agg(
        F.sum("width").cast("int").alias("size"), *[F.max(F.when(F.col("feature") == f, F.col("offset"))).alias(f"_o_{f}") for f in spec.numeric]
    )
    fill = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"_m_{c}") for c in spec.numeric], F.lit(True).alias("_known")
    )
    rows = null_safe_join(df, sized_broadcast(null_safe_join(wide, fill, keys, "left")), keys)
    for c in spec.categorical:
        own = levels.where(F.col("source") == c.source).select(*keys, F.col("category").alias(f"_v_{c.source}"), F.col("column_no").alias(f"_o_{c.source}"))
        rows = null_safe_join(rows.withColumn(f"_v_{c.source}", F.col(c.source).cast("string")), sized_broadcast(own), [*keys, f"_v_{c.source}"], "left")
    number = lambda f: F.coalesce(F.col(f).try_cast("double"), F.col(f"_m_{f}"))
    cells = F.array_compact(F.array(*[
        F.when(F.col(f"_o_{f}").isNotNull(), F.struct(F.col(f"_o_{f}").alias("i"), (number(f) if f in spec.numeric else F.lit(1.0)).alias("v")))
        for f in spec.features
    ]))
    return rows.withColumn("_c", cells).select(
        *carry, "size", F.transform("_c", lambda c: c["i"]).alias("indices"), F.transform("_c", lambda c: c["v"]).alias("values")
    )


def expand_blocks_by_key(
    blocks: dict[str, list[str]], medians: DataFrame, categories: DataFrame, keys: list[str]
) -> DataFrame:
    """(keys, block, column): covariate blocks with each key's own indicators for categorical sources."""
    named = [(b, c) for b, columns in blocks.items() for c in columns]
    asked = medians.sparkSession.createDataFrame(named, "block string, feature string")
    numbers = medians.select(*keys, F.col("column").alias("feature"), F.col("column"))
    levels = categories.where("not is_reference").select(*keys, F.col("source").alias("feature"), F.col("indicator").alias("column"))
    return numbers.unionByName(levels).join(F.broadcast(asked), "feature").select(*keys, "block", "column")


def unseen_categories(
    df: DataFrame, keys: list[str], spec: list[Categorical], categories: DataFrame
) -> DataFrame:
    """Levels that training never saw, with their row counts."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c.source).alias("source"), F.col(c.source).cast("string").alias("category"))
                for c in spec
            ]
        )
    )
    seen = (
        df.select(*keys, cells.alias("_c")).select(*keys, "_c.*")
        .where(F.col("category").isNotNull())
        .groupBy(*keys, "source", "category").agg(F.count("*").alias("n_rows"))
    )
    known = categories.select(*keys, "source", "category")
    return null_safe_join(seen, known, [*keys, "source", "category"], "left_anti")


def learned_state(
    medians: DataFrame, categories: DataFrame, keys: list[str]
) -> DataFrame:
    """The learned medians and levels as one JSON record per key."""
    m = medians.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "median"))))).alias(
            "training_medians"
        ),
        F.sort_array(
            F.collect_list(F.when(F.col("n_missing") > 0, F.col("column")))
        ).alias("imputed_columns"),
        F.sort_array(F.collect_list(F.when(F.col("zero_filled"), F.col("column")))).alias(
            "zero_filled_columns"
        ),
    )
    c = categories.groupBy(*keys).agg(
        F.to_json(
            F.sort_array(F.collect_list(F.struct("source", "position", "category", "is_reference")))
        ).alias("training_categories")
    )
    return null_safe_join(m, c, keys, "left")


def blinded(
    features: list[str], blocks: dict[str, list[str]], spec: DesignSpec, attribute: str
) -> tuple[list[str], dict[str, list[str]], DesignSpec]:
    """Remove a protected attribute and its indicators from every place it could enter."""
    low = attribute.lower()
    hidden = lambda c: c.lower() == low or c.lower().startswith(f"{low}_")
    kept = [f for f in features if not hidden(f)]
    return (
        kept,
        {k: [c for c in v if not hidden(c)] for k, v in blocks.items()},
        DesignSpec(kept, [c for c in spec.categorical if not hidden(c.source)]),
    )
