"""The corpus pipeline: stages over ``documents``, each written as a table and read by the next.

Every stage works on all rows its predecessor kept, and all but the last return the columns of
``documents``. Language identification drops what has no letter or no language of probability 0.5;
the Jaccard join keeps the row of the smallest doc_id of each near-duplicate group; the secret scan
replaces secrets in the texts; mixing repeats or thins documents to the sources' target weights; the
last stage packs the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm import crf, mixing, ngram_join, packing, secrets
from gapscope.llm.catalog import QUERIES as _OPERATORS
from gapscope.llm.catalog import SQL  # noqa: F401
from gapscope.llm.common import row_keyed, written

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language, which becomes their ``lang`` where it was null."""
    columns = docs.columns
    labelled = crf.identified(docs.withColumnRenamed("lang", "_lang"), docs)
    kept = labelled.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}")
    return kept.withColumn("lang", F.coalesce("_lang", "lang_pred")).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest doc_id (of equal ids, the first row)."""
    keyed = row_keyed(docs)
    groups = ngram_join.near_groups(keyed.select("_row", "text"))
    marked = keyed.select("_row", "doc_id").join(groups.select("_row", "root"), "_row")
    first = marked.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    kept = first.select("first._row").unionByName(marked.where("root is null").select("_row"))
    return keyed.join(kept, "_row", "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secrets.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources at their target weights."""
    return mixing.mixed_texts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack(packing.pieces(docs, packing.VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixed_sources", mixed_sources),
    ("best_fit_packing", best_fit_packing),
]
#: A random field, a random forest and a tokenizer are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {**_OPERATORS, "pipeline": run}
