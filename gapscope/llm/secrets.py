"""Secret scanning with a random forest that removes false findings; DataFrame operations only.

A *candidate* is, in this order, a published key format wherever it stands, a value of 6 or more
characters assigned to a secret's name, or a run of 16 or more key characters with a digit in it; of
a run ``name=value`` only the value counts. Each is described by its length, its character classes and the changes between them, how much of it dictionary words cover
(the most frequent words of all texts), its path (slashes, separators, and the document's source)
and its neighbouring words. A random forest fitted on labelled findings, at most ``SAMPLE`` of them
chosen by hash within each label, decides which candidates are secrets. Published key formats are
secrets whatever the forest says, unless a reviewed label denies it.

Without a table of reviewed findings, ``distant_labels`` labels the clear cases: provider formats
and values assigned to a secret's name, in quotes or as ``NAME=value``, are secrets; plain numbers, identifiers in UUID form
and values made of dictionary words are not; all else stays unlabelled and is left to the forest.
If the labels hold one class only, or none, candidates follow their label, and unlabelled ones are
not secrets.

Null and empty texts have no candidates. Every document has a row; repeated rows have equal rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, register, row_keyed, table, written

VALUE = r"[A-Za-z0-9_+/=-]{16,}"
#: Published key formats.
FORMATS = r"(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"
PROVIDER = f"^{FORMATS}$"
KEY = f"(?<![A-Za-z0-9]){FORMATS}(?![A-Za-z0-9])"
NAME = r"(?i)(token|secret|passw|pwd|api_?key|access_?key|auth|credential|bearer)"
#: A secret's name as it stands before an assigned value, and the start of an assignment to it.
NAMED = r"(?i)(token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|auth(?!or)|credential|bearer)"
ASSIGNMENT = NAMED + r"[\w.\]-]*[\"'`]?[\x20\x09-\x0D]*(:=|=>|=|:)"
#: The assigned value: in quotes, or bare; within one word, or (after the name's word) as the word.
QUOTED, BARE = r"[\"'`]([^\"'`]{6,})[\"'`]", r"([^\"'`\s,;&()<>{}\[\]]{6,})"
WITHIN = NAMED + r"[\w.\]-]*[\"'`]?(?::=|=>|=|:)"
ALONE = r"^[(\[{]*"
#: A run that holds a name and its value.
PAIR = r"^[A-Za-z_][A-Za-z0-9_.-]*=+([^=].{15,})$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DICTIONARY = 4_096
SAMPLE = 20_000
TREES, DEPTH = 20, 8
SOURCES = 16
REPLACEMENT = "[SECRET]"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more: a bounded list."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,12}\b"), 0)).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(size)
    return [r["w"] for r in top.collect()]


def candidates(docs: DataFrame) -> DataFrame:
    """(_row, source, place, value, word, before, before2, after) of every candidate."""
    some = F.col("text").rlike(VALUE) | F.col("text").rlike(KEY) | F.col("text").rlike(ASSIGNMENT)
    texts = docs.where(some).select("_row", "source", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"))
    at = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    assigned_to = lambda i: at(i - 1).rlike("[=:]>?$") & F.concat_ws(" ", at(i - 2), at(i - 1)).rlike(ASSIGNMENT + "+>?$")
    hits = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: at(i).rlike(VALUE) | at(i).rlike(KEY) | at(i).rlike(WITHIN) | assigned_to(i),
    )
    context = F.transform(hits, lambda i: F.struct(
        i.alias("place"), F.get("w", i).alias("word"), F.get("w", i - 1).alias("before"),
        F.get("w", i - 2).alias("before2"), F.get("w", i + 1).alias("after"), assigned_to(i).alias("_to"),
    ))
    found = texts.select("_row", "source", F.explode(context).alias("c")).select("_row", "source", "c.*")
    keys = F.regexp_extract_all("word", F.lit(KEY), 1)
    rest = F.regexp_replace("word", KEY, " ")
    first = lambda pattern, group: F.regexp_extract("_rest", pattern, group)
    bare = lambda c: F.regexp_replace(c, r"[.:!?]+$", "")
    long_enough = lambda c: F.when((F.length(c) >= 6), c)
    digit = lambda c: F.when(c.rlike("[0-9]"), c)
    value = F.coalesce(
        long_enough(first(WITHIN + QUOTED, 2)),
        long_enough(bare(first(NAMED + r"[\w.\]-]*[\"'`]?=" + BARE, 2))),
        digit(long_enough(bare(first(WITHIN + BARE, 2)))),
        F.when(F.col("_to"), F.coalesce(
            long_enough(first(ALONE + QUOTED, 1)), digit(long_enough(bare(first(ALONE + BARE, 1)))),
        )),
    )
    runs = F.transform(
        F.filter(
            F.regexp_extract_all(F.when(F.col("_value").isNull(), F.col("_rest")).otherwise(F.replace("_rest", "_value", F.lit(" "))), F.lit(VALUE), 0),
            lambda v: v.rlike("[0-9]"),
        ),
        lambda v: F.when(v.rlike(PAIR), F.regexp_extract(v, PAIR, 1)).otherwise(v),
    )
    return (
        found.withColumns({"_keys": keys, "_rest": rest}).withColumn("_value", value)
        .withColumn("value", F.explode(F.concat("_keys", F.array_compact(F.array("_value")), runs)))
        .drop("_to", "_keys", "_rest", "_value")
    )


def described(found: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    """The candidates with their feature columns, and the names of those."""
    n = F.length("value").cast("double")
    kept = lambda pattern: F.length(F.regexp_replace("value", pattern, "")) / n
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.length(F.regexp_replace(shape, r"(.)\1*", "$1"))
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    parts = F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), 0)
    covered = F.aggregate(F.filter(parts, lambda p: F.array_contains(known, p)), F.lit(0), lambda s, p: s + F.length(p))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    ahead = F.expr("substring_index(word, value, 1)")
    behind = F.expr("substring(word, length(substring_index(word, value, 1)) + length(value) + 1)")
    columns: dict[str, Column] = {
        "length": n,
        "digits": kept("[^0-9]"), "uppers": kept("[^A-Z]"), "lowers": kept("[^a-z]"),
        "changes": (runs - 1) / n,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "hex": flag(F.col("value").rlike("^[0-9a-fA-F]+$")),
        "vowels": kept("[^aeiouAEIOU]"),
        "coverage": covered / n,
        "slashes": kept("[^/]"), "separators": kept("[^_=+-]"),
        "path": F.pmod(F.xxhash64("source"), F.lit(SOURCES)).cast("double"),
        "named": flag(F.coalesce(F.concat_ws(" ", "before2", "before", ahead), F.lit("")).rlike(NAME)),
        "assigned": flag(F.col("before").rlike("[=:]$") | ahead.rlike("[=:]>?\\W?$")),
        "pair": flag(ahead.rlike("=$")),
        "quoted": flag(ahead.rlike("[\"'`]$") & behind.rlike("^[\"'`]")),
        "before_length": size("before"), "after_length": size("after"),
        "before_letters": flag(F.col("before").rlike("^[\\p{L}]+\\W*$")), "after_letters": flag(F.col("after").rlike("^[\\p{L}]+\\W*$")),
    }
    return found.withColumns(columns), list(columns)


def distant_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1.0 secret, 0.0 not, null undecided."""
    secret = F.col("value").rlike(PROVIDER) | (
        (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("changes") > 0)
        & ((F.col("quoted") == 1) | ((F.col("pair") == 1) & F.col("value").rlike("[0-9]")))
    )
    other = F.col("value").rlike("^[0-9]+$") | F.col("value").rlike(UUID) | (F.col("coverage") > 0.5)
    return rows.withColumn("label", F.when(secret, 1.0).when(other, 0.0))


def drawn(rows: DataFrame, n: int, ones: int, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows, the first of each label by hash: half each, or what there is."""
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("_row", "place", "value"), F.lit(spread))
    quota = {1.0: min(ones, max(sample // 2, sample - (n - ones)))}
    quota[0.0] = min(n - ones, sample - quota[1.0])
    parts = []
    for label, most in quota.items():
        # Rows beyond this hash cannot be among the first, but for odds below 1e-15.
        cut = min(1.0, (most + 10 * most**0.5 + 40) / (ones if label else n - ones))
        part = rows.where((F.col("label") == label) & (draw < F.lit(int(spread * cut))))
        parts.append(part.orderBy(draw, "_row", "place", "value").limit(most))
    return parts[0].unionByName(parts[1])


def judged(rows: DataFrame, features: list[str], sample: int = SAMPLE) -> DataFrame:
    """``rows`` (with ``label``) plus probability and is_secret."""
    # A published format stands unless a reviewed label denies it.
    stands = F.col("value").rlike(PROVIDER) & (F.coalesce("label", F.lit(1.0)) == 1.0)
    by_label = rows.withColumn("probability", F.coalesce("label", F.lit(0.0))).withColumn("is_secret", (F.col("probability") > 0.5) | stands)
    counts = rows.where("label is not null").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = counts["n"] or 0, int(counts["ones"] or 0)
    if not n or not 0 < ones < n:
        return by_label
    chosen = written(drawn(rows, n, ones, sample), "findings")
    if chosen.select("label").distinct().count() < 2:
        return by_label
    assemble = VectorAssembler(inputCols=features, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=3, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c"
    )
    model = forest.fit(assemble.transform(chosen))
    scored = model.transform(assemble.transform(rows)).withColumn("probability", vector_to_array("_p")[1])
    return scored.drop("_features", "_p", "_r", "_c").withColumn("is_secret", (F.col("probability") > 0.5) | stands)


def findings(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per candidate of ``docs`` (unique ``_row``, text, source): the verdict and features.

    ``labels`` (value, label) replaces the distant labels by reviewed ones.
    """
    rows, features = described(candidates(docs), dictionary(docs))
    if labels is None:
        rows = distant_labels(rows)
    else:
        reviewed = labels.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label"))
        rows = rows.join(reviewed, "value", "left")
    return judged(written(rows, "candidates"), features)


def by_document(keyed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``keyed`` plus n_candidates, n_secrets, n_removed (false findings) and the secrets' values."""
    found = findings(keyed.select("_row", "text", "source"), labels)
    counts = found.groupBy("_row").agg(
        F.count("*").alias("n_candidates"), F.count_if("is_secret").alias("n_secrets"),
        F.collect_set(F.when(F.col("is_secret"), F.col("value"))).alias("_secrets"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keyed.join(counts, "_row", "left").select(
        *keyed.columns, zero("n_candidates"), zero("n_secrets"),
        (F.coalesce("n_candidates", F.lit(0)) - F.coalesce("n_secrets", F.lit(0))).cast("long").alias("n_removed"), "_secrets",
    )


def redacted(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced; n_chars follows the text."""
    longest_first = F.array_sort(
        F.coalesce("_secrets", F.array().cast("array<string>")),
        lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    clean = F.aggregate(longest_first, F.col("text"), lambda t, s: F.replace(t, s, F.lit(REPLACEMENT)))
    out = by_document(row_keyed(docs), labels).withColumn("text", F.when(F.col("n_secrets") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@register("op2_secret_scan_forest")
def op2(spark, sf_dir):
    docs = row_keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return by_document(docs).select("doc_id", "n_candidates", "n_secrets", "n_removed")
