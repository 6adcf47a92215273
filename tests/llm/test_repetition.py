import re
from collections import Counter

from gapscope.llm.repetition import FIELDS, GRAM_LIMITS, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, own))
            seen.add(line)
    cover = {}
    for n in GRAM_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                inside.update(range(i, i + n))
        cover[n] = inside
    chars = sum(map(len, words))
    failed = len(words) < 10 or 100 * len(cover[5]) > 20 * len(words)
    inside = [sum(len(words[i]) for i in cover[n]) for n in GRAM_LIMITS]
    kept = not failed and dup_chars <= 0.2 * chars and all(c <= m * chars for c, m in zip(inside, GRAM_LIMITS.values()))
    return (doc_id, len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(cover[5]), failed, dup_chars, *inside, kept)


def same(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = sorted((tuple(r) for r in repetition(df).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)


def test_table_against_brute_force(spark):
    same(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_odd_texts(spark):
    long = " ".join(f"w{i % 4999}" for i in range(60000))
    same(spark, list(enumerate([
        None, "", " \n\t ", "a", "ñandú " * 12, "a b\na b\r\na b\n\nc\n c\nc", "\n".join(["one two three four"] * 5),
        long, "é" * 5, "x y z w v " * 2, "\n", "a\x0bb\x0cc d", "#*$%&|<> <a> | b",
    ])) + [(None, "a b"), (3, "a")])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repetition(df).columns == [f for f, _ in FIELDS] and repetition(df).count() == 0
