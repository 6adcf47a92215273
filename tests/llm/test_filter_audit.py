import re
from collections import Counter

import pytest

from gapscope.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, mask string, part string"


def failed(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = WORD.findall(text)
    copy = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
    checks = (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), copy,
    )
    return {f for f, bad in zip("ABCDE", checks) if bad}


def brute(rows, labels):
    out = Counter()
    fails = [failed(rows, i) for i in range(len(rows))]
    for (doc_id, _, source), bad in zip(rows, fails):
        good = doc_id is not None and any(d == doc_id and q == 1 for d, q, _ in labels)
        toxic = doc_id is not None and any(d == doc_id and x == 1 for d, _, x in labels)
        for order in fa.ORDERS:
            for k, name in enumerate(order):
                gone, fail = bad & set(order[:k]), name in bad
                here = fail and not gone
                key = (source or "", order, k + 1)
                for measure, value in (
                    ("kept", not bad & set(order[: k + 1])), ("removed", here), ("redundant", fail and bool(gone)),
                    ("unique_fails", bad == {name}), ("good_lost", here and good), ("toxic_lost", here and toxic),
                ):
                    out[(*key, measure)] += value
                out[(source or "", name, "shapley")] += here
    parts = {s or "" for _, _, s in rows}
    return sorted(
        (p, o, k + 1, *[out[(p, o, k + 1, m)] for m in fa.MEASURES], out[(p, o[k], "shapley")])
        for p in parts for o in fa.ORDERS for k in range(5)
    )


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "m", "p") for r in rows], SCHEMA)
    return sorted(map(tuple, fa.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert sorted(map(tuple, fa.op12(spark, "/root/testdata/sf0.001").collect())) == brute([tuple(r) for r in docs], labels)


def test_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (2, many, "a"), (None, many, "a"), (None, many, None), (0, many + " #", ""),
        (5, None, "a"), (6, "", "a"), (4, None, None), (7, "A B", "c"), (8, "é" * 20 + "A", "c"), (9, "é" * 18 + "A", "c"),
        (10, "x y " * 60, "a"), (11, "X Y " * 60, "a"), (11, "X Y " * 60, "a"), (12, many.replace(" ", "\x0b\x1c "), "a"), (-3, "A B", "c"),
        (13, " ".join(f"w{i % 39}" for i in range(60)), "d"), (14, " ".join(f"w{i % 38}" for i in range(60)), "d"),
    ]
    labels = [(2, 1, 0), (2, 0, 1), (7, None, 1), (None, 1, 1), (11, 1, None), (99, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_one_text_for_all_rows(spark):
    rows = [(i, "same text", f"s{i % 3}") for i in range(3000)]
    got = {r[0]: r for r in run(spark, rows, []) if r[1] == "EABCD" and r[2] == 1}
    assert [got[f"s{i}"][4] for i in range(3)] == [999, 1000, 1000]


def test_fields_of_large_counts_do_not_run_over():
    counts = {m: (1 << 52) + m * 12_345_678_901 for m in range(128)}
    total = fa.unpacked(sum(n * fa.packed(m) for m, n in counts.items()))
    want = sum(n * fa.step_outcomes(m).astype(object) for m, n in counts.items())
    assert (total.astype(object) == want).all()


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_keep_words_whole(size):
    raw = ("one two\n\nthree " * 9 + "é" * 50 + "\x0b end").encode()
    parts = list(fa.slices(raw, size))
    assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def test_long_text_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(fa, "SLICE", 100)
    raw = " ".join(f"w{i % 700}" for i in range(1000)).encode()
    assert fa.own_mask(raw) == 0 and fa.own_mask(raw + b" w1" * 200) == 2


def test_empty_tables(spark):
    assert run(spark, [], []) == [] and run(spark, [], [(1, 1, 1)]) == []
    assert len(run(spark, [(1, "a", "s")], [])) == 600
