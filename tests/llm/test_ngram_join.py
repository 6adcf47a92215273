import re

import pytest

from gapscope.llm import ngram_join
from gapscope.llm.ngram_join import near_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min(groups.get(find(i), [d]), default=d)) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_components(df).select("doc_id", "n_shingles", "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edges_of_the_threshold_and_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(104))
    near = [base.replace(f"w{i} ", f"X{i} ") for i in (3, 11, 19, 27)]
    chain = [" ".join(f"w{i}" for i in range(k, k + 104)) for k in range(0, 60, 6)]
    rows = list(enumerate([base, base.upper(), *near, *chain, "a b c", "A  B\tc", "a b", "", None, "   ", "a b c d e", "a b c d e f"]))
    rows += [(5, base), (5, base), (None, "a b"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_hot_list_of_unlinked_documents(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, shared + " " + " ".join(f"d{i}x{j}" for j in range(25))) for i in range(60)]
    rows += [(100 + i, shared + f" tail{i}") for i in range(30)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_documents_without_a_partner_leave_before_their_sets_are_made(spark, monkeypatch):
    held = []
    whole = ngram_join.class_sets

    def seen(docs, n):
        held.extend(r["class"] for r in docs.select("class").collect())
        return whole(docs, n)

    monkeypatch.setattr(ngram_join, "class_sets", seen)
    monkeypatch.setattr(ngram_join, "SENT_ROWS", 3)  # the first texts are shuffled, the last not
    shared = " ".join(f"s{i}" for i in range(400))
    rows = [(i, shared + " " + " ".join(f"d{i}x{j}" for j in range(270))) for i in range(12)]
    rows += [(100 + i, " ".join(f"c{j}" for j in range(200)) + f" tail{i}") for i in range(3)]
    rows += [(200, "e f g h i j"), (201, "e f g h i j")]
    assert run(spark, rows) == brute(rows)
    assert sorted(held) == [100, 101, 102]
