import hashlib
import re

import numpy as np
import pytest

from gapscope.llm import fill_middle as fm

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\t \x0b", "a", " a", "a ", "one two\n three ", "é ñ 😀 한 ", "<P> in it", "x <S>", "a<M>b", "< P> <S < S>", "<" * 9 + " <S <P <",
    "　x　 y", "w" * 70_000, "a b " * 40_000, ("\x00" * 3 + " ") * 5, "tail  \x85 ",
]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = TOKEN.findall(text)
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_texts_against_brute_force(spark):
    rows = [(i * 40 + k, t) for i, t in enumerate(ODD) for k in range(12)] + [(3, "a b"), (3, "a b"), (None, "c d e"), (None, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, form string")
    got = fm.fill_in_middle(df).withColumn("back", fm.restored(fm.F.col("output"), fm.F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(d), t or "") for d, t in rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(t or "")) for b, (_, t) in zip([brute(*r) for r in docs], docs)]
    assert sorted(map(tuple, fm.op13(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_seed_and_shares(spark):
    df = spark.createDataFrame([(i, "a b c d e f") for i in range(400)], "doc_id int, text string")
    assert {r.form for r in fm.fill_in_middle(df, share=0).collect()} == {"plain"}
    assert {r.form for r in fm.fill_in_middle(df, share=100, spm_share=0).collect()} == {"psm"}
    assert fm.fill_in_middle(df, seed=7).collect() != fm.fill_in_middle(df).collect()


@pytest.mark.parametrize("kind, step, count", [(fm.ARRAY, 17, 3000), (fm.BITMAP, 3, 20_000), (fm.RUNS, 1, 60_000)])
def test_each_container_selects(kind, step, count):
    low = np.arange(count) * step + 5
    c = fm.container(low)
    assert c.kind == kind and c.nbytes <= 8192
    assert (c.select(np.arange(count)) == low).all()


def test_boundary_set_selects_across_containers():
    rnd = np.random.default_rng(2)
    places = np.unique(np.concatenate((
        rnd.integers(0, 70_000, 900), np.arange(131_072, 150_000), 196_608 + rnd.integers(0, 65_536, 30_000), [10_000_000, 10_000_001],
    )))
    found = fm.BoundarySet(places)
    assert {c.kind for c in found.containers} == {fm.ARRAY, fm.BITMAP, fm.RUNS} and len(found) == len(places)
    ranks = rnd.permutation(len(places))
    assert (found.select(ranks) == places[ranks]).all()
    assert len(fm.BoundarySet(places[:0])) == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = fm.fill_in_middle(df)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and found.count() == 0
