import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gapscope.llm import bpe, packing
from gapscope.llm.bpe import vocabulary_path

HARD = [
    None, "", " ", "it's don't we'll I'D 'stop  'sx ''s !'s a's'll\n\n x\n y \t z  ", "'", "x're'rex'lll'dd", "\n\n", "é 😀 ½ ٣12 <|endoftext|>",
    "a　b  c", "the cat " * 900, "?'re don't'", "x  \n", "w" * 5000,
]


def check(rows, got):
    tok = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = []
    for d, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(w[3] for w in want)
    return len(bins), -(-total // 1024)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, length string")
    return packing.pack(packing.pieces(df, packing.VOCABULARY), **options).collect()


def test_odd_texts(spark):
    rows = list(enumerate(HARD)) + [(3, "a b"), (3, "a b"), (None, "c")]
    check(rows, run(spark, rows))


@pytest.mark.parametrize("options", [{}, {"leaf": 60, "fan": 3}])
def test_table_packs_tightly(spark, options):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(rows, run(spark, rows, **options))
    assert used <= 1.03 * least + 1


def test_empty_table(spark):
    assert run(spark, []) == []


def test_best_fit_takes_the_tightest_bin():
    assert list(packing.best_fit(np.array([600, 500, 400, 500, 24]), 1024)) == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("low, high, share", [(513, 1003, 1.0), (1, 1024, 1.03)])
def test_no_node_exceeds_its_leaf(spark, monkeypatch, low, high, share):
    lengths = [int(n) for n in np.random.default_rng(7).integers(low, high + 1, 4000)]
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(8)
    got = packing.pack(asked, leaf=200, fan=3).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths)
    bins, nodes = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        nodes[r["sequence_id"] >> 24] = nodes.get(r["sequence_id"] >> 24, 0) + 1
    assert all(a + n == b for parts in bins.values() for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert max(nodes.values()) <= 300
    assert len(bins) <= share * (len(lengths) if low > 512 else -(-sum(lengths) // 1024)) + 12


def test_long_texts_come_in_small_batches(spark):
    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (b.nbytes, 1)], names=["nbytes", "length"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 2000) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = packing.pack(texts.mapInArrow(seen, "nbytes long, length long")).collect()
    assert sum(r["nbytes"] for r in got) > 30_000_000
    assert max(r["nbytes"] for r in got) < 6_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_the_memory_of_pieces_is_bounded():
    encode = bpe.encoder(packing.VOCABULARY)
    bpe.classes()
    words = np.random.default_rng(3).integers(97, 123, (360_000, 6), dtype=np.uint8)
    texts = pa.array([" ".join(w.tobytes().decode() for w in part) for part in np.array_split(words, 40)])
    tracemalloc.start()
    ids = [len(x) for x in encode(texts)]
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert min(ids) >= 9000 and held < 32e6
