from collections import Counter

import corpus_pipeline
from gapscope.llm import packing


def test_stages_keep_the_columns_and_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3]
    assert not docs.where("text rlike 'AKIA[0-9A-Z]{16}'").count()
    want = Counter(tuple(r) for r in packing.pieces(docs, packing.VOCABULARY).collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    assert max(r["offset"] + r["length"] for r in got) <= packing.LENGTH
