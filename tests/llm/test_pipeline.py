"""The pipeline's stages keep their contracts on the smallest tables."""

import collections

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        before, after = (collections.Counter(r.doc_id for r in x.select("doc_id").collect()) for x in (docs, out))
        assert set(after) <= set(before) and len(after) > 0.5 * len(before), name
        docs = out
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert collections.Counter(r.doc_id for r in tokens.collect()) == collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
