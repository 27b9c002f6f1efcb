"""The pipeline's stages against what their operators say, one after the other."""

from __future__ import annotations

import corpus_pipeline
from lumengraph.llm import exact_dedup, jaccard_join, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == columns and 0 < after.count() <= before
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "exact_dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_duplicates(docs).where("kept").collect()}
        if name == "ngram_jaccard_join":
            assert ids == {r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
        docs, before = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_names():
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
