"""The pipeline: every stage takes effect on all that the one before kept."""

import os

import pytest

import corpus_pipeline
from folioflow.llm import ngram_join, pii, toxicity

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs.select("doc_id", "text"), labels).filter("predicted = 1").collect()}
    clean = corpus_pipeline.materialise(steps["toxicity"](spark, docs, TABLES), "test")
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == columns and kept == {r["doc_id"] for r in docs.collect()} - toxic

    components = {r["component_id"] for r in ngram_join.join(clean, words=5, units=(80, 100)).collect()}
    unlike = corpus_pipeline.materialise(steps["near copies"](spark, clean, TABLES), "test")
    assert unlike.columns == columns and {r["doc_id"] for r in unlike.collect()} == components

    private = corpus_pipeline.materialise(steps["personal data"](spark, unlike, TABLES), "test")
    assert private.columns == columns and private.count() == unlike.count()
    left = pii.find_base(private.select("doc_id", "text")).filter("size(email) + size(ip) + size(card) + size(phone) > 0")
    assert left.count() == 0

    mixed = corpus_pipeline.materialise(steps["mix"](spark, private, TABLES), "test")
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= components
    packed = steps["packing"](spark, mixed, TABLES)
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
