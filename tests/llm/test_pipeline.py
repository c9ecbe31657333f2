"""The pipeline's stages on the smallest tables."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_keep_columns_and_only_drop_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.6 * len(ids)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert sorted(docs.columns) == sorted(before)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
