"""The pipeline's stages keep their contract on the smallest tables."""

import corpus_pipeline
from textloom.llm.common import cut
from textloom.llm.secrets_crf import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        now = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(now) <= ids and now
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS and len(now) == len(set(now))
        if name in ("line_dedup", "secret_scans", "best_fit_packing"):
            assert set(now) == ids
        if name == "secret_scans":
            assert not any(base_spans(r["text"] or "") for r in docs.collect())
        ids = set(now)
