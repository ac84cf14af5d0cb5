"""A small toxic class still gives terms."""

import os

import pytest

from spanloom.llm import toxicity

DATA = "/root/testdata/sf0.001"


def test_toxic_rows_are_found_in_few_examples(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()} - toxic
    flagged = {r["doc_id"] for r in toxicity.detect(docs, labels).where("predicted = 1").collect()}
    assert len(flagged & toxic) >= len(toxic) / 2 and not flagged & clean
    kept = {r["doc_id"] for r in toxicity.reject(docs, labels).select("doc_id").collect()}
    assert not kept & flagged and clean <= kept
