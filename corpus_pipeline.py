"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go,
personal data is masked, and the rest is packed into token windows.

Each stage reads all rows that the one before kept, and all but the last return all columns of
their input, whatever their names. Defined results: documents with a null or empty text are not
toxic (they get the score of no evidence), are copies of one another, so that one of them stays,
hold no benchmark item and no personal data, and are packed as one separator; a null doc_id is kept
like any other, last in its group of copies; repeated rows are judged alike, and one of them stays;
an empty table passes through all stages; without labels nothing is toxic, without benchmark items
nothing leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import kk_packing, near_copies, pii_crf, template_decon, toxicity
from spanloom.llm.common import checkpoint, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decon.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kk_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

# SQL can't express the fitted models and the tokenizer: tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is checkpointed, as later stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
