"""Decisions: thresholds, shortlist for a judge, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.schema import FLOOR, HIGH, JUDGE_K, LOW


def status_by_thresholds(sim: Column, high: float = HIGH, low: float = LOW) -> Column:
    return F.when(sim >= high, "grounded").when(sim >= low, "uncertain").otherwise("ungrounded")


def decide(best: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Status of each span from its best candidate (sim, source_id, uri, chunk; null if there is none)."""
    sim = F.coalesce(F.col("sim"), F.lit(-1.0))
    status = status_by_thresholds(sim, high, low)
    cited = status != "ungrounded"
    return best.select(
        *[c for c in best.columns if c not in ("sim", "source_id", "uri", "chunk")],
        status.alias("status"),
        F.when(cited, F.col("source_id")).alias("source_id"),
        F.when(cited, F.col("uri")).alias("source_uri"),
        F.col("uri").alias("candidate_uri"),
        F.greatest(sim, F.lit(0.0)).alias("confidence"),
        F.lit("embedding").alias("method"),
        F.when(cited, F.col("chunk")).alias("evidence"),
    )


def shortlist(ranked: DataFrame, span_key: list[str], high: float = HIGH, floor: float = FLOOR, k: int = JUDGE_K) -> DataFrame:
    """Candidates a judge reads: spans whose best similarity lies in [floor, high), the first k from floor on."""
    top = F.max(F.when(F.col("rank") == 1, F.col("sim"))).over(Window.partitionBy(*span_key))
    banded = ranked.withColumn("_top", top).where((F.col("_top") >= floor) & (F.col("_top") < high))
    return banded.where((F.col("sim") >= floor) & (F.col("rank") <= k)).drop("_top")


def decide_judged(best: DataFrame, verdicts: DataFrame, span_key: list[str], high: float = HIGH, floor: float = FLOOR) -> DataFrame:
    """Status where a judge rules the band [floor, high): the first derived candidate grounds a span.

    ``verdicts``: span_key, rank, source_id, uri, chunk, derived, evidence. An unavailable judge's
    rows are not derived. Confidence stays the best similarity, whichever candidate is derived.
    """
    first = (
        verdicts.where("derived").groupBy(*span_key)
        .agg(F.min_by(F.struct("source_id", "uri", "chunk", "evidence"), "rank").alias("_v"))
    )
    sim = F.coalesce(F.col("sim"), F.lit(-1.0))
    banded = (sim >= floor) & (sim < high)
    grounded = F.when(sim >= high, F.lit(True)).otherwise(banded & F.col("_v").isNotNull())
    pick = lambda own, judged: F.when(sim >= high, own).when(banded, judged)
    quote = F.when(F.col("_v.evidence") != "", F.col("_v.evidence"))
    joined = best.join(first, span_key, "left")
    return joined.select(
        *[c for c in best.columns if c not in ("sim", "source_id", "uri", "chunk")],
        F.when(grounded, "grounded").otherwise("ungrounded").alias("status"),
        pick(F.col("source_id"), F.col("_v.source_id")).alias("source_id"),
        pick(F.col("uri"), F.col("_v.uri")).alias("source_uri"),
        F.col("uri").alias("candidate_uri"),
        F.greatest(sim, F.lit(0.0)).alias("confidence"),
        F.when(banded, "llm_judge").otherwise("embedding").alias("method"),
        pick(F.col("chunk"), F.coalesce(quote, F.col("_v.chunk"))).alias("evidence"),
    )


def parse_verdict(reply: Column) -> Column:
    """derived, evidence, available of a judge's reply: the outermost braces as JSON.

    Only a JSON boolean counts as derived: the string "false" is not taken for true.
    """
    body = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    derived = F.try_variant_get(body, "$.derived", "variant")
    sure = F.when(F.schema_of_variant(derived) == "BOOLEAN", F.try_variant_get(derived, "$", "boolean"))
    quote = F.try_variant_get(body, "$.evidence", "variant")
    text = F.when(F.schema_of_variant(quote) == "STRING", F.try_variant_get(quote, "$", "string"))
    return F.struct(
        F.coalesce(sure, F.lit(False)).alias("derived"), F.coalesce(text, F.lit("")).alias("evidence"), F.lit(True).alias("available")
    )
