"""The attribution plan: artifacts and sources in, one result row for each span out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.lineage import cut
from spanloom.operators import decide, headed, segment, similarity
from spanloom.operators.embed import Embedder, dense_scores
from spanloom.operators.judge import Judge
from spanloom.schema import EMBEDDING, FLOOR, HIGH, JUDGE_K, LOW, TOP_CANDIDATES


CHUNK = ["scope", "uri", "uri_ord", "source_id", "chunk_ord"]


def candidates(
    artifacts: DataFrame, sources: DataFrame, session_scoped: bool = True, embedder: Embedder | None = None, cache: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans (scope, path, start_line, end_line, text), each span's best candidate of each uri, and the chunks.

    ``artifacts``: path, content, session_id; ``sources``: source_id, uri, uri_ord, content, session_id.
    Without session scope all sources are one pool, and each span's TOP_CANDIDATES first candidates alone are made. Without an embedder bags of tokens are compared;
    with one, texts that ``cache`` (content_hash, vec) lacks are embedded. Candidates name their
    chunk (``chunk_uri_ord``, ``source_id``, ``chunk_ord``); ``with_chunks`` fetches the texts of those that need them.
    """
    scope = F.col("session_id") if session_scoped else F.lit("*")
    spans = segment.segment(artifacts.withColumn("scope", scope), ["scope", "path"])
    pool = sources.withColumn("scope", scope)
    if not session_scoped:
        pool = pool.withColumn("content", F.coalesce("content", F.lit("")))  # every source has a chunk
    chunks = segment.chunk(pool, ["scope", "uri", "uri_ord", "source_id"])
    chunk_key, span_key = CHUNK[1:], KEY[1:]
    if embedder is None and not session_scoped:
        found = headed.best_uris(spans, chunks, ["scope"], span_key, chunk_key).withColumnsRenamed({"uri_ord": "chunk_uri_ord", "first_ord": "uri_ord"})
        return spans, found.select(*KEY, "uri", "uri_ord", "source_id", "chunk_uri_ord", "chunk_ord", "sim"), chunks
    if embedder is None:
        scores = similarity.sparse_scores(spans, chunks, ["scope"], span_key, chunk_key)
    else:
        texts = spans.select("text").union(chunks.select("chunk"))
        held = cache if cache is not None else artifacts.sparkSession.createDataFrame([], EMBEDDING)
        vectors = cut(similarity.embed_with_cache(texts, held, embedder.transform))  # spans and chunks both read them
        scores = dense_scores(spans, chunks, vectors, ["scope"], span_key, chunk_key)
    best = similarity.best_per_source(scores, KEY, order=("uri_ord", "chunk_ord"))
    firsts = pool.groupBy("scope", "uri").agg(F.min("uri_ord").alias("uri_ord"), F.min_by("source_id", "uri_ord").alias("source_id"))
    firsts = firsts.select("scope", "uri", "uri_ord", "source_id", F.col("uri_ord").alias("chunk_uri_ord"), F.lit(0).cast("bigint").alias("chunk_ord"))
    # candidates rank by the first appearance of their uri, whichever of its sources was best
    best = best.withColumnRenamed("uri_ord", "chunk_uri_ord").join(firsts.select("scope", "uri", "uri_ord"), ["scope", "uri"])
    full = similarity.with_zero_candidates(best, spans, firsts, ["scope"], span_key)
    return spans, full.select(*KEY, "uri", "uri_ord", "source_id", "chunk_uri_ord", "chunk_ord", "sim"), chunks


KEY = ["scope", "path", "start_line", "end_line"]


def with_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The candidates with their chunk's text."""
    texts = chunks.select(*CHUNK, "chunk").withColumnRenamed("uri_ord", "chunk_uri_ord")
    return rows.join(texts, [c if c != "uri_ord" else "chunk_uri_ord" for c in CHUNK], "left")


def attribute(
    artifacts: DataFrame, sources: DataFrame, judge: Judge | None = None, high: float = HIGH, low: float = LOW, floor: float = FLOOR,
    judge_k: int = JUDGE_K, session_scoped: bool = True, embedder: Embedder | None = None, cache: DataFrame | None = None,
) -> DataFrame:
    """path, start_line, end_line, text, status, source_id, source_uri, candidate_uri, top_candidates,
    confidence, method, evidence of every span of every artifact."""
    spans, found, chunks = candidates(artifacts, sources, session_scoped, embedder, cache)
    ranked = similarity.rank(found, KEY, ["uri_ord"], TOP_CANDIDATES)
    entry = F.struct("rank", "uri", "sim", "source_id", "chunk_uri_ord", "chunk_ord")
    tops = ranked.groupBy(*KEY).agg(F.array_sort(F.collect_list(entry)).alias("_t"))  # TOP_CANDIDATES at most
    first = lambda c: F.get("_t", F.lit(0))[c].alias(c)
    tops = tops.select(
        *KEY, F.transform("_t", lambda c: F.struct(c["uri"], c["sim"])).alias("top_candidates"),
        *(first(c) for c in ("uri", "sim", "source_id", "chunk_uri_ord", "chunk_ord")),
    )
    best = with_chunks(spans.join(tops, KEY, "left"), chunks).drop("chunk_uri_ord", "chunk_ord")
    if judge is None:
        return decide.decide(best, high, low)
    listed = with_chunks(decide.shortlist(ranked, KEY, high, floor, judge_k), chunks)
    texts = spans.select(*KEY, F.col("text").alias("span_text"))
    whole = sources.select("source_id", F.col("content").alias("source_text"))
    # the band is filtered before the judge, whose cost no optimizer can see
    pairs = listed.join(texts, KEY).join(whole, "source_id", "left").withColumn("source_text", F.coalesce("source_text", "chunk"))
    return decide.decide_judged(best, judge.verdicts(pairs), KEY, high, floor)


def conversation_tables(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts (a conversation's assistant turns, a blank line between them) and sources (all other turns)."""
    turns = conversations.where("role = 'assistant'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n")
    artifacts = turns.groupBy("conv_id").agg(joined.alias("content")).select(
        F.col("conv_id").cast("string").alias("path"), "content", F.col("conv_id").cast("string").alias("session_id")
    )
    sources = conversations.where("role <> 'assistant'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"),
        F.concat("role", F.col("turn").cast("string")).alias("uri"), F.col("turn").alias("uri_ord"),
        F.col("text").alias("content"), F.col("conv_id").cast("string").alias("session_id"), "role", "conv_id", "turn",
    )
    return artifacts, sources
