"""Named queries over the test tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.lineage import cut
from spanloom.functions.numeric import dot
from spanloom.operators import capture, decide, evaluate, graph, report, segment, similarity
from spanloom.operators.embed import ColumnEmbedder
from spanloom.operators.judge import ColumnJudge
from spanloom.plans.attribute import KEY, attribute, candidates, conversation_tables


Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(name: str):
    return F.round(F.col(name), 6).alias(name)


# --- capture ---------------------------------------------------------------------------------


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uri"), F.lit("file").alias("type"),
        F.col("text").alias("content"), F.col("source").alias("session_id"),
    )


def source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.dedup_sources(document_sources(spark, sf_dir)).select("seq", "uri", "type", "content_hash", "session_id")


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("content"), F.col("ts").alias("seq")
    )


def artifact_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.version_artifacts(event_writes(spark, sf_dir)).select("event_id", "path", "content_hash", F.col("version").cast("bigint"))


def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.latest_artifacts(artifact_versions(spark, sf_dir)).select("path", "event_id", "content_hash", "version")


def raw_events(events: DataFrame) -> DataFrame:
    """Tool events as JSON: each event type stands for one branch of the router, with its edge cases."""
    n = F.col("event_id")
    some = lambda *pairs: F.struct(*[v.alias(k) for k, v in pairs])
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("f"), n.cast("string"))
    by = F.when
    kind = F.col("event_type")
    event = some(
        ("session_id", by(n % 7 != 0, F.col("user_id").cast("string"))),
        ("hook_event_name", by(kind == "signup", "UserPromptSubmit").otherwise("PostToolUse")),
        ("tool_name", by(kind == "view", "Read").when(kind == "click", by(n % 2 == 0, "Grep").otherwise("mcp__find"))
            .when(kind == "purchase", by(n % 3 == 0, "Write").otherwise("MultiEdit")).when(kind == "error", "WebFetch")),
        ("tool_input", some(
            ("file_path", by((kind == "view") & (n % 5 != 0), name).when((kind == "purchase") & (n % 3 == 0), name)),
            ("path", by((kind == "purchase") & (n % 3 == 1), name).when((kind == "view") & (n % 10 == 0), name)),
            ("content", by(kind == "purchase", F.concat(F.lit("w"), F.col("props")))),
            ("url", by((kind == "error") & (n % 2 == 0), F.concat(F.lit("http://x/"), name))),
            ("pattern", by(kind == "click", F.lit("p"))),
        )),
        ("tool_response", by(n % 4 == 0, none).otherwise(F.concat(F.lit("answers on: "), F.col("props")))),
        ("prompt", by(n % 6 != 0, F.concat(F.lit("ask "), name)).otherwise("")),
    )
    return events.select("event_id", F.to_json(event).alias("raw"))


def hook_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.route(raw_events(read(spark, sf_dir, "events"))).select("event_id", "target", "uri", "type", "content", "session_id")


def as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 7
    value = (
        F.when(n == 0, F.lit("null")).when(n == 1, F.concat(F.lit('"s'), F.col("event_type"), F.lit('"')))
        .when(n == 2, F.concat(F.lit('{"content":"c'), F.col("event_type"), F.lit('","text":"t"}')))
        .when(n == 3, F.concat(F.lit('{"content":1,"stdout":"o'), F.col("event_type"), F.lit('"}')))
        .when(n == 4, F.regexp_replace("props", " ", "")).when(n == 5, F.concat(F.lit('["'), F.col("event_type"), F.lit('",2]')))
        .otherwise(F.lit('{"result":"r","text":"t"}'))
    )
    return read(spark, sf_dir, "events").select("event_id", T.as_text(value).alias("txt"))


def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role <> 'assistant'")
    return rows.select("conv_id", "turn", T.preview(F.col("text"), 60).alias("cli"), T.preview(F.col("text"), 80).alias("tool"))


def sources_for_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role <> 'assistant'")
    named = rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("captured_at"), F.col("turn").alias("id"), "role")
    return graph.sources_for_session(named).select("session_id", "id", "role", F.col("place").cast("bigint"))


# --- text ------------------------------------------------------------------------------------

# Synthetic artifacts for the corner cases of segmentation.
CORNERS = [
    ("open", "f(\n\nx)\n\ny"), ("stray", ")\n\na\n\nb"), ("blanks", "a\n\n\n\nb\n"), ("lead", "\n\na {\n\n}\n\nb"), ("none", ""), ("space", " \n\t\n"),
    ("quote", 'a = "{"\n\nb\n\nc = "}"\n\nd'), ("cr", "a\r\n\r\nb\r\n"),
]


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, _ = conversation_tables(read(spark, sf_dir, "conversations"))
    corners = spark.createDataFrame(CORNERS, "path string, content string")
    return segment.segment(artifacts.select("path", "content").unionByName(corners), ["path"])


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("content"))
    both = sources.select(F.col("source_id").alias("key"), "content").unionByName(docs)
    return segment.chunk(both, ["key"]).select("key", "chunk_ord", T.content_hash(F.col("chunk")).alias("chunk_hash"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = similarity.token_vectors(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return vectors.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("norm")
    )


def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds the texts of the even documents."""
    docs = read(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 2 = 0").select(T.content_hash(F.col("text")).alias("content_hash")).distinct()
    return similarity.embed_cache_misses(docs, cache).select("content_hash", F.length("text").alias("n_chars"))


# --- similarity ------------------------------------------------------------------------------


def _dense(spark: SparkSession, sf_dir: str, grounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Queries: every fifth vector; pool: the others, for evaluation but those of label 9, which stands for ungrounded."""
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.where("vec_id % 5 = 0"), vectors.where("vec_id % 5 <> 0 and label <> 9" if grounded else "vec_id % 5 <> 0")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, pool = _dense(spark, sf_dir)
    found = similarity.dense_best(queries, pool, uri=None, least=0.30)
    return found.select("query_id", F.col("cand_ord").alias("vec_id"), six("sim"))


def _ranked_labels(spark: SparkSession, sf_dir: str, grounded: bool = False) -> DataFrame:
    queries, pool = _dense(spark, sf_dir, grounded)
    return similarity.rank(similarity.dense_best(queries, pool), ["query_id"], ["uri"])


def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, pool = _dense(spark, sf_dir)
    return similarity.dense_best(queries, pool).select("query_id", "uri", six("sim"), "cand_ord")


def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_labels(spark, sf_dir).where("rank <= 5").select("query_id", F.col("rank").cast("bigint"), "uri", six("sim"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    return attribute(artifacts, sources)


def decide_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(
        "path", "start_line", "end_line", "status", "source_uri", "candidate_uri", six("confidence"), "method"
    )


def decide_unscoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's artifact against the sources of all conversations, each under a uri of its own."""
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    pool = sources.withColumns({"uri": F.col("source_id"), "uri_ord": F.col("conv_id") * 1000 + F.col("turn")})
    return attribute(artifacts, pool, session_scoped=False).select("path", "start_line", "end_line", "status", "source_uri", "candidate_uri", six("confidence"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedder() -> ColumnEmbedder:
    """Unit vectors of the counts of letters: an embedder that SQL can check."""
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))  # noqa: E731  # a lambda's body computes what it names anew
    counted = lambda low: F.array(*[F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in LETTERS])
    norm = lambda counts: F.greatest(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * n)), F.lit(1e-12))
    unit = lambda counts: once(norm(counts), lambda size: F.transform(counts, lambda n: n / size))
    return ColumnEmbedder(once(F.lower("text"), lambda low: once(counted(low), unit)))


def decide_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense attribution; the vectors of even conversations' user turns come from the cache."""
    from spanloom.schema import EMBEDDING

    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    known = sources.where("conv_id % 2 = 0").select(F.col("content").alias("text"))
    empty = spark.createDataFrame([], EMBEDDING)
    cache = similarity.embed_with_cache(known, empty, letter_embedder().transform)
    found = attribute(artifacts, sources, high=0.95, low=0.9, embedder=letter_embedder(), cache=cache)
    return found.select("path", "start_line", "end_line", "status", "source_uri", "candidate_uri", six("confidence"))


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("sim"))


def line_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, _ = conversation_tables(read(spark, sf_dir, "conversations"))
    asked = artifacts.select("path", "content", F.explode(F.array(*[F.struct(F.lit(s).alias("a"), F.lit(e).alias("z")) for s, e in ((1, 1), (0, 2), (3, 5))])).alias("l"))
    return asked.select("path", F.col("l.a").cast("bigint").alias("a"), F.col("l.z").cast("bigint").alias("z"), T.line_slice(F.col("content"), F.col("l.a"), F.col("l.z")).alias("lines"))


# --- the spike's pipeline ----------------------------------------------------------------------


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file for each part: a comment, a function, a blank line, and one that is not closed."""
    key = F.col("p_partkey").cast("string")
    content = F.concat(
        F.lit("// "), F.col("p_name"), F.lit("\nexport function f"), key, F.lit("(x) {\n  return "), F.col("p_size").cast("string"),
        F.lit("\n}\n\nexport function g"), key, F.lit("() {\n  "), F.col("p_brand"),
    )
    return read(spark, sf_dir, "part").select(key.alias("path"), content.alias("content"))


def spike_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.segment_functions(_functions(spark, sf_dir), ["path"])
    return found.select("path", "name", "start_line", "end_line", T.content_hash(F.col("text")).alias("text_hash"))


def spike_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth of each function by its name; odd parts are not in the map."""
    truth = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("expected"))
    return evaluate.with_truth(spike_spans(spark, sf_dir), truth).select("name", "start_line", "expected")


def spike_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    found = segment.chunk(docs, ["doc_id"], least=15, delimiters=".\n", fallback=False)
    return found.select("doc_id", "chunk_ord", T.content_hash(F.col("chunk")).alias("chunk_hash"))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = _results(spark, sf_dir).select("path", "start_line", F.posexplode("top_candidates").alias("place", "c"))
    return exploded.select("path", "start_line", F.col("place").cast("bigint"), "c.uri", F.round("c.sim", 6).alias("sim"))


def judge_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    _, found, _ = candidates(artifacts, sources)
    listed = decide.shortlist(similarity.rank(found, KEY, ["uri_ord"]), KEY)
    return listed.select("path", "start_line", F.col("rank").cast("bigint"), "uri", six("sim"))


def stub_judge() -> ColumnJudge:
    size = F.length("source_text")
    return ColumnJudge(size % 3 == 0, F.when(size % 2 == 0, F.substring("source_text", 1, 10)).otherwise(""))


def judge_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    return attribute(artifacts, sources, stub_judge()).select(
        "path", "start_line", "status", "source_uri", "candidate_uri", six("confidence"), "method",
        T.content_hash(F.col("evidence")).alias("evidence_hash"),
    )


def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    reply = (
        F.when(n == 0, F.concat(F.lit('{"derived": true, "evidence": "e'), F.col("event_type"), F.lit('"}')))
        .when(n == 1, F.lit('```json\n{"derived": false, "evidence": ""}\n```')).when(n == 2, F.lit("no object here"))
        .when(n == 3, F.lit('{"derived": "false"}')).when(n == 4, F.lit("{broken: }")).otherwise(F.lit('so {"evidence": "q", "derived": true} it is'))
    )
    return read(spark, sf_dir, "events").select("event_id", decide.parse_verdict(reply).alias("v")).select("event_id", "v.*")


# --- graph -----------------------------------------------------------------------------------


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """sources and artifacts of the conversations; ids are readable keys."""
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    own = sources.select(
        F.col("source_id").alias("id"), "uri", F.when(F.col("role") == "user", "user_msg").otherwise("conversation").alias("type"),
        F.col("turn").alias("captured_at"), "session_id",
    )
    return own, artifacts.select(F.col("path").alias("id"), "path", F.lit(1).alias("version"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sources, artifacts, spans and links of the attributed conversations."""
    results = cut(_results(spark, sf_dir))  # read as spans and as links
    span_id = F.concat_ws(":", "path", F.col("start_line").cast("string"))
    spans = results.select(span_id.alias("id"), F.col("path").alias("artifact_id"), "start_line", "end_line", F.lit("block").alias("kind"))
    links = results.select(
        F.concat(F.lit("l"), span_id).alias("id"), span_id.alias("span_id"), "source_id", "confidence", "method", F.col("evidence").alias("evidence_quote")
    )
    return *_named(spark, sf_dir), spans, links


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, artifacts, _, links = _graph(spark, sf_dir)
    return graph.counts(sources, artifacts, links)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation cites a user turn on its first line; some name a uri or a path that is not there."""
    ids = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    path = F.col("conv_id").cast("string")
    return ids.select(
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("no"), path)).otherwise(path).alias("path"), F.lit(1).cast("bigint").alias("start_line"),
        F.lit(1).cast("bigint").alias("end_line"), F.when(F.col("conv_id") % 3 == 0, "nowhere").otherwise("user1").alias("source_uri"),
        F.lit("said").alias("evidence"),
    )


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, artifacts = _named(spark, sf_dir)  # citations read no spans: nothing is attributed for them
    return graph.declare_citations(_citations(spark, sf_dir), artifacts, sources)


def declared_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _declared(spark, sf_dir).select("path", "source_uri", "source_id", "confidence", "method", "ok", "reason")


def why_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, artifacts, spans, links = _graph(spark, sf_dir)
    lines = artifacts.select("path", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3, 99)])).alias("line"))
    found = graph.why(lines, artifacts, spans, links, sources)
    return found.select("path", "line", "start_line", "end_line", "uri", "type", six("confidence"), "method")


def why_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every artifact, and one behind its end: the links of each."""
    sources, artifacts, spans, links = _graph(spark, sf_dir)
    written, _ = conversation_tables(read(spark, sf_dir, "conversations"))
    count = F.size(F.split("content", "\n", -1)).cast("bigint")
    lines = written.select("path", F.explode(F.sequence(F.lit(1).cast("bigint"), count + 1)).alias("line"))
    found = graph.why(lines, artifacts, spans, links, sources)
    return found.select("path", "line", "start_line", "end_line", "uri", "type", six("confidence"), "method")


def attribution_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, artifacts, spans, links = _graph(spark, sf_dir)
    found = graph.attribution_for(artifacts.select("path"), artifacts, spans, links, sources)
    return found.select("path", "start_line", "end_line", "kind", "uri", six("confidence"), "method")


def replace_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations are attributed anew; their declared citations, on spans of their own, survive."""
    _, _, spans, links = _graph(spark, sf_dir)
    declared = cut(_declared(spark, sf_dir).where("ok"))  # read as spans and as links
    cited = F.concat(F.lit("c"), F.col("path"))
    spans = spans.unionByName(declared.select(cited.alias("id"), F.col("path").alias("artifact_id"), "start_line", "end_line", F.lit("block").alias("kind")))
    links = links.unionByName(
        declared.select(F.concat(F.lit("l"), cited).alias("id"), cited.alias("span_id"), "source_id", "confidence", "method", F.col("evidence").alias("evidence_quote"))
    )
    again = spans.select("artifact_id").distinct().where(F.col("artifact_id").try_cast("bigint") % 2 == 0)
    left_spans, left_links = graph.replace_attribution(spans, links, again)
    return left_links.select(F.col("id"), F.lit("link").alias("what")).unionByName(left_spans.select("id", F.lit("span").alias("what")))


# --- store and SQL ---------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str):
    """A store of the conversations: captured, attributed, and the even ones attributed once more."""
    from spanloom.sources.store import Store
    from spanloom.streaming.capture import fresh_root

    store = Store(spark, fresh_root(spark, "store"))
    artifacts, sources = conversation_tables(read(spark, sf_dir, "conversations"))
    place = F.col("conv_id") * 1000 + F.col("turn")
    store.add_sources(sources.withColumns({"seq": place, "captured_at": F.timestamp_seconds(place), "type": F.lit("user_msg")}))
    at = F.timestamp_seconds(F.col("path").cast("bigint"))
    for content in (F.lit("first draft"), F.col("content")):
        store.add_artifacts(artifacts.withColumns({"content": content, "created_at": at, "generator": F.lit("agent")}))
    latest = cut(capture.latest_artifacts(store.table("artifact")))
    pool = store.table("source").select(F.col("id").alias("source_id"), "uri", F.col("id").alias("uri_ord"), "content", "session_id")
    ids = latest.select("path", F.col("id").alias("artifact_id"))
    found = cut(attribute(latest.select("path", "content", "session_id"), pool).join(ids, "path"))
    store.write_attribution(found.withColumn("status", F.lit("first")))
    store.write_attribution(found.where(F.col("path").cast("bigint") % 2 == 0))
    return store


def store_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after capture, attribution and a second attribution of the even conversations."""
    store = _stored(spark, sf_dir)
    spans = store.table("span").select(F.col("id").alias("span_id"), "artifact_id", "start_line", "end_line")
    named = store.table("artifact").select(F.col("id").alias("artifact_id"), "path", "version")
    uris = store.table("source").select(F.col("id").alias("source_id"), "uri")
    held = store.table("link").join(spans, "span_id").join(named, "artifact_id").join(uris, "source_id", "left")
    return held.select("path", "version", "start_line", "end_line", "uri", six("confidence"), "method", "status")


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even documents' texts are cached; those put again, reversed, for all documents are new for the others alone."""
    from spanloom.sources.store import Store
    from spanloom.streaming.capture import fresh_root

    store = Store(spark, fresh_root(spark, "vectors"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("float").alias("n"))
    one = F.lit(1).cast("float")
    store.put_vectors(hashed.where("doc_id % 2 = 0").select("content_hash", F.array("n", one).alias("vec")))
    store.put_vectors(hashed.select("content_hash", F.array(one, "n").alias("vec")))
    found = store.get_vectors(docs.where("doc_id % 3 = 0"))
    return found.select("content_hash", F.col("vec")[0].cast("double").alias("first"), F.col("vec")[1].cast("double").alias("second"))


def sql_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.functions.tables import register

    register(spark)
    artifacts, _ = conversation_tables(read(spark, sf_dir, "conversations"))
    corners = spark.createDataFrame(CORNERS, "path string, content string")
    artifacts.select("path", "content").unionByName(corners).createOrReplaceTempView("written")
    return spark.sql("select path, s.* from written, lateral segment_lines(content) s")


def sql_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.functions.tables import register

    register(spark)
    for name in ("conversations", "documents"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql("""
        with t as (
            select concat_ws(':', conv_id, turn) as key, text from conversations where role <> 'assistant' union all select concat('d', doc_id), text from documents
        )
        select key, c.chunk_ord, sha2(c.chunk, 256) as chunk_hash from t, lateral chunk_text(text, 2, 12) c""")


def sql_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the first lines of each artifact, by the views over a store."""
    _stored(spark, sf_dir).register_views()
    return spark.sql("""
        select w.path, l.line, w.start_line, w.end_line, w.uri, round(w.confidence, 6) as confidence, w.method
        from why w join (values (1L), (2L), (3L), (99L)) l(line) on l.line between w.start_line and w.end_line""")


# --- reports ---------------------------------------------------------------------------------


def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.audit(_results(spark, sf_dir), ["path"])


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.gate(_results(spark, sf_dir)).select("path", "spans", "ungrounded", six("ungrounded_pct"), "failed")


def attestation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.attestation_spans(_results(spark, sf_dir))
    return rows.select("path", "spans", "grounded", F.posexplode("details").alias("place", "d")).select(
        "path", "spans", "grounded", F.col("place").cast("bigint"), "d.start_line", "d.end_line", "d.status", "d.source", "d.confidence"
    )


def attestation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of all artifacts under one signature: as signed, and with the coverage of one after the other altered."""
    import tempfile

    from spanloom.operators import attest

    with tempfile.TemporaryDirectory() as folder:  # of the driver, which signs
        signer = attest.Signer(spark, folder)
        rows, document = attest.attest_all(_results(spark, sf_dir), "2026-01-01T00:00:00.000Z", signer)
        altered = rows.withColumn("report", F.regexp_replace("report", '"grounded":', '"grounded":1'))
        signed, changed = (attest.verify_all(given, document, signer) for given in (rows, altered))
        forged = attest.verify_all(rows, document | {"reports": document["reports"] + 1}, signer)
    parts = [df.select("path", F.lit(name).alias("document"), "valid") for name, df in (("signed", signed), ("altered", changed), ("forged", forged))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- evaluation ------------------------------------------------------------------------------


def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    people = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    both = parts.unionByName(people)
    return both.select("kind", "key", T.split_hash(F.col("name")).alias("h"), T.split_of(F.col("name")).alias("split"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best label of each query; label 9 is not in the pool, so it stands for ungrounded."""
    ranked = _ranked_labels(spark, sf_dir, grounded=True)
    queries, _ = _dense(spark, sf_dir)
    truth = queries.select(
        F.col("vec_id").alias("query_id"), F.when(F.col("label") == 9, evaluate.UNGROUNDED).otherwise(F.col("label").cast("string")).alias("expected")
    )
    best = ranked.where("rank = 1").select("query_id", "sim", F.col("uri").alias("source"))
    return evaluate.expected_rank(ranked, truth, ["query_id"]).join(best, "query_id").withColumn("set", F.lit("all"))


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    rates = ("precision", "recall", "f1", "false_attribution", "source_accuracy")
    return df.select(*keys, "tp", "fp", "fn", "tn", *[six(r) for r in rates])


def expected_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.select("query_id", "expected", F.col("expected_rank").cast("bigint"), six("expected_sim"), "source", six("sim"))


def oracle_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.oracle(_records(spark, sf_dir), ["set"]), ["set"])


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return _rounded(evaluate.confusion(rows, F.col("sim") >= 0.30, F.col("source") == F.col("expected"), ["set"]), ["set"])


SWEEP = (0.25, 0.30, 0.35, 0.40, 0.45, 0.50)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.sweep(_records(spark, sf_dir), list(SWEEP), ["set"]), ["set", "threshold"])


def calibrate_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of records: all, and one whose ungrounded similarities are lowered so that a threshold can part them."""
    rows = _records(spark, sf_dir)
    lowered = rows.withColumns({
        "set": F.lit("lowered"), "sim": F.when(F.col("expected") == evaluate.UNGROUNDED, F.col("sim") * 0.6).otherwise(F.col("sim")),
    })
    return evaluate.calibrate_low(rows.unionByName(lowered), ["set"]).select("set", six("low"), six("f1"))


def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels find the end of each assistant turn; every fourth looks for what is not there."""
    conversations = read(spark, sf_dir, "conversations")
    rows = conversations.where("role = 'assistant'")
    ending = F.expr("right(text, 15)")
    labels = rows.select(
        F.col("conv_id").cast("string").alias("path"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("~"), ending)).otherwise(ending).alias("find"),
        F.lit("user1").alias("expected"),
    ).distinct()
    spans = _results(spark, sf_dir).select("path", "start_line", "text", F.col("confidence").alias("sim"), F.col("candidate_uri").alias("source"))
    return evaluate.align(labels, cut(spans)).select("path", "find", "expected", "start_line", "source", six("sim"))


def eval_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation from its dataset to its rates: sources and artifacts seeded into a store, attributed from there without
    session scope, aligned with the labels and scored. Each turn's label expects its conversation's first turn."""
    from spanloom.sources.datasets import seed
    from spanloom.sources.store import Store
    from spanloom.streaming.capture import fresh_root

    conversations = read(spark, sf_dir, "conversations")
    artifacts, sources = conversation_tables(conversations)
    given = sources.select(F.col("source_id").alias("uri"), F.lit("user_msg").alias("type"), "content", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    store = Store(spark, fresh_root(spark, "eval"))
    captured, written = seed(given, artifacts.select("path", "content"))
    store.add_sources(captured)
    store.add_artifacts(written)
    latest = capture.latest_artifacts(store.table("artifact")).select("path", "content", "session_id")
    pool = store.table("source").select(F.col("id").alias("source_id"), "uri", F.col("id").alias("uri_ord"), "content", "session_id")
    found = attribute(latest, pool, session_scoped=False)
    spans = cut(found.select("path", "start_line", "text", F.col("confidence").alias("sim"), F.col("candidate_uri").alias("source")))
    labels = conversations.where("role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("path"), F.expr("right(text, 15)").alias("find"), F.concat(F.col("conv_id").cast("string"), F.lit(":0")).alias("expected")
    ).distinct()
    records = evaluate.align(labels, spans).withColumn("set", F.lit("all"))
    return _rounded(evaluate.confusion(records, F.col("sim") >= 0.45, F.col("source") == F.col("expected"), ["set"]), ["set"])


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit("."), F.col("event_type")).alias("path"))
    return evaluate.languages(files)


def judge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    judges = {"never": F.lit(False), "always": F.lit(True), "even": F.col("query_id") % 2 == 0}
    return _rounded(evaluate.scored_by_judges(_records(spark, sf_dir), judges, ["set"]), ["set", "model"])


def spike_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retrieval_metrics(_records(spark, sf_dir), ["set"]).select("set", six("top1"), six("decided"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even queries are the test; a judge's results lack every third query and hold others that no test asks for."""
    rows = _records(spark, sf_dir)
    status = F.when(F.col("sim") >= 0.30, "grounded").otherwise("ungrounded")
    results = rows.where("query_id % 3 <> 0").select("query_id", status.alias("status"), F.when(F.col("sim") >= 0.30, F.col("source")).alias("source"))
    return evaluate.live(rows.where("query_id % 2 = 0"), results, ["query_id"])


def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = F.col("live_status") == "grounded"
    return _rounded(evaluate.confusion(_live(spark, sf_dir), predicted, F.col("live_source") == F.col("expected"), ["set"]), ["set"])


def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _live(spark, sf_dir).withColumn("find", F.concat(F.lit("query "), F.col("query_id").cast("string")))
    return evaluate.live_lines(named, "find").select("query_id", "line")


def dataset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files of sources, documents by doc_id modulo 3, that overlap in uri; the first file wins."""
    from spanloom.sources.datasets import merge_sources

    docs = read(spark, sf_dir, "documents")
    files = [
        docs.where(F.col("doc_id") % 3 == k).select(
            F.concat(F.lit("u"), (F.col("doc_id") % 500).cast("string")).alias("uri"), F.col("doc_id").alias("ord"), F.lit("file").alias("type"), F.col("text").alias("content")
        )
        for k in range(3)
    ]
    return merge_sources(files).select("uri", F.col("file_ord").cast("bigint"), "ord", T.content_hash(F.col("content")).alias("content_hash"))


# --- streams ---------------------------------------------------------------------------------


def stream_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.streaming.capture import batch_of_stream, dedup_stream

    def sources(stream: DataFrame) -> DataFrame:
        return dedup_stream(stream.select(F.col("event_type").alias("content"), F.col("user_id").cast("string").alias("session_id"))).select(
            "content_hash", "session_id"
        )

    return batch_of_stream(spark, sf_dir, "events", sources)


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.streaming.capture import batch_of_stream, route_stream

    routed = batch_of_stream(spark, sf_dir, "events", lambda stream: route_stream(raw_events(stream)))
    return routed.select("event_id", "target", "uri", "type", "content", "session_id")


def _event_log(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines: the tool events, and lines that are none."""
    from spanloom.sources import hook
    from spanloom.streaming.capture import fresh_root

    hook.register(spark)
    events = read(spark, sf_dir, "events")
    other = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "{broken").otherwise("[1]")
    folder = f"{fresh_root(spark, 'log')}/in"
    raw_events(events).select("raw").unionByName(events.where("event_id % 20 = 0").select(other.alias("raw"))).write.text(folder)
    return folder


def hook_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the event source reads with a filter that it applies itself, routed."""
    reads = spark.read.format("hook_events").load(_event_log(spark, sf_dir)).where("tool_name = 'Read'")
    return capture.route(reads.select("raw")).select("target", "uri", "type", "content", "session_id")


def hook_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.streaming.capture import route_stream, run_available

    folder = _event_log(spark, sf_dir)
    root = folder.removesuffix("/in")
    run_available(route_stream(spark.readStream.format("hook_events").load(folder).select("raw")), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("target", "uri", "type", "content", "session_id")


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes arrive in three slices and up to 80 minutes out of order; a last one, of no path, lets the watermark pass them all."""
    from spanloom.streaming.capture import fresh_root, stream_of_slices, typed_state, version_stream

    typed_state(spark)
    events = read(spark, sf_dir, "events")
    writes = events.select("event_id", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("content"), F.col("ts").alias("seq"))
    arrival = F.col("seq") + F.make_dt_interval(mins=(F.col("event_id") % 5 * 20).cast("int"))
    third = F.when(F.month(arrival) > 1, 2).otherwise(F.least(F.floor((F.dayofmonth(arrival) - 1) / 10), F.lit(2)))
    slices = [writes.where(third == k) for k in range(3)]
    after = writes.agg(F.lit(-1).cast("bigint").alias("event_id"), F.lit("").alias("path"), F.lit("").alias("content"), (F.max("seq") + F.expr("interval 2 days")).alias("seq"))
    slices[2] = slices[2].unionByName(after)
    return stream_of_slices(slices, lambda stream: version_stream(stream, "2 hours"), fresh_root(spark, "versions")).select("event_id", "path", "content_hash", "version")


def stream_dedup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five slices of six days with a watermark of nine: every seventh event comes 18 days late and is left out; a
    content that a session repeats is kept again when its key has expired."""
    from spanloom.streaming.capture import dedup_stream, fresh_root, stream_of_slices

    part = F.floor((F.dayofmonth("ts") - 1) / 6)
    rows = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("content"), F.col("user_id").cast("string").alias("session_id"), part.alias("part"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(part * 6).cast("int"))).alias("at"),
        (part + F.when(F.col("event_id") % 7 == 0, 3).otherwise(0)).alias("slice"),
    )
    slices = [rows.where(F.col("slice") == k).drop("slice") for k in range(5)]
    found = stream_of_slices(slices, lambda stream: dedup_stream(stream, ("at", "9 days")), fresh_root(spark, "late"))
    return found.select("content_hash", "session_id", F.col("part").cast("bigint"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        source_dedup, artifact_versions, latest_artifact, hook_route, as_text, source_preview, sources_for_session, segment_spans, chunk_windows,
        token_vectors, embed_cache_misses, cosine_pairs, best_per_source, topk_candidates, decide_embedding, top_candidates, judge_shortlist,
        judge_decide, parse_verdict, counts, declared_citation, why_line, why_bulk, attribution_for, replace_attribution, audit_coverage, gate,
        attestation_spans, attestation_verify, split_hash, expected_rank, oracle_ceiling, eval_confusion, threshold_sweep, calibrate_low,
        decide_unscoped, decide_dense, vector_dot, line_slices, spike_spans, spike_truth, spike_chunks, live_scores, live_lines,
        label_alignment, eval_seeded, languages, judge_sweep, spike_metrics, dataset_merge, stream_source_dedup, stream_route, stream_versions, stream_dedup_late,
        hook_source, hook_source_stream, store_attribution, store_vectors, sql_segment, sql_chunk, sql_why,
    )
}
