"""Capture: tool events to source rows and versioned artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions.text import content_hash, text_of, utf16_length

WRITE_TOOLS = ("Write", "Edit", "MultiEdit")
SEARCH_TOOLS = ("Grep", "Glob")
LEAST_RESULT = 20  # UTF-16 units that a search result must exceed
MOST_PATTERN = 200
EVENT = (
    "session_id string, hook_event_name string, tool_name string, tool_response string, prompt string,"
    " tool_input struct<file_path:string,path:string,content:string,url:string,pattern:string>"
)


def route(events: DataFrame, raw: str = "raw", generator: str = "agent") -> DataFrame:
    """Raw JSON events to rows: target (source or artifact), uri, type, content, session_id.

    The first rule that fits decides; malformed and blank events, and those no rule takes, are
    dropped. Columns other than ``raw`` pass through. ``resolved_content``, if there is such a
    column, is a written file's text after the event and goes before the event's own content.
    """
    body = F.col(raw)
    kept = [c for c in events.columns if c not in (raw, "resolved_content")]
    # the plain fields come from one typed parse; the response may be any JSON, so it stays a variant
    parsed = events.withColumn("_v", F.try_parse_json(body)).where("_v is not null").withColumn("_e", F.from_json(body, EVENT))
    text = lambda path: F.coalesce(F.col(f"_e.{path}"), F.lit(""))
    written = text("tool_input.content")
    if "resolved_content" in events.columns:
        written = F.coalesce(F.col("resolved_content"), written)
    event = parsed.select(
        *kept, F.coalesce("_e.session_id", F.lit("unknown")).alias("session_id"), F.col("_e.tool_name").alias("_tool"),
        F.col("_e.hook_event_name").alias("_name"), text("prompt").alias("_prompt"),
        text("tool_input.file_path").alias("_file"), F.coalesce("_e.tool_input.file_path", "_e.tool_input.path", F.lit("")).alias("_path"),
        F.col("_e.tool_input.url").alias("_url"),
        text("tool_input.pattern").alias("_pattern"), written.alias("_written"),
        text_of(F.try_variant_get("_v", "$.tool_response", "variant"), F.col("_e.tool_response")).alias("_answer"),
    )
    tool, name, prompt, file, path, answer = (F.col(c) for c in ("_tool", "_name", "_prompt", "_file", "_path", "_answer"))
    searching = tool.isin(*SEARCH_TOOLS) | F.startswith(tool, F.lit("mcp__"))

    def row(target: str, uri: Column, kind: str | None, content: Column) -> Column:
        return F.struct(F.lit(target).alias("target"), uri.alias("uri"), F.lit(kind).cast("string").alias("type"), content.alias("content"))

    search_uri = F.substring(F.concat(tool, F.lit(":"), F.col("_pattern")), 1, MOST_PATTERN)
    rules = (
        F.when((name == "UserPromptSubmit") & (prompt != ""), row("source", F.lit("user"), "user_msg", prompt))
        .when(tool.isin(*WRITE_TOOLS), F.when((path != "") & (F.col("_written") != ""), row("artifact", path, None, F.col("_written"))))
        .when(tool == "Read", F.when((file != "") & (answer != ""), row("source", file, "file", answer)))  # a path is none
        .when(tool == "WebFetch", F.when(answer != "", row("source", F.coalesce("_url", F.lit("web")), "web", answer)))
        .when(searching, F.when(utf16_length(answer) > LEAST_RESULT, row("source", search_uri, "tool_result", answer)))
    )
    routed = event.select(*kept, "session_id", rules.alias("_r")).where("_r is not null")
    return routed.select(*kept, "session_id", "_r.*", F.when(F.col("_r.target") == "artifact", F.lit(generator)).alias("generator"))


def dedup_sources(sources: DataFrame, order: str = "seq") -> DataFrame:
    """First capture of each (content, session); a later uri or type of the same content is dropped.

    A group of copies is reduced before the shuffle, so one of any size is no hot task.
    """
    hashed = sources.withColumn("content_hash", content_hash(F.col("content")))
    rest = [c for c in hashed.columns if c not in ("content_hash", "session_id")]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_s")
    return hashed.groupBy("content_hash", "session_id").agg(first).select("_s.*", "content_hash", "session_id")


def version_artifacts(writes: DataFrame, order: str = "seq", width: int = 86_400) -> DataFrame:
    """Versions 1, 2, ... of each path: writes that repeat the path's latest content are skipped.

    ``order`` is a timestamp, unique within a path. A path's history is swept in buckets of
    ``width`` seconds: each starts with the last hash and the number of versions of those before.
    """
    hashed = writes.withColumn("content_hash", content_hash(F.col("content"))).withColumn(
        "_bucket", F.floor(F.unix_timestamp(order) / width)
    )
    ends = hashed.groupBy("path", "_bucket").agg(F.max_by("content_hash", order).alias("_end"))
    path = Window.partitionBy("path").orderBy("_bucket")
    carried = ends.select("path", "_bucket", F.lag("_end").over(path).alias("_carried"))
    inside = Window.partitionBy("path", "_bucket").orderBy(order)
    changed = (
        hashed.join(carried, ["path", "_bucket"])
        .withColumn("_last", F.coalesce(F.lag("content_hash").over(inside), F.col("_carried")))
        .where(F.col("_last").isNull() | (F.col("_last") != F.col("content_hash")))
    )
    before = Window.partitionBy("path").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = changed.groupBy("path", "_bucket").agg(F.count("*").alias("_n"))
    first = counts.select("path", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    numbered = changed.join(first, ["path", "_bucket"]).withColumn("version", F.col("_first") + F.row_number().over(inside))
    return numbered.drop("_bucket", "_carried", "_last", "_first")


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The row of each path's highest version."""
    rest = [c for c in artifacts.columns if c != "path"]
    return artifacts.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("_a")).select("path", "_a.*")
