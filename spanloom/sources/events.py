"""Readers of tool events and of plain files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.capture import WRITE_TOOLS


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event to a line, as ``raw``; blank lines are left out, malformed ones by the router."""
    return spark.read.text(path).select(F.col("value").alias("raw")).where(F.trim("raw") != "")


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.col("value").alias("raw")).where(F.trim("raw") != "")


def with_written(events: DataFrame, files: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``resolved_content``: the text of the file that a write names, as ``files`` (path, content) has it after the event."""
    named = F.coalesce(F.get_json_object(raw, "$.tool_input.file_path"), F.get_json_object(raw, "$.tool_input.path"))
    writes = F.get_json_object(raw, "$.tool_name").isin(*WRITE_TOOLS)
    found = files.groupBy("path").agg(F.max("content").alias("resolved_content")).withColumnRenamed("path", "_path")
    return events.withColumn("_named", F.when(writes, named)).join(found, F.col("_named") == F.col("_path"), "left").drop("_named", "_path")


def read_written(lines: list[str]) -> list[tuple[str, str | None]]:
    """Each event with the text its write left on this machine's disk, null where there is none."""
    out = []
    for line in lines:
        try:
            event = json.loads(line)
            asked = event["tool_input"] if event.get("tool_name") in WRITE_TOOLS else {}
            with open(asked.get("file_path") or asked["path"], encoding="utf-8") as file:
                out.append((line, file.read()))
        except (ValueError, KeyError, TypeError, AttributeError, OSError):
            out.append((line, None))
    return out


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, content of whole text files, such as a folder of Markdown sources or written artifacts."""
    rows = spark.read.option("wholetext", True).text(pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """fn, expected, reason of a file of labelled functions."""
    rows = spark.read.schema("spans array<struct<fn:string,expected:string,reason:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("spans").alias("s")).select("s.*")
