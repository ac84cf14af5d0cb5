"""Segmentation of artifacts into line spans, and of sources into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from spanloom.functions.text import SPACE, trimmed, utf16_length


STRETCH = 4096  # lines of a file that are one row


def _stretches(artifacts: DataFrame, key: list[str], content: str) -> DataFrame:
    """key, _b, _lines, _blank, _delta: each file's lines in rows of STRETCH, with what segmentation reads of a line."""
    split = artifacts.select(*key, F.explode(F.array(F.split(content, "\n", -1))).alias("_all"))
    last = F.size("_all") - 1
    lines = lambda i: F.transform(F.sequence(i, F.least(i + (STRETCH - 1), last)), lambda j: F.get("_all", j))
    cut_up = split.where("_all is not null").select(*key, F.posexplode(F.transform(F.sequence(F.lit(0), last, F.lit(STRETCH)), lines)).alias("_b", "_lines"))
    opens, closes = (lambda line, marks=marks: F.regexp_count(line, F.lit(marks)) for marks in (r"[{\[(]", r"[}\])]"))
    return cut_up.select(
        *key, "_b", "_lines", F.transform("_lines", lambda x: trimmed(x) == "").alias("_blank"),
        F.transform("_lines", lambda x: opens(x) - closes(x)).alias("_delta"),
    )


def _flushes(blank: np.ndarray, depth: np.ndarray, before: bool) -> np.ndarray:
    """Where a span ends: a blank line after one that is not, with no bracket open."""
    return blank & (depth <= 0) & ~np.concatenate([[before], blank[:-1]])


def _summaries(stretches: DataFrame, key: list[str]) -> DataFrame:
    """key, _b and what a stretch tells the next: its brackets, its last line, and the depths (from its start) at which spans may end.

    ``_first`` is the depth of the first line if it is blank: whether that ends a span the stretch before decides.
    """
    names = [*key, "_b", "_total", "_last", "_first", "_depths"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blank, delta in zip(batch.column("_blank"), batch.column("_delta"), strict=True):
                blank, depth = np.array(blank.as_py(), bool), np.cumsum(delta.as_py())
                inner = blank[1:] & ~blank[:-1]
                rows.append((int(depth[-1]), bool(blank[-1]), int(depth[0]) if blank[0] else None, depth[1:][inner].tolist()))
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "_b")), *found], names=names)

    fields = [*(stretches.schema[c] for c in (*key, "_b"))]
    more = [("_total", T.LongType()), ("_last", T.BooleanType()), ("_first", T.LongType()), ("_depths", T.ArrayType(T.LongType()))]
    return stretches.select(*key, "_b", "_blank", "_delta").mapInArrow(summed, T.StructType([*fields, *(T.StructField(n, t) for n, t in more)]))


def _pieces(stretches: DataFrame, key: list[str]) -> DataFrame:
    """key, gid, first, last, flushed, part: the lines of each span in one stretch; ``flushed`` if its last line is the blank that ends it."""
    names = [*key, "_gid", "_from", "_upto", "_flushed", "_part"]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                read = lambda c, n=n: batch.column(c)[n].as_py()  # noqa: B023, E731
                lines, blank, first = read("_lines"), np.array(read("_blank"), bool), read("_b") * STRETCH
                ends = np.flatnonzero(_flushes(blank, read("_depth") + np.cumsum(read("_delta")), read("_before"))).tolist()
                starts = [0, *(e + 1 for e in ends)]
                rows = [(read("_gids") + g, first + s, first + e, True, "\n".join(lines[s:e]) if e > s else None) for g, (s, e) in enumerate(zip(starts, ends, strict=False))]
                if starts[-1] < len(lines):
                    rows.append((read("_gids") + len(ends), first + starts[-1], first + len(lines) - 1, False, "\n".join(lines[starts[-1] :])))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                here = [batch.column(c).take(pa.array([n] * len(rows), pa.int64())) for c in key]
                yield pa.RecordBatch.from_arrays([*here, *found], names=names)

    fields = [*(stretches.schema[c] for c in key)]
    more = [("_gid", T.LongType()), ("_from", T.LongType()), ("_upto", T.LongType()), ("_flushed", T.BooleanType()), ("_part", T.StringType())]
    return stretches.mapInArrow(swept, T.StructType([*fields, *(T.StructField(n, t) for n, t in more)]))


def segment(artifacts: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """key, start_line, end_line, text of each span.

    A blank line ends a span if no bracket is open (brackets are counted in raw text and may go
    below zero) and the line before is not blank. The blank line is outside the span; a second one
    in a row is the start of the next, trimmed from its text. Spans without text are left out.

    A file is swept in stretches of STRETCH lines, each on its own: a first pass over marks of the lines tells each stretch the
    depth, the blank state and the number of spans that those before hand on (a window over one small row for each stretch);
    a second one cuts the lines. A file of any length is so many rows, and only spans that cross stretches are joined up.
    """
    stretches = _stretches(artifacts, key, content)
    before = Window.partitionBy(*key).orderBy("_b")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    handed = _summaries(stretches, key).withColumns({
        "_depth": F.coalesce(F.sum("_total").over(earlier), F.lit(0)), "_before": F.coalesce(F.lag("_last").over(before), F.lit(True)),
    })
    inner = F.size(F.filter("_depths", lambda d: d + F.col("_depth") <= 0))
    first = F.coalesce((~F.col("_before")) & (F.col("_first") + F.col("_depth") <= 0), F.lit(False)).cast("int")
    handed = handed.withColumn("_ends", inner + first).withColumn("_gids", F.coalesce(F.sum("_ends").over(earlier), F.lit(0)))
    same = [stretches[c].eqNullSafe(handed[c]) for c in (*key, "_b")]
    carried = stretches.join(handed, same).select(*[stretches[c] for c in stretches.columns], "_depth", "_before", "_gids")
    parts = F.array_sort(F.collect_list(F.struct("_from", "_part")))
    spans = _pieces(carried, key).groupBy(*key, "_gid").agg(
        (F.min("_from") + 1).alias("start_line"), (F.max("_upto") + 1 - F.max(F.col("_flushed").cast("int"))).alias("end_line"), parts.alias("_parts")
    )
    text = F.array_join(F.transform("_parts", lambda p: p["_part"]), "\n")
    return spans.select(*key, "start_line", "end_line", trimmed(text).alias("text")).where("text <> ''")


def units(content: Column, delimiters: str = ".\n;", least: int = 12) -> Column:
    """Trimmed sentence-like units longer than ``least`` UTF-16 units."""
    inside = delimiters.replace("\n", "\\n").replace(".", "\\.")
    parts = F.split(content, f"(?<=[{inside}]){SPACE}+", -1)
    return F.filter(F.transform(parts, trimmed), lambda u: utf16_length(u) > least)


def chunk(
    sources: DataFrame, key: list[str], content: str = "content", win: int = 2, least: int = 12,
    delimiters: str = ".\n;", fallback: bool = True,
) -> DataFrame:
    """key, chunk_ord, chunk: one window of ``win`` units from each unit on, joined by a blank.

    A source without units is one chunk, unless ``fallback`` is off.
    """
    found = sources.withColumn("_units", units(F.col(content), delimiters, least)).withColumn("_whole", F.col(content))
    windows = F.transform(F.col("_units"), lambda u, i: F.array_join(F.slice("_units", i + 1, win), " "))
    none = F.array(F.col("_whole")) if fallback else F.array().cast("array<string>")
    chosen = F.when(F.size("_units") > 0, windows).otherwise(none)
    return found.select(*key, F.posexplode(chosen).alias("chunk_ord", "chunk")).withColumn("chunk_ord", F.col("chunk_ord").cast("bigint"))


def segment_functions(artifacts: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """key, name, start_line, end_line, text of exported functions, each up to a line that is a brace."""
    lines = artifacts.select(*key, F.posexplode(F.split(content, "\n", -1)).alias("_i", "_line"))
    name = F.regexp_extract("_line", r"export function (\w+)", 1)
    order = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    closes = (trimmed(F.col("_line")) == "}").cast("int")
    marked = lines.withColumn("_name", F.when(name != "", name)).withColumn("_start", F.sum((name != "").cast("int")).over(order))
    marked = marked.where("_start > 0").withColumn("_closed", closes)
    part = Window.partitionBy(*key, "_start").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("_after", F.coalesce(F.sum("_closed").over(part), F.lit(0))).where("_after = 0")
    rows = F.array_sort(F.collect_list(F.struct("_i", "_line")))
    return inside.groupBy(*key, "_start").agg(
        F.max("_name").alias("name"), (F.min("_i") + 1).cast("bigint").alias("start_line"), (F.max("_i") + 1).cast("bigint").alias("end_line"),
        F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias("text"),
    ).drop("_start")
