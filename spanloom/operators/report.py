"""Reports on results: coverage, gate, attestation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numeric import ratio

STATUS = ("grounded", "uncertain", "ungrounded")


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUS]


def audit(results: DataFrame, by: list[str]) -> DataFrame:
    """Spans and their statuses for each group, with whole percentages."""
    sums = results.groupBy(*by).agg(F.count("*").alias("spans"), *status_counts())
    percents = [F.round(100 * ratio(F.col(s), F.col("spans")), 0).cast("bigint").alias(f"{s}_pct") for s in STATUS]
    return sums.select(*by, "spans", *STATUS, *percents)


def audit_text(path: str, results: DataFrame) -> str:
    """The report of one artifact: a coverage line, then a line for each span."""
    rows = results.orderBy("start_line").collect()  # the spans of one file
    size = max(1, len(rows))
    share = {s: f"{100 * sum(r['status'] == s for r in rows) / size:.0f}" for s in STATUS}
    head = f"{path}: {len(rows)} spans, " + ", ".join(f"{s} {share[s]} %" for s in STATUS)
    return "\n".join(
        [head, *(f"  {r['start_line']}-{r['end_line']} {r['status']} {r['source_uri'] or '-'} {r['confidence']:.2f}" for r in rows)]
    )


def gate(results: DataFrame, path: str = "path", budget: float = 30.0) -> DataFrame:
    """Whether each file's share of ungrounded spans exceeds the budget (in percent)."""
    sums = results.groupBy(path).agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "ungrounded").alias("ungrounded"))
    share = 100 * ratio(F.col("ungrounded"), F.col("spans"))
    return sums.select(path, "spans", "ungrounded", share.alias("ungrounded_pct"), (share > budget).alias("failed"))


def gate_failed(gated: DataFrame) -> bool:
    return bool(gated.agg(F.bool_or("failed").alias("f")).first()["f"])


def attestation_spans(results: DataFrame, path: str = "path") -> DataFrame:
    """For each file its coverage and the list of its spans by line, confidences to four decimals."""
    span = F.struct(
        "start_line", "end_line", "status", F.col("source_uri").alias("source"), F.round("confidence", 4).alias("confidence"), "method"
    )
    return results.groupBy(path).agg(F.count("*").alias("spans"), *status_counts(), F.array_sort(F.collect_list(span)).alias("details"))
