"""What a user of the engine calls: capture, queries, reports and attestations over one store."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.lineage import cut
from spanloom.functions.text import line_slice, preview
from spanloom.operators import attest, capture, graph, report
from spanloom.operators.judge import Judge
from spanloom.plans.attribute import attribute
from spanloom.schema import FLOOR, HIGH, JUDGE_K, LOW
from spanloom.sources.events import read_events
from spanloom.sources.store import DEFAULT, Store

NO_LINKS = "No attribution for this line yet."


class Lineage:
    def __init__(self, spark: SparkSession, path: str | None = None, judge: Judge | None = None, clock=lambda: datetime.now(UTC)):
        self.spark, self.store, self.judge, self.clock = spark, Store(spark, path), judge, clock

    # capture

    def capture(self, events: DataFrame | str) -> dict[str, int]:
        """Stores the sources and artifacts of raw events (a DataFrame with ``raw``, or a path of JSON lines).

        Rows are taken in the order of the column ``seq``, if there is one, else of the lines.
        """
        rows = read_events(self.spark, events) if isinstance(events, str) else events
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.monotonically_increasing_id())
        routed = cut(capture.route(rows))
        at = F.lit(self.clock()).cast("timestamp")
        moment = F.timestamp_micros(F.unix_micros(at) + F.col("seq"))  # distinct, in the order of capture
        sources = routed.where("target = 'source'").withColumn("captured_at", moment)
        writes = routed.where("target = 'artifact'").withColumns({"path": F.col("uri"), "created_at": moment})
        return {"sources": self.store.add_sources(sources).count(), "artifacts": self.store.add_artifacts(writes).count()}

    # queries

    def status(self) -> dict[str, int]:
        return self.store.counts().first().asDict()

    def sources(self, session_id: str | None = None, size: int = 80) -> DataFrame:
        rows = self.store.all_sources() if session_id is None else self.store.sources_for_session(session_id)
        return rows.select("id", "uri", "type", "captured_at", "session_id", preview(F.col("content"), size).alias("preview"))

    def cite(self, path: str, start_line: int, end_line: int, source_uri: str, evidence: str | None = None) -> dict:
        """Declares the source of some lines; ok is false if the path has no artifact."""
        if not 1 <= start_line or not 1 <= end_line:
            raise ValueError("lines count from 1")
        row = [(path, start_line, end_line, source_uri, evidence)]
        schema = "path string, start_line bigint, end_line bigint, source_uri string, evidence string"
        found = self.store.cite(self.spark.createDataFrame(row, schema)).first()
        return {"ok": found["ok"], "reason": found["reason"]}

    def lines(self, path: str, start_line: int, end_line: int) -> str | None:
        """The text of some lines of the latest artifact."""
        row = self.store.latest_artifact(path).select(line_slice(F.col("content"), F.lit(start_line), F.lit(end_line)).alias("t")).first()
        return row["t"] if row else None

    def why(self, path: str, line: int) -> DataFrame:
        asked = self.spark.createDataFrame([(path, line)], "path string, line bigint")
        t = self.store.table
        return graph.why(asked, t("artifact"), t("span"), t("link"), t("source")).orderBy(F.desc("confidence"))

    def why_text(self, path: str, line: int) -> str:
        rows = self.why(path, line).collect()  # the links of one line
        if not rows:
            return NO_LINKS
        return "\n".join(
            f"{r['uri'] or '(no source)'} [{r['type'] or '?'}] {r['confidence']:.2f} {r['method']}" + (f': "{r["evidence_quote"]}"' if r["evidence_quote"] else "")
            for r in rows
        )

    def attribution_for(self, paths: list[str]) -> DataFrame:
        t = self.store.table
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return graph.attribution_for(asked, t("artifact"), t("span"), t("link"), t("source")).orderBy("path", "start_line")

    # attribution and reports

    def attribute(
        self, paths: list[str] | None = None, session_id: str | None = None, use_judge: bool = False, high: float = HIGH, low: float = LOW,
        floor: float = FLOOR, judge_k: int = JUDGE_K, persist: bool = True,
    ) -> DataFrame:
        """Results of the latest artifacts of these paths (of all, if None), from one session's sources or all."""
        artifacts = self.store.table("artifact")
        if paths is not None:
            artifacts = artifacts.where(F.col("path").isin(*paths))
        latest = capture.latest_artifacts(artifacts)
        pool = self.store.table("source")
        if session_id is not None:
            pool = pool.where(F.col("session_id") == session_id)
        sources = pool.select(F.col("id").alias("source_id"), "uri", F.col("id").alias("uri_ord"), "content", "session_id")
        judge = self.judge if use_judge else None
        found = attribute(latest.select("path", "content", "session_id"), sources, judge, high, low, floor, judge_k, session_scoped=False)
        ids = latest.select("path", F.col("id").alias("artifact_id"), "content_hash")
        results = cut(found.join(ids, "path"))
        if persist:
            self.store.write_attribution(results, ids)
        return results

    def audit(self, path: str, use_judge: bool = False) -> str | None:
        """The report of one file, or None if it was never captured."""
        if not self.store.latest_artifact(path).take(1):
            return None
        return report.audit_text(path, self.attribute([path], use_judge=use_judge))

    def gate(self, paths: list[str], budget: float = 30.0) -> DataFrame:
        """Verdict of each file that was captured; the others are left out."""
        return report.gate(self.attribute(paths), budget=budget)

    def export(self, path: str, to: str | None = None) -> dict | None:
        """A signed attestation of one file, written to ``to`` if given."""
        rows = [r.asDict() for r in self.attribute([path]).collect()]  # one file's spans
        if not rows:
            return None
        at = self.clock().strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        signed = self._signer().sign(attest.build_attestation(path, rows[0]["content_hash"], rows, at))
        if to:
            attest.write_attestation(signed, to)
        return signed

    def verify(self, document: dict | str) -> bool:
        return self._signer().verify(attest.read_attestation(document) if isinstance(document, str) else document)

    def _signer(self) -> attest.Signer:
        # keys stay on this machine, wherever the store is
        beside = DEFAULT if "://" in self.store.path else self.store.path
        return attest.Signer(self.spark, str(Path(beside).parent / "keys"))

    def reset(self) -> None:
        self.store.reset()
