"""Table schemas and the values of enumerated columns."""

from __future__ import annotations

SOURCE_TYPES = ("file", "web", "tool_result", "user_msg", "conversation")
STATUSES = ("grounded", "uncertain", "ungrounded")
METHODS = ("declared", "embedding", "llm_judge")

# Default thresholds: fixed values of the decision rule.
HIGH, LOW, FLOOR = 0.45, 0.30, 0.10
TOP_CANDIDATES, JUDGE_K, ORACLE_K = 5, 3, 5

SOURCE = "id bigint, uri string, type string, content string, content_hash string, captured_at timestamp, session_id string"
ARTIFACT = (
    "id bigint, path string, content string, content_hash string, version bigint, created_at timestamp,"
    " generator string, session_id string"
)
SPAN = "id bigint, artifact_id bigint, start_line bigint, end_line bigint, text string, kind string"
LINK = (
    "id bigint, span_id bigint, source_id bigint, confidence double, method string, evidence_quote string,"
    " created_at timestamp, status string"
)
EMBEDDING = "content_hash string, vec array<float>"
TABLES = {"source": SOURCE, "artifact": ARTIFACT, "span": SPAN, "link": LINK, "embedding": EMBEDDING}
