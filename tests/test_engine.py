import json
import stat
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spanloom import __main__ as command
from spanloom.api import NO_LINKS, Lineage
from spanloom.functions.ids import allocate_ids
from spanloom.operators import decide, evaluate
from spanloom.operators.embed import HashingEmbedder
from spanloom.operators.judge import CallableJudge, NoJudge, RateLimited, ask, parse_reply
from spanloom.operators.similarity import embed_cache_misses, embed_with_cache
from spanloom.plans.attribute import attribute
from spanloom.schema import EMBEDDING
from spanloom.sources import datasets

SPEC = "Sessions expire after thirty minutes of idle time. Tokens are rotated on every refresh request."
CODE = "sessions expire after thirty minutes of idle time\n\nunrelated words about gardening tools\n"


def event(tool, given, response=None, session="s1"):
    return json.dumps({"session_id": session, "tool_name": tool, "tool_input": given, "tool_response": response})


@pytest.fixture
def lineage(spark, tmp_path):
    own = Lineage(spark, str(tmp_path / "x/store"), clock=lambda: datetime(2026, 1, 1, tzinfo=UTC))
    raws = [
        event("Read", {"file_path": "spec.md"}, SPEC), event("Read", {"file_path": "again.md"}, SPEC),
        event("Write", {"file_path": "a.ts", "content": CODE}), event("Write", {"file_path": "a.ts", "content": CODE}),
    ]
    assert own.capture(spark.createDataFrame(list(enumerate(raws)), "seq bigint, raw string")) == {"sources": 1, "artifacts": 1}
    return own


def test_capture_again_adds_only_what_is_new(spark, lineage):
    raws = [event("Read", {"file_path": "spec.md"}, SPEC), event("Write", {"file_path": "a.ts", "content": CODE}), event("Write", {"file_path": "a.ts", "content": "new"})]
    assert lineage.capture(spark.createDataFrame(list(enumerate(raws)), "seq bigint, raw string")) == {"sources": 0, "artifacts": 1}
    assert lineage.store.latest_artifact("a.ts").first()["version"] == 2
    assert lineage.status() == {"sources": 1, "artifacts": 2, "links": 0}
    assert lineage.lines("a.ts", 1, 5) == "new"


def test_attribution_citation_and_why(lineage):
    assert lineage.why_text("a.ts", 1) == NO_LINKS
    assert lineage.cite("a.ts", 1, 1, "spec.md", "said so") == {"ok": True, "reason": None}
    assert lineage.cite("none.ts", 1, 1, "spec.md") == {"ok": False, "reason": "no artifact"}
    assert lineage.cite("a.ts", 3, 3, "nowhere")["reason"] == "unknown source"
    rows = lineage.attribute().orderBy("start_line").collect()
    assert [(r["status"], r["source_uri"]) for r in rows] == [("grounded", "spec.md"), ("ungrounded", None)]
    lineage.attribute()  # again: computed links are replaced, declared ones survive
    found = lineage.why("a.ts", 1).collect()
    assert [(r["method"], r["uri"]) for r in found] == [("declared", "spec.md"), ("embedding", "spec.md")]
    assert lineage.status()["links"] == 4
    assert lineage.why("a.ts", 99).count() == 0
    assert "2 spans, grounded 50 %" in lineage.audit("a.ts")
    assert lineage.audit("b.ts") is None


def test_gate_export_verify(lineage, tmp_path):
    assert [r["failed"] for r in lineage.gate(["a.ts", "missing"], 50).collect()] == [False]
    assert [r["failed"] for r in lineage.gate(["a.ts"], 49).collect()] == [True]
    signed = lineage.export("a.ts", str(tmp_path / "a.json"))
    assert lineage.verify(str(tmp_path / "a.json")) and lineage.verify(signed)
    assert not lineage.verify(signed | {"coverage": {}}) and not lineage.verify({k: v for k, v in signed.items() if k != "signature"})
    key = lineage._signer().private
    assert stat.S_IMODE(key.stat().st_mode) == 0o600
    parse = command.parser().parse_args
    assert command.run(lineage, parse(["gate", "a.ts", "--max-ungrounded", "10"])) == 1
    assert command.run(lineage, parse(["gate", "a.ts", "--max-ungrounded", "90"])) == 0
    (tmp_path / "bad.json").write_text(json.dumps(signed | {"path": "other"}))
    assert command.run(lineage, parse(["verify", str(tmp_path / "bad.json")])) == 1
    for line in (["status"], ["sources"], ["audit", "a.ts"], ["why", "a.ts", "1"], ["export", "a.ts"], ["reset"]):
        assert command.run(lineage, parse(line)) == 0


def test_judges(spark):
    assert parse_reply('x {"derived": true, "evidence": "e"} y') == (True, "e")
    assert parse_reply('{"derived": "false"}') == (False, "") == parse_reply("none") == parse_reply("{bad}")
    waits = []

    def busy(_):
        if len(waits) < 2:
            raise RateLimited()
        return '{"derived": true}'

    assert ask(busy, "q", waits.append) == (True, "", True) and waits == [4.0, 8.0]

    def daily(_):
        raise RateLimited(daily=True)

    assert ask(daily, "q", waits.append) == (False, "", False)
    assert ask(lambda _: 1 / 0, "q") == (False, "", False)
    pairs = spark.createDataFrame([("a", "b")], "span_text string, source_text string")
    judged = CallableJudge(lambda q: '{"derived": true, "evidence": "b"}', spacing=0).verdicts(pairs).first()
    assert (judged["derived"], judged["evidence"], judged["judge_available"]) == (True, "b", True)
    assert NoJudge().verdicts(pairs).first()["judge_available"] is False


def test_thresholds(spark):
    rows = spark.createDataFrame([(0.45,), (0.449,), (0.30,), (0.299,), (-1.0,)], "sim double")
    found = [r["s"] for r in rows.select(decide.status_by_thresholds(F.col("sim")).alias("s")).collect()]
    assert found == ["grounded", "uncertain", "uncertain", "ungrounded", "ungrounded"]
    grid = evaluate.threshold_grid()
    assert len(grid) == 25 and grid[-1] == 0.4400000000000002


def test_datasets_merge_and_align(spark, tmp_path):
    one = {
        "description": "", "sources": [{"uri": "a", "type": "file", "content": "A"}, {"uri": "b", "type": "web", "content": "B"}],
        "artifacts": [{"path": "x.ts", "content": "alpha\n\nbeta", "spans": [{"find": "bet", "expected": "a"}, {"find": "zzz", "expected": "UNGROUNDED"}]}],
    }
    two = {"description": "", "sources": [{"uri": "a", "type": "file", "content": "other"}], "artifacts": []}
    paths = []
    for k, body in enumerate((one, two)):
        paths.append(str(tmp_path / f"{k}.json"))
        (tmp_path / f"{k}.json").write_text(json.dumps(body, indent=1))
    sources, artifacts, labels = datasets.merge([datasets.read_dataset(spark, p) for p in paths])
    assert {r["uri"]: r["content"] for r in sources.collect()} == {"a": "A", "b": "B"}
    assert artifacts.count() == 1
    spans = spark.createDataFrame([("x.ts", 1, "alpha", 0.1), ("x.ts", 3, "beta", 0.7)], "path string, start_line bigint, text string, sim double")
    found = {r["find"]: (r["start_line"], r["sim"]) for r in evaluate.align(labels, spans).collect()}
    assert found == {"bet": (3, 0.7), "zzz": (None, 0.0)}


def test_ids_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(7)
    found = allocate_ids(rows, ["v"], first=5).collect()
    assert sorted((r["id"], r["v"]) for r in found) == [(5 + k, k) for k in range(1000)]


def test_dense_attribution_with_a_cache(spark):
    artifacts = spark.createDataFrame([("a.ts", CODE, "s1")], "path string, content string, session_id string")
    sources = spark.createDataFrame([(1, "spec.md", 1, SPEC, "s1")], "source_id bigint, uri string, uri_ord bigint, content string, session_id string")
    first = HashingEmbedder(64)
    rows = attribute(artifacts, sources, embedder=first, low=0.3).orderBy("start_line").collect()
    assert [(r["status"], r["source_uri"]) for r in rows] == [("grounded", "spec.md"), ("ungrounded", None)]

    class Counting(HashingEmbedder):
        def transform(self, texts):
            self.asked = texts.count()
            return super().transform(texts)

    texts = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    cache = first.transform(embed_cache_misses(texts.where("text = 'x'"), spark.createDataFrame([], EMBEDDING)))
    counting = Counting(64)
    assert embed_with_cache(texts, cache, counting.transform).count() == 2 and counting.asked == 1
