"""One signature for many reports, the environment's judge, readers of the small benchmark as one flow."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import attest, evaluate, judge, segment, similarity
from spanloom.sources.events import read_files, read_truth

RESULTS = "path string, start_line bigint, end_line bigint, status string, source_uri string, confidence double, method string"


def results(spark, files):
    rows = [(f"f{i}", 1 + 2 * k, 2 + 2 * k, ["grounded", "ungrounded"][k % 2], None if k % 2 else "u", 0.51239, "embedding") for i in range(files) for k in range(1 + i % 3)]
    return spark.createDataFrame(rows, RESULTS)


@pytest.mark.parametrize("files", [0, 1, 5, 30])
def test_one_signature_vouches_for_every_report(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(attest, "FAN", 3)  # a tree of several levels
    signer = attest.Signer(spark, str(tmp_path))
    rows, document = attest.attest_all(results(spark, files), "now", signer)
    assert rows.count() == files == document["reports"]
    held = {r["path"]: json.loads(r["report"]) for r in rows.collect()}
    assert all(h["coverage"]["total"] == len(h["spans"]) and h["spans"][0]["confidence"] == 0.5124 for h in held.values())
    valid = lambda given, doc=document: [r["valid"] for r in attest.verify_all(given, doc, signer).orderBy("path").collect()]
    assert valid(rows) == [True] * files
    if files < 2:
        return
    one = rows.withColumn("report", F.when(F.col("path") == "f1", F.concat("report", F.lit(" "))).otherwise(F.col("report")))
    assert valid(one).count(False) == 1
    assert not any(valid(one.withColumn("digest", F.sha2("report", 256))))  # with its digest made to fit, the root does not
    assert not any(valid(rows.where("path <> 'f1'"))) and not any(valid(rows.union(rows.limit(1))))
    assert not any(valid(rows, document | {"root": "0" * 64})) and not any(valid(rows, {k: v for k, v in document.items() if k != "signature"}))


def test_the_environment_chooses_the_judge(monkeypatch):
    asked = {"one": lambda q: '{"derived": true}', "two": lambda q: "{}"}
    assert judge.choose(asked).transport is asked["one"] and judge.choose(asked).spacing == judge.SPACING_S
    monkeypatch.setenv(judge.SERVICE, "two")
    monkeypatch.setenv(judge.SPACING, "250")
    chosen = judge.choose(asked)
    assert chosen.transport is asked["two"] and chosen.spacing == 0.25
    assert judge.choose(asked, "one", spacing=0).spacing == 0 and judge.choose(asked, "one").transport is asked["one"]
    monkeypatch.setenv(judge.SERVICE, "none")
    assert isinstance(judge.choose(asked), judge.NoJudge) and not judge.choose(asked).available
    question = judge.prompt("SPAN", "SOURCE")
    assert question.index("SOURCE") < question.index("SPAN") and '"derived"' in question


def test_small_benchmark_from_files_to_rates(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("Sessions expire after thirty minutes of idle time. Tokens are rotated on every refresh.")
    (tmp_path / "docs" / "b.md").write_text("Invoices are sent on the first day of each month by post.")
    code = (
        "export function expire() {\n  // sessions expire after thirty minutes of idle time\n}\n\n"
        "export function bill() {\n  // invoices are sent on the first day of each month\n}\n\nexport function add(a) {\n  return a\n}\n"
    )
    (tmp_path / "code.ts").write_text(code)
    truth = {"spans": [{"fn": n, "expected": e, "reason": "r"} for n, e in (("expire", "a.md"), ("bill", "b.md"), ("add", "UNGROUNDED"))]}
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=1))
    name = F.element_at(F.split("path", "/"), -1)
    sources = read_files(spark, str(tmp_path / "docs" / "*.md")).select(name.alias("uri"), "content")
    spans = segment.segment_functions(read_files(spark, str(tmp_path / "code.ts")).select(name.alias("path"), "content"), ["path"])
    chunks = segment.chunk(sources, ["uri"], least=15, delimiters=".\n", fallback=False)
    scores = similarity.sparse_scores(
        spans.select(F.lit("*").alias("scope"), "name", "text"), chunks.select(F.lit("*").alias("scope"), "uri", F.lit(0).alias("uri_ord"), "chunk_ord", "chunk"),
        ["scope"], ["name"], ["uri", "uri_ord", "chunk_ord"],
    )
    best = similarity.rank(similarity.best_per_source(scores, ["name"], order=("uri_ord", "chunk_ord")), ["name"], ["uri"], 1)
    expected = evaluate.with_truth(spans.select("name"), read_truth(spark, str(tmp_path / "truth.json")).withColumnRenamed("fn", "name"))
    records = expected.join(best.select("name", F.col("uri").alias("source"), "sim"), "name", "left").withColumns({"sim": F.coalesce("sim", F.lit(0.0)), "set": F.lit("all")})
    assert tuple(evaluate.retrieval_metrics(records, ["set"]).first()) == ("all", 1.0, 1.0)
