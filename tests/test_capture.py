import json

from pyspark.sql import functions as F

from spanloom.operators import capture


def routed(spark, *events):
    raws = [(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    rows = capture.route(spark.createDataFrame(raws, "n int, raw string")).orderBy("n").collect()
    return {r["n"]: (r["target"], r["uri"], r["type"], r["content"], r["session_id"]) for r in rows}


def test_every_branch_of_the_router(spark):
    tool = lambda name, i=None, r=None, **more: {"session_id": "s", "tool_name": name, "tool_input": i or {}, "tool_response": r, **more}
    found = routed(
        spark,
        {"hook_event_name": "UserPromptSubmit", "prompt": "hello"},
        {"hook_event_name": "UserPromptSubmit", "prompt": ""},
        tool("Write", {"file_path": "a.ts", "content": "x"}),
        tool("Edit", {"content": "x"}),
        tool("MultiEdit", {"path": "b.ts", "content": "y"}),
        tool("Read", {"file_path": "c.md"}, {"content": "body"}),
        tool("Read", {}, "body"),
        tool("WebFetch", {}, "page"),
        tool("Grep", {"pattern": "p"}, "x" * 20),
        tool("Grep", {"pattern": "p"}, "x" * 21),
        tool("mcp__x", {}, "y" * 30),
        tool("Other", {}, "y" * 30),
        "{broken",
        "  ",
        tool("Glob", {"pattern": "q" * 300}, "z" * 21),
    )
    assert found == {
        0: ("source", "user", "user_msg", "hello", "unknown"),
        2: ("artifact", "a.ts", None, "x", "s"),
        4: ("artifact", "b.ts", None, "y", "s"),
        5: ("source", "c.md", "file", "body", "s"),
        7: ("source", "web", "web", "page", "s"),
        9: ("source", "Grep:p", "tool_result", "x" * 21, "s"),
        10: ("source", "mcp__x:", "tool_result", "y" * 30, "s"),
        14: ("source", ("Glob:" + "q" * 300)[:200], "tool_result", "z" * 21, "s"),
    }


def test_first_capture_wins_within_a_session(spark):
    rows = [(1, "u1", "same", "s1"), (2, "u2", "same", "s1"), (3, "u3", "same", "s2"), (4, "u4", "other", "s1")]
    found = capture.dedup_sources(spark.createDataFrame(rows, "seq int, uri string, content string, session_id string")).collect()
    assert sorted(r["uri"] for r in found) == ["u1", "u3", "u4"]


def test_versions_skip_repeats_and_cross_buckets(spark):
    contents = ["a", "a", "b", "b", "a", "c", "c", "c", "b"]
    rows = [("p", c, i * 50) for i, c in enumerate(contents)] + [("q", "a", 10)]
    df = spark.createDataFrame(rows, "path string, content string, t bigint").withColumn("seq", F.timestamp_seconds("t"))
    for width in (60, 100, 86_400):
        found = capture.version_artifacts(df, width=width).orderBy("path", "version").collect()
        assert [(r["path"], r["t"], r["version"]) for r in found] == [("p", 0, 1), ("p", 100, 2), ("p", 200, 3), ("p", 250, 4), ("p", 400, 5), ("q", 10, 1)]
    latest = {r["path"]: r["version"] for r in capture.latest_artifacts(found and capture.version_artifacts(df)).collect()}
    assert latest == {"p": 5, "q": 1}


def test_a_read_needs_a_file(spark):
    rows = [
        (1, '{"tool_name":"Read","tool_input":{"path":"p.md"},"tool_response":"text"}'),
        (2, '{"tool_name":"Read","tool_input":{"file_path":"f.md","path":"p.md"},"tool_response":"text"}'),
        (3, '{"tool_name":"Edit","tool_input":{"path":"p.md","content":"c"}}'),
    ]
    found = capture.route(spark.createDataFrame(rows, "seq bigint, raw string")).collect()
    assert {(r["seq"], r["target"], r["uri"]) for r in found} == {(2, "source", "f.md"), (3, "artifact", "p.md")}


def test_written_files_go_before_the_event(spark, tmp_path):
    from spanloom.sources.events import read_written, with_written

    (tmp_path / "a.py").write_text("after")
    lines = [
        '{"tool_name":"Edit","tool_input":{"file_path":"%s","content":"before"}}' % (tmp_path / "a.py"),
        '{"tool_name":"Write","tool_input":{"path":"/no/such/file","content":"own"}}',
        '{"tool_name":"Read","tool_input":{"file_path":"%s"},"tool_response":"r"}' % (tmp_path / "a.py"),
        "no json", "[1]",
    ]
    here = read_written(lines)
    assert [t for _, t in here] == ["after", None, None, None, None]
    files = spark.createDataFrame([(str(tmp_path / "a.py"), "after")], "path string, content string")
    joined = with_written(spark.createDataFrame([(x,) for x in lines], "raw string"), files)
    for df in (spark.createDataFrame(here, "raw string, resolved_content string"), joined):
        found = {(r["target"], r["content"]) for r in capture.route(df).collect()}
        assert found == {("artifact", "after"), ("artifact", "own"), ("source", "r")}


def test_dataset_files(tmp_path):
    from spanloom.sources.datasets import dataset_files

    (tmp_path / "d.json").write_text("{}")
    held = str(tmp_path / "d.json")
    assert dataset_files(["x.json", "-v", "y.txt"], [held]) == ["x.json"]
    assert dataset_files(["-v"], [held, str(tmp_path / "none.json")]) == [held]


def test_judges_are_chosen_and_wait(spark):
    from spanloom.operators import judge

    yes, no = (lambda q: '{"derived": true}'), (lambda q: '{"derived": false}')
    assert judge.choose({}).available is False and judge.choose({"a": yes}, "b").available is False
    assert judge.choose({"a": yes, "b": no}).transport is yes and judge.choose({"a": yes, "b": no}, "b").transport is no
    waits, answers = [], [judge.RateLimited(), judge.RateLimited(1.0), judge.RateLimited(90.0), '{"derived": true, "evidence": "e"}']

    def transport(question):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert judge.ask(transport, "q", waits.append) == (True, "e", True)
    assert waits == [4.0, 8.0, 90.5]
