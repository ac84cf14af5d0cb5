"""Streams: the same result however rows are cut into micro-batches, and state that stays bounded."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import capture

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
WRITES = "event_id bigint, path string, content string, seq timestamp"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def versions(rows):
    last, out = {}, []
    for event, path, content, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        before, version = last.get(path, (None, 0))
        if content != before:
            last[path] = (content, version + 1)
            out.append((event, path, version + 1))
    return sorted(out)


@pytest.fixture
def rows():
    rng = random.Random(1)
    return [(n, f"p{rng.randint(0, 4)}", rng.choice("ab"), at(n)) for n in range(200)]


def run(spark, root, slices):
    capture.typed_state(spark)
    found = capture.stream_of_slices([spark.createDataFrame(s, WRITES) for s in slices], lambda s: capture.version_stream(s, "30 minutes"), root)
    return sorted((r["event_id"], r["path"], r["version"]) for r in found.collect())


END = (-1, "", "", at(10_000))


def test_versions_in_one_and_in_many_micro_batches(spark, tmp_path, rows):
    assert run(spark, str(tmp_path / "one"), [[*rows, END]]) == versions(rows)
    # each row up to twenty minutes late, the stream started again for each slice
    late = sorted(rows, key=lambda r: r[3] + datetime.timedelta(minutes=r[0] % 3 * 10))
    slices = [late[n : n + 70] for n in range(0, 200, 70)]
    assert run(spark, str(tmp_path / "many"), [*slices, [END]]) == versions(rows)
    state = {r["path"]: r["version"] for r in capture.version_state(spark, str(tmp_path / "many" / "state")).collect()}
    assert state == {p: max(v for _, q, v in versions(rows) if q == p) for p in {r[1] for r in rows}}
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "many" / "state")).option("stateVarName", "waiting").option("flattenCollectionTypes", True).load()
    assert waiting.count() <= 1  # that of the last row alone


def test_a_write_later_than_the_delay_is_left_out(spark, tmp_path):
    first = [(1, "p", "a", at(0)), (2, "p", "b", at(100))]
    found = run(spark, str(tmp_path), [first, [(3, "p", "late", at(20)), (4, "p", "c", at(90)), END]])
    assert found == [(1, "p", 1), (2, "p", 3), (4, "p", 2)]


def test_a_path_takes_rows_not_frames():
    """A path's few writes come as rows: no data frame is made for each path and micro-batch."""
    from pyspark.sql import Row

    class Held:
        def __init__(self):
            self.rows, self.timers = [], []

        def getValueState(self, name, schema):
            return self

        getListState = getValueState

        def appendList(self, rows):
            self.rows += rows

        def registerTimer(self, at):
            self.timers.append(at)

    held, path = Held(), capture.PathVersions()
    path.init(held)
    assert list(path.handleInputRows(("p",), iter([Row(at=2000, event_id=1, content_hash="a"), Row(at=1001, event_id=2, content_hash="b")]), None)) == []
    assert held.rows == [(2000, 1, "a"), (1001, 2, "b")] and held.timers == [2]


def test_state_of_deduplication_is_bounded(spark, tmp_path):
    slices = [spark.createDataFrame([(f"c{day}-{n}", "s", at(day * 1440)) for n in range(50)] * 2, "content string, session_id string, at timestamp") for day in range(6)]
    plan = lambda s: capture.dedup_stream(s, ("at", "1 day"))
    found = capture.stream_of_slices(slices, plan, str(tmp_path))
    assert found.count() == 300
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).load().count()
    assert held <= 150  # of 300 keys: those of the days that a repetition may still come for


# --- hook events as a source -----------------------------------------------------------------


def lines(path, rows):
    with open(path, "w", encoding="utf-8") as file:
        for row in rows:
            file.write(row + "\n")


def event(n, **more):
    return json.dumps({"session_id": f"s{n % 3}", "tool_name": ["Read", "Write"][n % 2], "tool_input": {"file_path": f"é{n}"}} | more, ensure_ascii=False)


def test_events_are_read_in_ranges(spark, tmp_path):
    from spanloom.sources import hook

    hook.register(spark)
    given = [event(n) for n in range(500)]
    lines(tmp_path / "a.jsonl", [*given[:300], "", "   ", "{broken", "[1]", "7"])
    (tmp_path / "b.jsonl").write_text("\n".join(given[300:]), encoding="utf-8")  # no newline at the end
    (tmp_path / "none.jsonl").write_text("")
    for size in (1, 100, 1 << 20):
        read = spark.read.format("hook_events").option("range_bytes", size if size > 1 else 64).load(str(tmp_path))
        assert sorted(r["raw"] for r in read.collect()) == sorted(given)
    few = spark.read.format("hook_events").load(str(tmp_path)).where("tool_name = 'Write' and session_id in ('s1', 's2') and raw like '%1%'")
    want = [g for n, g in enumerate(given) if n % 2 and n % 3 and "1" in g]
    assert sorted(r["raw"] for r in few.select("raw").collect()) == sorted(want)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" not in plan or "tool_name" in plan
    one = spark.read.format("hook_events").load(str(tmp_path / "b.jsonl"))
    assert one.count() == 200 and one.where("tool_name = 'Read'").select("session_id").distinct().count() == 3


def test_events_as_a_stream(spark, tmp_path):
    from spanloom.sources import hook

    hook.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    given = [event(n) for n in range(60)]

    def go():
        stream = spark.readStream.format("hook_events").load(str(folder)).select("raw", "file")
        capture.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r["raw"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    lines(folder / "a.jsonl", given[:20])
    assert go() == sorted(given[:20])
    with open(folder / "a.jsonl", "a", encoding="utf-8") as file:  # a file grows, its last line is not whole yet
        file.write("\n".join(given[20:30]) + "\n" + given[30][:10])
    lines(folder / "b.jsonl", given[31:50])
    assert go() == sorted([*given[:30], *given[31:50]])
    with open(folder / "a.jsonl", "a", encoding="utf-8") as file:
        file.write(given[30][10:] + "\n")
    lines(folder / "c.jsonl", given[50:])
    assert go() == sorted(given)
    assert go() == sorted(given)  # nothing new


def test_route_of_events_from_the_source(spark, tmp_path):
    from spanloom.operators.capture import route
    from spanloom.sources import hook

    hook.register(spark)
    lines(tmp_path / "a.jsonl", [event(0, tool_response="text"), event(1, tool_input={"file_path": "f", "content": "x"}), "{"])
    routed = route(spark.read.format("hook_events").load(str(tmp_path)).select("raw", F.col("place")))
    assert sorted((r["target"], r["content"]) for r in routed.collect()) == [("artifact", "x"), ("source", "text")]
