import random

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.numeric import fixed
from spanloom.operators import segment


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_trim_and_lengths(spark):
    assert one(spark, T.trimmed(F.col("t")), t=" \t a b ﻿\n") == "a b"
    assert one(spark, T.utf16_length(F.col("t")), t="a😀") == 3
    assert one(spark, T.preview(F.col("t"), 5), t="a \n b\tc d") == "a b c"
    assert one(spark, T.line_slice(F.col("t"), F.lit(2), F.lit(9)), t="a\nb\nc") == "b\nc"
    assert fixed(1.005, 2) == 1.0


def test_as_text(spark):
    cases = {
        "null": "", '"s"': "s", '{"text":"t","content":"c"}': "c", '{"content":1,"stdout":"o"}': "o", '{"b":1,"a":2}': '{"b":1,"a":2}', "[1,2]": "[1,2]", "7": "7",
    }
    for raw, expected in cases.items():
        assert one(spark, T.as_text(F.col("t")), t=raw) == expected
    assert one(spark, T.as_text(F.col("t")), t=None) == ""


def test_split_hash(spark):
    def brute(name):
        h = 0
        for c in name:
            h = (h * 31 + ord(c)) % 2**32
        return h

    for name in ("src/auth.ts", "", "é ü", "a" * 50):
        assert one(spark, T.split_hash(F.col("t")), t=name) == brute(name)


def literal_segments(content):
    """The rule, line by line."""
    spans, held, depth, start = [], [], 0, 1
    for n, line in enumerate(content.split("\n"), 1):
        if not held:
            start = n
        held.append(line)
        depth += sum(line.count(c) for c in "{[(") - sum(line.count(c) for c in "}])")
        if not line.strip() and depth <= 0 and any(x.strip() for x in held):
            if text := "\n".join(held).strip():
                spans.append((start, n - 1, text))
            held = []
    if text := "\n".join(held).strip():
        spans.append((start, len(content.split("\n")), text))
    return spans


def test_segments_equal_the_rule(spark):
    random.seed(5)
    texts = ["".join(random.choice("a\n\n{}( )") for _ in range(random.randint(0, 30))) for _ in range(300)]
    texts += ["", "one\n\n\ntwo", "function a() {\n\n}\n\nfunction b() {\n}\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    found = {}
    for r in segment.segment(rows, ["k"]).orderBy("k", "start_line").collect():
        found.setdefault(r["k"], []).append((r["start_line"], r["end_line"], r["text"]))
    assert [found.get(k, []) for k in range(len(texts))] == [literal_segments(t) for t in texts]


def test_chunks(spark):
    rows = spark.createDataFrame(
        [(1, "First sentence here. Second sentence here. Third one."), (2, "short"), (3, "A long enough unit; another long unit\n  and a third unit.")], "k int, content string"
    )
    found = {}
    for r in segment.chunk(rows, ["k"]).orderBy("k", "chunk_ord").collect():
        found.setdefault(r["k"], []).append(r["chunk"])
    assert found == {
        1: ["First sentence here. Second sentence here.", "Second sentence here."],
        2: ["short"],
        3: ["A long enough unit; another long unit", "another long unit and a third unit.", "and a third unit."],
    }


def test_functions_of_a_file(spark):
    content = "import x\nexport function one(a) {\n  return a\n}\n\nexport function two() {\n  return 2\n}\nlast"
    rows = spark.createDataFrame([("f", content)], "path string, content string")
    found = segment.segment_functions(rows, ["path"]).orderBy("start_line").collect()
    assert [(r["name"], r["start_line"], r["end_line"]) for r in found] == [("one", 2, 4), ("two", 6, 8)]
