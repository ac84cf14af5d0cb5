"""Operators whose work must grow with their rows, not with pairs of them: against plain versions, and on one large file."""

import math
import random
from zlib import crc32
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import blocks, evaluate, graph, headed, patterns, segment


def bag(text):
    return Counter(t for t in re.split(r"[^a-z0-9]+", text.lower()) if t)


def words(rng, count, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.8)), vocabulary)}" for _ in range(count))


def similarity(a, b):
    dot = sum(n * b[t] for t, n in a.items() if t in b)
    return dot / math.sqrt(float(sum(n * n for n in a.values())) * float(sum(n * n for n in b.values()))) if dot else 0.0


# --- unscoped attribution --------------------------------------------------------------------


def pool(seed, spans=60, uris=40):
    rng = random.Random(seed)
    left = [(f"p{i % 7}", i, i, words(rng, rng.randint(0, 30))) for i in range(spans)]
    right = [(f"u{n % (uris - 5)}", 100 - n, f"s{n}", k, words(rng, rng.randint(1, 12))) for n in range(uris) for k in range(rng.randint(1, 4))]
    return left + [("none", 1, 1, ""), ("odd", 1, 1, "nowhere else")], right + [("u1", 7, "e", 0, ""), ("u2", 3, "n", 0, None)]


def best(left, right, most):
    firsts = {}
    for uri, order, *_ in right:
        firsts[uri] = min(firsts.get(uri, order), order)
    bags = [bag(text or "") for *_, text in right]
    out = []
    for path, start, _, text in left:
        own = bag(text)
        of = {}
        for (uri, order, source, k, _), other in zip(right, bags, strict=True):
            key = (-similarity(own, other), order, k)
            of[uri] = min(of.get(uri, (key, source)), (key, source))
        ranked = sorted((key[0], firsts[uri], uri, key[1], key[2], source) for uri, (key, source) in of.items())[:most]
        out += [(path, start, uri, order, k, source, -s) for s, _, uri, order, k, source in ranked]
    return sorted(out)


@pytest.mark.parametrize("head", [0, 3, 256])
def test_first_uris_against_all_pairs(spark, monkeypatch, head):
    monkeypatch.setattr(blocks, "LEFT", 16)
    monkeypatch.setattr(blocks, "RIGHT", 24)
    monkeypatch.setattr(headed, "common_tokens", lambda rows, most=head, of=headed.common_tokens: of(rows, most) if most else of(rows, 1)[:0])
    left, right = pool(1)
    spans = spark.createDataFrame([("*", *r) for r in left], "scope string, path string, start_line bigint, end_line bigint, text string")
    chunks = spark.createDataFrame([("*", *r) for r in right], "scope string, uri string, uri_ord bigint, source_id string, chunk_ord bigint, chunk string")
    found = headed.best_uris(spans, chunks, ["scope"], ["path", "start_line"], ["uri", "uri_ord", "source_id", "chunk_ord"], 5)
    got = sorted((r["path"], r["start_line"], r["uri"], r["uri_ord"], r["chunk_ord"], r["source_id"], r["sim"]) for r in found.collect())
    assert got == best(left, right, 5)


def test_rows_made_are_few_of_the_pairs_that_share_a_token(spark, monkeypatch):
    rng = random.Random(2)
    left = [(f"p{i}", i, i, words(rng, 60)) for i in range(1200)]
    right = [(f"u{n}", n, f"s{n}", 0, words(rng, 20)) for n in range(3000)]
    spans = spark.createDataFrame([("*", *r) for r in left], "scope string, path string, start_line bigint, end_line bigint, text string")
    chunks = spark.createDataFrame([("*", *r) for r in right], "scope string, uri string, uri_ord bigint, source_id string, chunk_ord bigint, chunk string")
    monkeypatch.setattr(headed, "best_per_source", lambda found, key, order: found)
    monkeypatch.setattr(headed, "rank", lambda found, key, order, most: found.withColumn("rank", F.lit(1)))
    rows = headed.best_uris(spans, chunks, ["scope"], ["path", "start_line"], ["uri", "uri_ord", "source_id", "chunk_ord"], 5).count()
    bags = [bag(t) for *_, t in right]
    sharing = sum(bool(own.keys() & other.keys()) for own in (bag(t) for *_, t in left[:50]) for other in bags) * len(left) / 50
    assert 5 * len(left) <= rows < sharing / 10


def shuffled(spark):
    """Bytes that all stages so far wrote into shuffles."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_blocks_are_not_copied_into_shuffles(spark, monkeypatch):
    """Three times the spans and chunks write about three times the bytes, not nine times; and rounds find what all pairs have."""
    monkeypatch.setattr(blocks, "LEFT", 8)
    monkeypatch.setattr(blocks, "RIGHT", 8)
    monkeypatch.setattr(headed, "SIDE", 1)
    monkeypatch.setattr(headed, "WIDE", 1, raising=False)
    wrote = []
    for size in (100, 300):
        rng = random.Random(size)
        left = [(f"p{i}", i, i, words(rng, 80)) for i in range(size)]
        right = [(f"u{n % (size - 20)}", n, f"s{n}", 0, words(rng, 40)) for n in range(size)]
        spans = spark.createDataFrame([("*", *r) for r in left], "scope string, path string, start_line bigint, end_line bigint, text string").repartition(4)
        chunks = spark.createDataFrame([("*", *r) for r in right], "scope string, uri string, uri_ord bigint, source_id string, chunk_ord bigint, chunk string").repartition(4)
        before = shuffled(spark)
        found = headed.best_uris(spans, chunks, ["scope"], ["path", "start_line"], ["uri", "uri_ord", "source_id", "chunk_ord"], 5)
        got = sorted((r["path"], r["start_line"], r["uri"], r["uri_ord"], r["chunk_ord"], r["source_id"], r["sim"]) for r in found.collect())
        wrote.append(shuffled(spark) - before)
        assert got == best(left, right, 5)
    assert wrote[1] < 5 * wrote[0]


def test_few_pairs_are_compared_token_by_token(monkeypatch):
    """Bounds are no lower than similarities, and rule out nearly all pairs."""
    rng = random.Random(3)
    texts = [" ".join([*rng.choices(["the", "of", "and", "to"], k=8), *(f"w{rng.randrange(2000)}" for _ in range(12))]) for _ in range(800)]

    def block(texts):
        bags = [bag(t) for t in texts]
        held = [{"norm": sum(n * n for n in b.values()), "ids": [crc32(t.encode()) for t in b], "counts": list(b.values())} for b in bags]
        kind = pa.struct([("norm", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
        return headed.Block(pa.array([{"v": h} for h in held], pa.struct([("v", kind)])), np.sort(np.array([crc32(t.encode()) for t in ("the", "of", "and", "to")])))

    spans, chunks = block(texts[:200]), block(texts[200:])
    exact = np.array([[similarity(bag(a), bag(b)) for b in texts[200:]] for a in texts[:200]])
    assert ((spans.outline @ chunks.outline.T) >= exact * headed.SLACK).all()
    compared, real = [], headed._similarities
    monkeypatch.setattr(headed, "_similarities", lambda *given: (compared.append(len(given[-1])), real(*given))[1])
    uris = headed.Uris(np.arange(600), np.arange(600), 600)
    got = [(i, j, sim) for part in headed.found(spans, chunks, uris, np.zeros(200), 5) for i, j, sim in zip(*(p.tolist() for p in part), strict=True)]
    want = [(i, j, exact[i, j]) for i in range(200) for j in sorted(range(600), key=lambda j: (-exact[i, j], j))[:5]]
    assert got == want
    assert sum(compared) < 200 * 600 / 4


# --- label alignment -------------------------------------------------------------------------


def test_labels_find_their_first_span(spark, monkeypatch):
    monkeypatch.setattr(patterns, "PATTERNS", 4)
    monkeypatch.setattr(patterns, "TEXTS", 5)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abé ", k=n))
    spans = [(f"p{i % 3}", 1 + i, text(12), i / 100, "u") for i in range(60)] + [("p0", 1000, None, 0.5, "u")]
    labels = [(f"p{i % 4}", text(rng.randint(0, 4)), f"e{i}") for i in range(80)] + [("p1", None, "x"), (None, "a", "y"), ("p1", "", "z")]
    given = spark.createDataFrame(spans, "path string, start_line bigint, text string, sim double, source string")
    got = evaluate.align(spark.createDataFrame(labels, "path string, find string, expected string"), given).collect()
    want = []
    for path, find, expected in labels:
        held = [s for s in sorted(spans, key=lambda s: s[1]) if find is not None and s[0] == path and s[2] is not None and find in s[2]]
        want.append((path, find, expected, held[0][1] if held else None, held[0][3] if held else 0.0))
    assert sorted(((r["path"], r["find"], r["expected"], r["start_line"], r["sim"]) for r in got), key=repr) == sorted(want, key=repr)


def test_a_file_of_many_spans_and_labels(spark):
    many = 100_000
    name = F.concat(F.lit("fn"), F.col("id").cast("string"), F.lit("_"))
    spans = spark.range(many).select(
        F.lit("f").alias("path"), (F.col("id") + 1).alias("start_line"), F.concat(F.lit("call "), name, F.lit(" end")).alias("text"), F.lit(0.5).alias("sim")
    )
    labels = spark.range(many).select(F.lit("f").alias("path"), F.when(F.col("id") % 2 == 0, name).otherwise(F.concat(name, F.lit("?"))).alias("find"), name.alias("expected"))
    began = time.time()
    found = evaluate.align(labels, spans).agg(F.count("*"), F.count_if(F.col("sim") > 0), F.count_if(F.col("find") == F.concat(F.lit("fn"), (F.col("start_line") - 1).cast("string"), F.lit("_"))))
    assert tuple(found.first()) == (many, many // 2, many // 2)
    assert time.time() - began < 120  # all pairs would be 10^10 comparisons


# --- segmentation ----------------------------------------------------------------------------


def loop(content):
    spans, held, depth, start = [], [], 0, 0
    lines = content.split("\n")
    for i, line in enumerate(lines):
        held.append(line)
        depth += sum(map(line.count, "{[(")) - sum(map(line.count, "}])"))
        if not line.strip() and depth <= 0 and any(x.strip() for x in held):
            spans.append((start + 1, i, "\n".join(held).strip()))
            held, start = [], i + 1
    spans.append((start + 1, len(lines), "\n".join(held).strip()))
    return [s for s in spans if s[2]]


def test_stretches_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    files = {f"f{i}": "\n".join(rng.choices(["", " ", "a", "{", "}", "b (", ")", "x"], k=rng.randint(0, 14))) for i in range(300)}
    files |= {"none": "", "blank": "\n\n\n"}
    given = spark.createDataFrame([*files.items(), ("null", None)], "path string, content string")
    want = sorted((path, *s) for path, content in files.items() for s in loop(content))
    for stretch in (1, 2, 3, 4096):
        monkeypatch.setattr(segment, "STRETCH", stretch)
        assert sorted(tuple(r) for r in segment.segment(given, ["path"]).collect()) == want


def test_one_file_of_a_million_lines(spark):
    lines = 1_000_000
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.when(i % 10 == 0, "").when(i % 4000 == 1, "open (").when(i % 4000 == 3999, ")").otherwise("line")), "\n")
    found = segment.segment(spark.range(1).select(F.lit("f").alias("path"), content.alias("content")), ["path"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(path[^)]*_i", plan)
    facts = found.agg(F.count("*"), F.min("start_line"), F.max("end_line"), F.max(F.col("end_line") - F.col("start_line"))).first()
    assert tuple(facts) == (250, 1, lines - 1, 3998)


# --- range join ------------------------------------------------------------------------------


def test_lines_meet_the_spans_that_hold_them(spark):
    rng = random.Random(5)
    spans = [(f"p{i % 3}", i, s := rng.randint(1, 60), s + rng.choice([-1, 0, 1, 5, 40])) for i in range(80)]
    lines = [(f"p{i % 4}", rng.randint(0, 110)) for i in range(200)]
    given = spark.createDataFrame(spans, "path string, id bigint, start_line bigint, end_line bigint")
    asked = spark.createDataFrame(lines, "path string, line bigint")
    want = sorted((p, n, i) for p, n in lines for q, i, s, e in spans if p == q and s <= n <= e)
    for width in (1, 4, 256):
        got = graph.spans_of_lines(asked, given, ["path"], width)
        assert sorted((r["path"], r["line"], r["id"]) for r in got.collect()) == want


def test_every_line_of_a_large_file(spark):
    many = 100_000
    spans = spark.range(many).select(F.lit("f").alias("path"), "id", (F.col("id") * 5 + 1).alias("start_line"), (F.col("id") * 5 + 4).alias("end_line"))
    lines = spark.range(1, many * 5 + 1).select(F.lit("f").alias("path"), F.col("id").alias("line"))
    assert graph.spans_of_lines(lines, spans, ["path"]).count() == many * 4
