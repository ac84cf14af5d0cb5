"""Hard negatives against all products in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import pq_negatives as Q

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, key int"


def brute(rows, positives=5, negatives=3):
    kept = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) if abs(x) < 2**40 else int(256 * x) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in {k for k in kept if k[0] % 50 == 0}:
        alike = sorted((-dot(v, w), j) for j, other, w in kept if other == label and j != i)[:positives]
        for s, p in alike:
            fits = sorted((-dot(v, w), j) for j, other, w in kept if other != label and 50 * -s <= 100 * dot(v, w) <= 95 * -s)[:negatives]
            out += [(i, p, n + 1, j, clamp(-s), clamp(-t)) for n, (t, j) in enumerate(fits)]
    return sorted(out)


def clamp(score):
    return min(max(score, -(2**63)), 2**63 - 1)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in Q.mine(df, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(count, width, seed, labels=3, clustered=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    points = centres[rng.integers(0, 6, count)] + rng.normal(size=(count, width)) * (0.2 if clustered else 2)
    return [(i, [float(x) for x in p], int(rng.integers(0, labels))) for i, p in enumerate(points)]


@pytest.mark.parametrize(("width", "clustered"), [(8, True), (7, False), (1, False)])
def test_against_all_products(spark, width, clustered):
    rows = vectors(1500, width, 1, clustered=clustered)
    found = mined(spark, rows)
    assert found == brute(rows) and found


def test_tiles_change_nothing(spark, monkeypatch):
    rows = vectors(1000, 6, 2)
    monkeypatch.setattr(Q, "TILE", 7)
    monkeypatch.setattr(Q, "ROWS", 16)
    monkeypatch.setattr(Q, "ANCHORS", 3)
    assert mined(spark, rows) == brute(rows)


def test_ties_nulls_repeats_and_large_values(spark):
    rows = vectors(300, 4, 3)
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(300, 420)]  # a group of copies
    rows += [(350, [0.5, 0.5, 0.5, 0.5], 0), (400, [0.5, 0.5, 0.5, 0.5], 1), (400, [1.0, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0] * 4, 1), (501, None, 1), (502, [1.0, None, 1.0, 1.0], 1), (503, [1.0, math.nan, 1.0, 1.0], 1), (504, [math.inf] * 4, 1)]
    rows += [(505, [1.0] * 4, None), (506, [], 1), (550, [2.0, 1.0], 1), (507, [1e307] * 4, 2)]
    assert mined(spark, rows) == brute(rows)
    large = [(i, [x * 1e9 for x in v], label) for i, v, label in vectors(200, 4, 4)]
    assert mined(spark, large) == brute(large)
    larger = [(i, [x * 2.0**40 for x in v], label) for i, v, label in vectors(200, 4, 5)]
    assert mined(spark, larger) == brute(larger)


def test_one_label_empty_and_other_counts(spark):
    rows = vectors(200, 4, 6, labels=1)
    assert [r for r in mined(spark, rows)] == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, vectors(400, 4, 7), positives=2, negatives=1) == brute(vectors(400, 4, 7), 2, 1)


def test_bounds_hold_and_filter():
    rows = np.floor(np.array([v for _, v, _ in vectors(2000, 16, 8)]) * 256)
    centres = Q.fit(rows[:512])
    codes, residual = Q.encode(rows, centres)
    sizes = np.sqrt((rows[:50] ** 2).sum(1)) * (1 + 1e-9)
    least, most = Q.bounds(Q.tables(rows[:50], centres), sizes, codes, residual)
    exact = rows[:50] @ rows.T
    assert (least <= exact).all() and (exact <= most).all()
    floor = np.sort(least, 1)[:, -5:].min(1)
    assert (most >= floor[:, None]).mean() < 0.3  # most rows need no product
