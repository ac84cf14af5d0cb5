"""Inner products in tiles: against all pairs, and by what a worker holds."""

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import blocks, similarity


def tables(spark, seed=1, left=60, right=90):
    rng = np.random.default_rng(seed)
    rows = lambda many, prefix: [(f"s{k % 3}", k, f"{prefix}{k % 7}", v) for k, v in enumerate(rng.integers(-3, 4, (many, 4)).astype(float).tolist())]
    x, y = [*rows(left, "q"), ("s0", 1000, "q", None), ("alone", 1, "q", [1.0] * 4)], [*rows(right, "u"), (None, 5, "u", [1.0] * 4)]
    schema = "scope string, id bigint, uri string, v array<float>"
    return x, y, *(spark.createDataFrame(r, schema) for r in (x, y))


@pytest.mark.parametrize("tile", [(7, 5), (4096, 8192)])
def test_products_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(blocks, "TILE", tile)
    monkeypatch.setattr(blocks, "PRODUCTS", 64)
    monkeypatch.setattr(blocks, "ROWS", 10)
    x, y, left, right = tables(spark)
    right = right.withColumnsRenamed({"id": "other"})
    sims = {(s, i, j, u): float(np.dot(v, w)) for s, i, _, v in x for t, j, u, w in y if s == t and v and w}
    found = blocks.products(left, right, ["scope"], ["id"], ["other"], least=2.0).collect()
    assert sorted((r["scope"], r["id"], r["other"], r["sim"]) for r in found) == sorted((s, i, j, v) for (s, i, j, _), v in sims.items() if v >= 2)
    best = {}
    for (s, i, j, u), v in sims.items():
        best[s, i, u] = max(best.get((s, i, u), (-np.inf, 0)), (v, -j))
    found = blocks.products(left, right, ["scope"], ["id"], ["other", "uri"], uri="uri", order=("other",))
    merged = similarity.best_per_source(found, ["scope", "id"], order=("other",)).collect()
    assert {(r["scope"], r["id"], r["uri"]): (r["sim"], -r["other"]) for r in merged} == best


def test_a_worker_holds_one_tile(spark, monkeypatch):
    """A batch that reaches a worker has bounded rows of a vector each, not blocks of thousands of vectors."""
    x, y, left, right = tables(spark)
    seen = blocks._tiles
    fields = blocks._dealt_rows(left, right, ["scope"], {"_x": ["id"], "_y": ["id", "uri"]}, "v")
    assert fields.schema["v"].dataType.simpleString() == "array<float>" and not any(f.dataType.simpleString().startswith("array<struct") for f in fields.schema)
    batches = fields.where("scope is not null").coalesce(1).sortWithinPartitions("scope", "_r", "_c", "_side").toArrow().to_batches(max_chunksize=11)
    tiles = list(seen(iter(batches), ["scope", "_r", "_c"]))
    assert len(tiles) == 3 and sum(t.num_rows for t in tiles) == sum(b.num_rows for b in batches)
    assert all(isinstance(t, pa.RecordBatch) and t.column("_side").to_pylist() == sorted(t.column("_side").to_pylist()) for t in tiles)
