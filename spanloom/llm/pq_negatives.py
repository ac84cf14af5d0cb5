"""Hard negatives by product quantisation with stored residual norms.

Components are cut into subspaces of ``SUB`` dimensions, each with up to 256 centroids fitted on a
bounded sample; every row is indexed by its centroids' numbers and the norm of what they leave over.
The inner product of an anchor a with a row x lies within |a| * residual(x) of the sum that the
anchor's lookup tables give for x's codes. So the tables' sums plus or minus that bound tell rows that
can't be among an anchor's best, or can't fall into a window of scores, from those that may; only the
latter are multiplied out, in whole numbers, which completes the answer. The fit decides
how many rows that are, never which answer comes out.

Two passes over tiles of anchors and rows: the first finds each anchor's nearest rows of its own label,
the second, for each of those, the best rows of other labels whose score is ``low`` to ``high`` per cent of
that positive's. A tile holds at most about ``TILE`` anchors and ``TILE`` rows, whatever the labels, and returns
an anchor's best of the tile; tiles are merged by a ranked window over these few.

Products are exact: in doubles where no sum can exceed 2**53, in 64-bit integers, or in Python integers beyond;
scores beyond a long are shown as its nearest end, but ranked and compared by their value (up to 2**126).

Defined results: a null id, label or vector, a null or non-finite component (or one whose multiple by ``scale`` is no
finite double) takes no part; a shorter vector counts as filled up with zeros, an empty one as all zeros; rows with the
anchor's id are not its positives; repeated rows each take a place, repeated anchors (same id, label and vector) are
answered once; ties go to the smaller id; an anchor without positives, or a positive without rows in its
window, gives no rows; an empty table gives an empty one; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint
from spanloom.llm.voronoi import WHOLE, _limbs, products

SAMPLE = 4096  # rows that the centroids are fitted on
SUB, CENTROIDS, ROUNDS = 2, 256, 6
TILE = 32768
ANCHORS, ROWS = 128, 4096  # what a task scores at once


def whole_parts(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(doubles, lambda x: F.when(F.abs(x) < F.lit(WHOLE), F.floor(x).cast("double")).otherwise(x)))


def fit(sample: np.ndarray) -> np.ndarray:
    """Centroids of each subspace (subspaces, centroids, SUB) by Lloyd's rounds from evenly spread rows of the sample."""
    parts = _parts(sample)
    found = np.zeros((parts.shape[1], min(CENTROIDS, len(sample)), SUB))
    with np.errstate(all="ignore"):
        for m in range(parts.shape[1]):
            points = parts[:, m]
            order = np.lexsort(points.T)
            centres = points[order[np.linspace(0, len(points) - 1, found.shape[1]).astype(int)]]
            for _ in range(ROUNDS):
                near = _nearest(points, centres)
                many = np.bincount(near, minlength=len(centres))
                sums = np.stack([np.bincount(near, points[:, d], minlength=len(centres)) for d in range(SUB)], 1)
                centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
            found[m] = centres
    return found


def _parts(vectors: np.ndarray) -> np.ndarray:
    """(rows, subspaces, SUB), filled up with zeros."""
    short = -vectors.shape[1] % SUB
    return np.pad(vectors, ((0, 0), (0, short))).reshape(len(vectors), -1, SUB)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codes, and its residual norm with what rounding of sums may add."""
    parts = _parts(vectors)
    codes = np.zeros(parts.shape[:2], np.uint8)
    with np.errstate(all="ignore"):
        for m in range(parts.shape[1]):
            codes[:, m] = _nearest(parts[:, m], centres[m])
        left = parts - centres[np.arange(parts.shape[1]), codes]
        residual = np.sqrt((left**2).sum((1, 2)))
        size = np.sqrt((parts**2).sum((1, 2)))
        return codes, residual * (1 + 1e-9) + 1e-10 * (size + residual) + 1e-300


def tables(anchors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The anchors' inner products with all centroids: (subspaces, anchors, centroids)."""
    with np.errstate(all="ignore"):
        return np.einsum("ams,mcs->mac", _parts(anchors), centres)


def bounds(lookup: np.ndarray, sizes: np.ndarray, codes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor and row; not a number where nothing is known."""
    with np.errstate(all="ignore"):
        sums = np.zeros((lookup.shape[1], len(codes)))
        for m, table in enumerate(lookup):
            sums += table.take(codes[:, m], axis=1)
        error = np.outer(sizes, residual)
        return sums - error, sums + error


def _below(value: int) -> float:
    return float(np.nextafter(min(max(float(value), -1e300), 1e300), -np.inf))


def _above(value: int) -> float:
    return -_below(-value)


def _best(held: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k first of what is held, (minus score, id) in order, and of new scores."""
    if len(scores) > k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= cut], ids[scores >= cut]
    return sorted(held + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)])[:k]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity; values that are not known don't count."""
    values = values[~np.isnan(values)]
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


class _Side:
    """A tile's anchors or rows as arrays."""

    def __init__(self, table: pa.Table, width: int, subspaces: int) -> None:
        table = table.combine_chunks()
        read = lambda name: table.column(name).to_numpy()
        self.id, self.label = read("id"), read("label")
        packed = table.column("v").to_pylist()
        self.v = np.array([np.frombuffer(p, "<f8" if len(p) == 8 * width else "<i4").astype(np.float64) for p in packed]).reshape(-1, width)
        if "key" in table.column_names:
            self.key = read("key")
            with np.errstate(all="ignore"):
                self.size = np.sqrt((self.v**2).sum(1)) * (1 + 1e-9)
        if "codes" in table.column_names:
            self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, subspaces)
            self.residual = read("residual")


def _columns(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows whose last entry is a score, as a table with the score's two limbs."""
    high, low = _limbs(np.array([r[-1] for r in rows], object))
    lists = list(zip(*(r[:-1] for r in rows), strict=True)) or [()] * (len(names) - 2)
    return pa.table([*(pa.array(c, pa.int64()) for c in lists), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=names)


def nearest_alike(anchors: _Side, rows: _Side, centres: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each anchor (by its place) its k first other rows of the same label, as (minus score, id)."""
    order = np.argsort(rows.label, kind="stable")
    starts, ends = (np.searchsorted(rows.label[order], anchors.label, side) for side in ("left", "right"))
    for label in np.unique(anchors.label):
        own = np.flatnonzero(anchors.label == label)
        alike = order[starts[own[0]] : ends[own[0]]]
        for a in range(0, len(own), ANCHORS):
            group = own[a : a + ANCHORS]
            lookup, held = tables(anchors.v[group], centres), [[] for _ in group]
            for r in range(0, len(alike), ROWS):
                part = alike[r : r + ROWS]
                least, most = bounds(lookup, anchors.size[group], rows.codes[part], rows.residual[part])
                for n, anchor in enumerate(group):
                    other = rows.id[part] != anchors.id[anchor]
                    floor = max(_kth(least[n][other], k), _below(-held[n][-1][0]) if len(held[n]) == k else -np.inf)
                    chosen = part[other & ~(most[n] < floor)]
                    held[n] = _best(held[n], products(anchors.v[anchor][None], rows.v[chosen])[0], rows.id[chosen], k)
            yield from zip(group, held, strict=True)


def in_windows(
    anchors: _Side, windows: list[list[tuple[int, int]]], rows: _Side, centres: np.ndarray, k: int
) -> Iterator[tuple[int, list[list[tuple[int, int]]]]]:
    """For each anchor and each of its windows (least and greatest score) the k first rows of other labels, as (minus score, id)."""
    for a in range(0, len(anchors.id), ANCHORS):
        group = np.arange(a, min(a + ANCHORS, len(anchors.id)))
        lookup, held = tables(anchors.v[group], centres), [[[] for _ in windows[n]] for n in group]
        for r in range(0, len(rows.id), ROWS):
            part = np.arange(r, min(r + ROWS, len(rows.id)))
            least, most = bounds(lookup, anchors.size[group], rows.codes[part], rows.residual[part])
            for n, anchor in enumerate(group):
                asked = [(w, lo, hi) for w, (lo, hi) in enumerate(windows[anchor]) if lo <= hi]
                if not asked:
                    continue
                outside = (most[n] < _below(min(lo for _, lo, _ in asked))) | (least[n] > _above(max(hi for _, _, hi in asked)))
                near = part[(rows.label[part] != anchors.label[anchor]) & ~outside]
                down, up = least[n][near - r], most[n][near - r]
                chosen = np.zeros(len(near), bool)
                for w, lo, hi in asked:
                    sure = down[(down >= _above(lo)) & (up <= _below(hi))]
                    floor = max(_below(lo), _kth(sure, k), _below(-held[n][w][-1][0]) if len(held[n][w]) == k else -np.inf)
                    chosen |= ~(up < floor) & ~(down > _above(hi))
                near = near[chosen]
                scores = products(anchors.v[anchor][None], rows.v[near])[0]
                for w, lo, hi in asked:
                    fits = np.array((scores >= lo) & (scores <= hi), bool)
                    held[n][w] = _best(held[n][w], scores[fits], rows.id[near[fits]], k)
        yield from zip(group, held, strict=True)


def _indexed(rows: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """The rows with padded, packed vectors, codes, residual norms and a slot that deals them to tiles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column("v")
                sizes = np.diff(column.offsets.to_numpy())
                v = np.zeros((len(sizes), width))
                v[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
                codes, residual = encode(v, centres)
                small = np.abs(v).max(1, initial=0) < 2.0**31
                packed = [(x.astype("<i4") if s else x).tobytes() for x, s in zip(v, small, strict=True)]
                slots = (part << 40) + seen + np.arange(len(sizes))
                seen += len(sizes)
                arrays = [*(batch.column(c) for c in ("id", "label", "asks", "key")), pa.array(slots), pa.array(packed, pa.binary())]
                arrays += [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "asks", "key", "slot", "v", "codes", "residual"])

    return rows.mapInArrow(scan, "id bigint, label bigint, asks boolean, key bigint, slot bigint, v binary, codes binary, residual double")


def _score(high: str, low: str) -> Column:
    least = F.lit(-(1 << 63)).cast("bigint")
    score = F.when(F.col(high) == 0, F.col(low)).when(F.col(high) == -1, F.col(low).bitwiseOR(least))
    return F.coalesce(score, F.when(F.col(high) > 0, F.lit((1 << 63) - 1)).otherwise(least))


def mine(
    vectors: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), whole_parts(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    given = checkpoint(given.where("id is not null and label is not null and v is not null").withColumn("key", F.xxhash64("label", "v")))
    facts = given.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width"), F.count_if("asks").alias("anchors")).first()
    width = max(facts["width"] or 0, 1)
    picked = given.select("v", F.xxhash64("id").alias("h"), "id", "key").orderBy("h", "id", "key").limit(SAMPLE).collect()
    sample = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in picked], np.float64).reshape(-1, width)
    centres = fit(sample if len(sample) else np.zeros((1, width)))
    subspaces = len(centres)
    rows = checkpoint(_indexed(given, width, centres))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = -(-facts["anchors"] // TILE) or 1
    over = max(-(-facts["rows"] // TILE), min(-(-tasks // down), -(-facts["rows"] // ROWS)), 1)
    dealt = rows.select("id", "label", "v", "codes", "residual", F.pmod(F.xxhash64("slot"), F.lit(over)).alias("column"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"))
    # columns of their own, since the anchors meet the rows they come from
    asked = rows.where("asks").select(*[F.col(c).alias(c) for c in ("id", "label", "key", "v")]).dropDuplicates(["id", "key"])
    spread = lambda df: df.withColumn("row", F.pmod(F.xxhash64("id", "key"), F.lit(down)).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(over - 1).cast("bigint"))).alias("column")
    )
    tile = ["row", "column"]

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, held = _Side(left, width, subspaces), _Side(right, width, subspaces)
        found = nearest_alike(anchors, held, centres, positives) if len(held.id) else ()
        flat = [(int(anchors.id[n]), int(anchors.key[n]), i, -s) for n, best in found for s, i in best]
        return _columns(flat, ["anchor_id", "key", "id", "high", "low"])

    partial = spread(asked).groupBy(*tile).cogroup(dealt.groupBy(*tile)).applyInArrow(
        alike, "anchor_id bigint, key bigint, id bigint, high bigint, low bigint"
    )
    best = Window.partitionBy("anchor_id", "key").orderBy(F.desc("high"), F.desc("low"), "id")
    first = partial.withColumn("place", F.row_number().over(best).cast("bigint")).where(F.col("place") <= positives)
    windows = checkpoint(
        first.groupBy("anchor_id", "key").agg(F.array_sort(F.collect_list(F.struct("place", "id", "high", "low"))).alias("p"))  # at most ``positives``
    )
    asking = asked.join(windows.withColumnRenamed("anchor_id", "id"), ["id", "key"])

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "key", "place", "positive_id", "p_high", "p_low", "id", "high", "low"]
        anchors, held = _Side(left, width, subspaces), _Side(right, width, subspaces)
        own = left.column("p").to_pylist()
        scores = [[(p["high"] << 63) + p["low"] for p in mine] for mine in own]
        asked_for = [[(-(-low * s // 100), high * s // 100) for s in mine] for mine in scores]
        flat = []
        for n, found in in_windows(anchors, asked_for, held, centres, negatives) if len(held.id) else ():
            for p, kept in zip(own[n], found, strict=True):
                flat += [(int(anchors.id[n]), int(anchors.key[n]), p["place"], p["id"], p["high"], p["low"], i, -s) for s, i in kept]
        return _columns(flat, names)

    schema = "anchor_id bigint, key bigint, place bigint, positive_id bigint, p_high bigint, p_low bigint, id bigint, high bigint, low bigint"
    some = spread(asking).groupBy(*tile).cogroup(dealt.groupBy(*tile)).applyInArrow(between, schema)
    last = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("high"), F.desc("low"), "id")
    ranked = some.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), _score("p_high", "p_low").alias("positive_score"), _score("high", "low").alias("negative_score")
    )
