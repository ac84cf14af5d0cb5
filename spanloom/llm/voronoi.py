"""Exact top-k search by a Voronoi kNN join over integer vectors.

Pivots from a bounded sample cut the space into cells. Every data row goes to the cell of its
nearest pivot; every query goes to a query group by the same pivots. Summaries of cells and
groups (counts, radii) give, for each pair of group and cell, bounds of the inner product: the
group's k best rows certainly reach a floor, and a cell whose ceiling lies below that floor
can't hold any of them. Only the other cells are replicated to the group, as packed blocks of
bounded size, and solved there with dense products; partial lists of each block are merged.

Summaries are bounded by the pivots' number, at most ``MOST_PIVOTS``. A cell or group of any
size is cut into blocks, so a vector that a third of all rows share is spread over tasks: query
blocks and data blocks of a set meet in tiles of at most ``TILE`` by ``TILE`` blocks, so a block is
copied once for each TILE blocks of the other side at most, however many tasks there are.

Products are exact: in doubles where no sum can exceed 2**53, in 64-bit integers below 2**63, in
Python integers beyond. Scores beyond the range of a long are shown as its nearest end, but ranked
by their true values (up to 2**126).

Defined results: vectors that are null or hold a null or non-finite component, or another
number of components than most (or one whose multiple by ``scale`` is no finite double), take no part; a null id takes no part; every row with the
query's id is the query's own; repeated data rows each take a rank; repeated query rows (same
id and vector) are answered once; ties go to the smaller id; fewer candidates than k give fewer
rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint

PIVOTS, MOST_PIVOTS = 64, 256
SAMPLE = 4096  # rows that pivots are chosen from
QUERY_BLOCK = 1024
DATA_BLOCK = 4096
TILE = 16
WHOLE = 2.0**52  # doubles from here on are whole numbers


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double, as a double; null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(doubles, lambda x: F.when(F.abs(x) < F.lit(WHOLE), F.floor(x).cast("double")).otherwise(x))
    return F.when(sound & (F.size(vector) > 0), whole)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots: deterministic, at most ``count`` distinct ones."""
    picked = [0]
    with np.errstate(all="ignore"):
        near = ((sample - sample[0]) ** 2).sum(1)
        while len(picked) < count and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)
    cell = square.argmin(1)
    return cell, np.sqrt(np.maximum(((points - pivots[cell]) ** 2).sum(1), 0))


def needed_cells(pivots: np.ndarray, groups: pd.DataFrame, cells: pd.DataFrame, k: int) -> dict[int, list[int]]:
    """For each query group the cells that may hold one of its queries' k best rows.

    For q = p + s in the group and x = c + r in the cell: |q.x - p.c| is at most
    |p||r| + |s||c| + |s||r|. One row more than k is asked for, as one may be the query's own.
    """
    with np.errstate(all="ignore"):
        return _needed(pivots, groups, cells, k)


def _needed(pivots: np.ndarray, groups: pd.DataFrame, cells: pd.DataFrame, k: int) -> dict[int, list[int]]:
    size = np.linalg.norm(pivots, axis=1)
    out = {}
    cell_at, counts, radius = (cells[c].to_numpy() for c in ("cell", "rows", "radius"))
    for at, spread, own in zip(groups["cell"], groups["radius"], groups["most_own"], strict=True):
        centre = pivots[cell_at] @ pivots[at]
        reach = size[at] * radius + spread * size[cell_at] + spread * radius
        reach = reach + 1e-6 * (1 + np.abs(centre) + size[at] * size[cell_at] + reach)  # what rounding may hide
        if not np.isfinite(reach).all():
            out[int(at)] = [int(c) for c in cell_at]
            continue
        floors = np.argsort(-(centre - reach), kind="stable")
        filled = np.searchsorted(np.cumsum(counts[floors]), k + own)
        floor = (centre - reach)[floors[filled]] if filled < len(floors) else -np.inf
        out[int(at)] = [int(c) for c in cell_at[centre + reach >= floor]]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in the cheapest type that holds all sums."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2.0**63 * 0.99 and max(np.abs(q).max(), np.abs(x).max()) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.array([[int(c) for c in row] for row in q], object) @ np.array([[int(c) for c in row] for row in x], object).T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best (score, smaller id first) of one block, without its own rows."""
    for row in range(len(scores)):
        score = scores[row]
        place = score if score.dtype != object else np.unique(score, return_inverse=True)[1]
        usable = np.flatnonzero(ids != own[row])
        if len(usable) > k:
            cut = np.partition(place[usable], len(usable) - k)[len(usable) - k]
            usable = usable[place[usable] >= cut]
        order = usable[np.lexsort((ids[usable], -place[usable]))][:k]
        yield row, ids[order], score[order]


def _limbs(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as high * 2**63 + low, both as 64-bit integers, low not negative."""
    if scores.dtype != object:
        return scores >> 63, scores & np.int64((1 << 63) - 1)
    limit = 1 << 126
    within = [min(max(int(s), -limit), limit - 1) for s in scores]
    return np.array([s >> 63 for s in within], np.int64), np.array([s & ((1 << 63) - 1) for s in within], np.int64)


def top_k(
    vectors: DataFrame,
    id_col: str,
    vector_col: str,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    pivots: int | None = None,
) -> DataFrame:
    """query_id, rank, id, score: the k highest integer inner products of each query row.

    ``pivots`` grow with the square root of the rows, from PIVOTS to MOST_PIVOTS, unless they are given.
    """
    spark = vectors.sparkSession
    rows = checkpoint(
        vectors.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
        .where("id is not null and v is not null")
        .withColumn("asks", F.coalesce("asks", F.lit(False)))
    )
    schema = "query_id bigint, rank int, id bigint, score bigint"
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["w"]
    rows = rows.where(F.size("v") == width)
    # the same sample whatever the partitions: the smallest hashes, ties by id
    sample = rows.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).toPandas()
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, int(widths[0]["count"] ** 0.5) // 8))
    centres = choose_pivots(_matrix(sample["v"]), pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column("v").flatten().to_numpy().reshape(-1, width)
            with np.errstate(all="ignore"):
                cell, radius = _nearest(points, centres)
            # four bytes a component where all fit, eight else
            wide = np.abs(points).max(1) >= 2.0**31
            packed = pa.array([(p if w else p.astype("<i4")).tobytes() for p, w in zip(points, wide, strict=True)], pa.binary())
            radius = np.where(np.isfinite(radius), radius, np.inf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("asks"), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array(wide), packed],
                names=["id", "asks", "cell", "radius", "wide", "v"],
            )

    cells = checkpoint(rows.mapInArrow(placed, "id bigint, asks boolean, cell int, radius double, wide boolean, v binary"))
    summary = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.max("radius").alias("radius")).orderBy("cell").toPandas()
    asked = cells.where("asks")
    own = asked.select("id").distinct().join(cells.select("id"), "id").groupBy("id").count().agg(F.max("count").alias("n")).first()["n"]
    groups = asked.groupBy("cell").agg(F.count("*").alias("rows"), F.max("radius").alias("radius")).orderBy("cell").toPandas()
    if not len(groups):
        return spark.createDataFrame([], schema)
    groups["most_own"] = own or 1
    needs = needed_cells(centres, groups, summary, k)

    # Query groups that need the same cells share blocks: replication counts sets, not pivots.
    sets: dict[tuple[int, ...], int] = {}
    set_of = {cell: sets.setdefault(tuple(found), len(sets)) for cell, found in needs.items()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_cell, in_group = (dict(zip(t["cell"], t["rows"], strict=True)) for t in (summary, groups))
    rows_of = {number: sum(in_cell[c] for c in found) for found, number in sets.items()}
    asked_of = {number: sum(in_group[c] for c, n in set_of.items() if n == number) for number in rows_of}
    # tiles of a set: as many as keep the tasks busy, each of TILE by TILE blocks at most
    across = {n: (-(-asked_of[n] // QUERY_BLOCK), -(-rows_of[n] // DATA_BLOCK)) for n in rows_of}
    side = min(TILE, max(1, int((sum(a * b for a, b in across.values()) / tasks) ** 0.5)))
    tiles = [(n, -(-a // side), -(-b // side)) for n, (a, b) in across.items()]
    # at most MOST_PIVOTS rows, and their square
    dealt = F.broadcast(spark.createDataFrame([(int(n), int(a), int(b)) for n, a, b in tiles], "set int, down int, over int"))
    asking = F.broadcast(spark.createDataFrame([(int(c), int(n)) for c, n in set_of.items()], "cell int, set int"))
    needed = F.broadcast(spark.createDataFrame([(int(c), int(n)) for found, n in sets.items() for c in found], "cell int, set int"))
    queries = asked.withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "key"]).join(asking, "cell").select("set", "id", "key", "wide", "v")
    data = cells.join(needed, "cell").select("set", "id", F.lit(0).cast("bigint").alias("key"), "wide", "v")
    salted = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(tasks))).repartition("set", "part").drop("part")
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    query_blocks = _blocks(salted, QUERY_BLOCK).join(dealt, "set").select(
        "set", F.pmod(F.xxhash64("block"), F.col("down")).cast("int").alias("row"), count("over").alias("column"),
        F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("vs").alias("q_vs"),
    )
    data_blocks = _blocks(data, DATA_BLOCK).join(dealt, "set").select(
        "set", count("down").alias("row"), F.pmod(F.xxhash64("block"), F.col("over")).cast("int").alias("column"), "ids", "vs"
    )
    tile = ["set", "row", "column"]
    pairs = query_blocks.repartition(tasks, *tile).join(data_blocks.repartition(tasks, *tile), tile)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                read = lambda name, kind, at=at, batch=batch: np.frombuffer(batch.column(name)[at].as_py(), kind)
                q_ids, q_keys, ids = read("q_ids", "<i8"), read("q_keys", "<i8"), read("ids", "<i8")
                q, x = (_unpacked(read(c, "<u1"), len(i), width) for c, i in (("q_vs", q_ids), ("vs", ids)))
                found = list(_best(products(q, x), ids, q_ids, k))
                asker = np.concatenate([np.full(len(i), r) for r, i, _ in found])
                high, low = _limbs(np.concatenate([s for _, _, s in found]))
                columns = [q_ids[asker], q_keys[asker], np.concatenate([i for _, i, _ in found]), high, low]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "key", "id", "high", "low"])

    partial = pairs.select("q_ids", "q_keys", "q_vs", "ids", "vs").mapInArrow(
        solved, "query_id bigint, key bigint, id bigint, high bigint, low bigint"
    )
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("high"), F.desc("low"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    least = F.lit(-(1 << 63)).cast("bigint")
    score = F.when(F.col("high") == 0, F.col("low")).when(F.col("high") == -1, F.col("low").bitwiseOR(least))
    score = F.coalesce(score, F.when(F.col("high") > 0, F.lit((1 << 63) - 1)).otherwise(least))
    return ranked.select("query_id", "rank", "id", score.alias("score"))


def _unpacked(packed: np.ndarray, many: int, width: int) -> np.ndarray:
    """The vectors of a block, of four or eight bytes a component, as doubles."""
    return packed.view("<f8" if len(packed) == 8 * many * width else "<i4").astype(np.float64).reshape(-1, width)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """set, block, ids, keys, vs: the rows of each set packed, at most ``most`` to a block.

    Rows are packed as they come inside their partition, so a set of any size needs no gathering.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], tuple[list[int], list[int], list[bytes]]] = {}

        def out(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal made
            ids, keys, vs = held.pop(kind)
            made += 1
            packs = [np.array(ids, "<i8").tobytes(), np.array(keys, "<i8").tobytes(), b"".join(vs)]
            columns = [pa.array([kind[0]], pa.int32()), pa.array([(part << 32) + made], pa.int64()), *(pa.array([x], pa.binary()) for x in packs)]
            return pa.RecordBatch.from_arrays(columns, names=["set", "block", "ids", "keys", "vs"])

        for batch in batches:
            for number, wide, *row in zip(*(batch.column(c).to_pylist() for c in ("set", "wide", "id", "key", "v")), strict=True):
                mine = held.setdefault((number, wide), ([], [], []))
                for values, value in zip(mine, row, strict=True):
                    values.append(value)
                if len(mine[0]) == most:
                    yield out((number, wide))
        for kind in list(held):
            yield out(kind)

    return rows.select("set", "id", "key", "wide", "v").mapInArrow(packed, "set int, block bigint, ids binary, keys binary, vs binary")
