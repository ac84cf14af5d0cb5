"""Inner products of all vectors of two tables within a scope, block by block.

Both sides are dealt into tiles of bounded size; nothing goes by way of the driver. Vectors meet row by row (``products``): a row is
copied once for each tile of the other side, and a worker holds one tile at once. Other values meet in packed blocks
(``meet``), of which a tile has about ``SIDE`` by ``SIDE``. Products add up in double precision. A scope of any size is so many tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.lineage import cut

LEFT, RIGHT = 1024, 4096  # rows of a block
SIDE = 8
TILE = 4096, 8192  # left and right rows of a tile of vectors
PRODUCTS = 1 << 21  # that a worker holds at once
ROWS = 10_000  # of a batch that leaves a worker


def counted(rows: DataFrame, scope: list[str], most: int) -> DataFrame:
    """scope, blocks: how many blocks of about ``most`` rows a scope has."""
    return rows.groupBy(*scope).agg(F.ceil(F.count("*") / most).alias("blocks"))


def placed(rows: DataFrame, counts: DataFrame, scope: list[str], key: list[str], vector: str) -> DataFrame:
    """scope, block, row (key and v)."""
    given = rows.select(*scope, F.struct(*[F.col(k) for k in key], F.col(vector).alias("v")).alias("row"), F.xxhash64(*key).alias("h")).join(counts, scope)
    return given.select(*scope, F.pmod("h", F.col("blocks")).alias("block"), "row")


def _dealt(rows: DataFrame, scope: list[str], key: list[str], vector: str, most: int) -> tuple[DataFrame, DataFrame]:
    """scope, block, rows (key and v of each row of the block); and scope, blocks."""
    counts = counted(rows, scope, most)
    return placed(rows, counts, scope, key, vector).groupBy(*scope, "block").agg(F.collect_list("row").alias("rows")), counts


def rounds(parts: int, growth: int = 4) -> Iterator[tuple[int, int]]:
    """From and up to which part each round goes: the first has one, the others what makes ``growth`` times the parts before."""
    first, upto = 0, 1
    while first < parts:
        yield first, min(upto, parts)
        first, upto = upto, upto * growth


def meet(
    left: DataFrame, right: DataFrame, scope: list[str], left_key: list[str], right_key: list[str], values: tuple[str, str],
    sizes: tuple[int, int] | None = None, side: int = SIDE,
) -> DataFrame:
    """scope, _x, _y: each block of left rows (key, v) with each block of right rows of its scope; ``values`` are the columns v, ``sizes`` those of blocks,
    ``side`` the blocks of a tile's side."""
    most = sizes or (LEFT, RIGHT)
    a, a_blocks = _dealt(left, scope, left_key, values[0], most[0])
    b, b_blocks = _dealt(right, scope, right_key, values[1], most[1])
    tiles = a_blocks.select(*scope, F.ceil(F.col("blocks") / side).alias("down")).join(
        b_blocks.select(*scope, F.ceil(F.col("blocks") / side).alias("over")), scope
    )
    tiles = cut(tiles)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    x = a.join(tiles, scope).select(*scope, F.pmod("block", F.col("down")).alias("_r"), spread("over").alias("_c"), F.col("rows").alias("_x"))
    y = b.join(tiles, scope).select(*scope, spread("down").alias("_r"), F.pmod("block", F.col("over")).alias("_c"), F.col("rows").alias("_y"))
    return x.join(y, [*scope, "_r", "_c"]).select(*scope, "_x", "_y")


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    held = rows.column("v")
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _firsts(rows: pa.StructArray, uri: str, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows by uri and then by the order columns, and where each uri begins."""
    columns = pa.table({uri: rows.field(uri), **{o: rows.field(o) for o in order}})
    by = pc.sort_indices(columns, sort_keys=[(uri, "ascending"), *((o, "ascending") for o in order)]).to_numpy()
    names = pc.dictionary_encode(rows.field(uri).take(pa.array(by))).indices.to_numpy()
    return by, np.flatnonzero(np.diff(names, prepend=-1))


def _dealt_rows(left: DataFrame, right: DataFrame, scope: list[str], keys: dict[str, list[str]], vector: str) -> DataFrame:
    """scope, _r, _c, _side, keys and v of each row in each tile it takes part in; a tile's rows lie together, left ones first."""
    sides = {"_x": left, "_y": right}
    counted = lambda df, name, most: df.groupBy(*scope).agg(F.ceil(F.count("*") / most).alias(name))
    tiles = cut(counted(left, "down", TILE[0]).join(counted(right, "over", TILE[1]), scope))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    rows = []
    for side, (name, df) in enumerate(sides.items()):
        own = F.pmod(F.xxhash64(*keys[name]), F.col("over" if side else "down"))
        # the copies of a row are made behind the exchange of its scope's counts; keys get a prefix, as both sides may have the same
        place = (spread("down").alias("_r"), own.alias("_c")) if side else (own.alias("_r"), spread("over").alias("_c"))
        named = [F.col(k).alias(f"{name}{k}") for k in keys[name]]
        rows.append(df.join(tiles, scope).select(*scope, *place, F.lit(side).alias("_side"), *named, F.col(vector).alias("v")))
    tile = [*scope, "_r", "_c"]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).repartition(*tile).sortWithinPartitions(*tile, "_side")


def _tiles(batches: Iterator[pa.RecordBatch], tile: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile, which lie together, as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c) for c in tile]
        begins = np.zeros(n, bool)
        for c in columns:
            begins[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begins[0] = tuple(c[0].as_py() for c in columns) != last
        last = tuple(c[n - 1].as_py() for c in columns)
        cuts = [0, *(np.flatnonzero(begins[1:]) + 1).tolist(), n]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begins[start] and held:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.concat_batches(held)


def products(
    left: DataFrame, right: DataFrame, scope: list[str], left_key: list[str], right_key: list[str], vector: str = "v",
    uri: str | None = None, order: tuple[str, ...] = (), least: float | None = None,
) -> DataFrame:
    """scope, left_key, right_key, sim of pairs within a scope: for each left row the best right row of each
    ``uri`` (the first by ``order`` of equals) of each tile, or all pairs if ``uri`` is None.

    ``least`` leaves out lower similarities. A vector of null takes no part. Rows come one by one, not in packed
    blocks: a worker holds the rows of one tile, about TILE of them, and PRODUCTS products, however many tiles a task has.
    """
    keys = {"_x": left_key, "_y": right_key}
    dealt = _dealt_rows(left.where(F.col(vector).isNotNull()), right.where(F.col(vector).isNotNull()), scope, keys, vector)
    names = [*scope, *left_key, *right_key, "sim"]
    floor = -np.inf if least is None else least

    def pairs(tile: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        many = pc.sum(pc.equal(tile.column("_side"), 0)).as_py()
        if many in (0, tile.num_rows):
            return
        x, y = tile.slice(0, many), tile.slice(many)
        if uri is not None:
            by, starts = _firsts(pa.RecordBatch.from_arrays([y.column(f"_y{c}") for c in (uri, *order)], names=[uri, *order]).to_struct_array(), uri, list(order))
            y = y.take(pa.array(by))
            ends = np.append(starts[1:], len(by)).tolist()
        a, b = _matrix(x), _matrix(y)
        step = max(1, PRODUCTS // len(b))
        for at in range(0, many, step):
            sims = a[at : at + step] @ b.T
            np.round(sims, 12, out=sims)  # sums in another order are equal
            if uri is None:
                i, j = np.nonzero(sims >= floor)
                sim = sims[i, j]
            else:
                best = np.stack([s + sims[:, s:e].argmax(1) for s, e in zip(starts.tolist(), ends, strict=True)], 1)
                sim = np.take_along_axis(sims, best, 1)
                i, k = np.nonzero(sim >= floor)
                sim, j = sim[i, k], best[i, k]
            for part in range(0, len(sim), ROWS):  # all pairs of a tile are many rows
                here, there = pa.array(i[part : part + ROWS] + at), pa.array(j[part : part + ROWS])
                columns = [*(x.column(c).take(here) for c in scope), *(x.column(f"_x{c}").take(here) for c in left_key)]
                yield pa.RecordBatch.from_arrays([*columns, *(y.column(f"_y{c}").take(there) for c in right_key), pa.array(sim[part : part + ROWS])], names=names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # small scopes' rows leave together
        for tile in _tiles(batches, [*scope, "_r", "_c"]):
            for found in pairs(tile):
                held.append(found)
                if sum(f.num_rows for f in held) >= ROWS or len(held) >= 256:
                    yield pa.concat_batches(held)
                    held = []
        if held:
            yield pa.concat_batches(held)

    fields = [*(left.schema[c] for c in scope), *(left.schema[c] for c in left_key), *(right.schema[c] for c in right_key)]
    return dealt.mapInArrow(solve, T.StructType([*fields, T.StructField("sim", T.DoubleType())]))
