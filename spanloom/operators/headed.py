"""The best sources of each span by bags of tokens, where all spans meet all chunks.

An equi-join on tokens makes a row of nearly every pair, since nearly all texts share the commonest words. Here
blocks of spans meet blocks of chunks, partition by partition, and a pair is never a row.

A row's outline is its ``HEAD`` commonest tokens, each its share of the norm, and the norms of its other tokens in
``GROUPS`` groups by hash. The product of two outlines is never less than the similarity (Cauchy-Schwarz in each group), so
one matrix product in single precision bounds all pairs of a tile. Only pairs whose bound reaches the span's floor (the
best ``most``-th uri of any block before) are compared token by token; where many do, the ``PROBE`` best bounds go first and
raise the floor. Sums are whole numbers, so similarities are those of the token join to the last bit. Of each tile the best
chunk of each uri, and the first ``most`` uris, leave the task; they are merged by pre-aggregation. Chunks without a common
token count with similarity 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.lineage import cut
from spanloom.operators import blocks
from spanloom.operators.similarity import best_per_source, rank, squared_norm, token_bags
from spanloom.schema import TOP_CANDIDATES

HEAD, GROUPS = 128, 128
ROWS = 128  # spans that are multiplied at once
SIDE = blocks.SIDE  # blocks of chunks in a partition
WIDE = 8  # partitions of spans for each core, at most
PROBE = 32  # pairs of a span and a block that raise its floor first, if over twice as many reach it
SLACK = 1 - 1e-4  # of a floor, for bounds in single precision
DENSE, TOKENS = 1 << 22, 1 << 20  # counts that lie open, and tokens that are compared, at once


def _bagged(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, bag: the squared norm, and the tokens' hashes and counts."""
    counted = token_bags(rows.select(*key, F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t").withColumn("_n", squared_norm())
    ids = F.transform("bag", lambda t: F.xxhash64(t["token"]))
    return counted.select(*key, F.struct(F.col("_n").alias("norm"), ids.alias("ids"), F.transform("bag", lambda t: t["n"]).alias("counts")).alias("bag"))


def common_tokens(bagged: DataFrame, most: int = HEAD) -> np.ndarray:
    """The hashes of the tokens that most rows hold, ``most`` at most, sorted."""
    rows = bagged.select(F.explode("bag.ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return np.sort(np.array([r["id"] for r in rows.orderBy(F.desc("n"), "id").limit(most).collect()], np.int64))


class Block:
    """A block's bags: outlines, and the tokens by row."""

    def __init__(self, rows: pa.StructArray, head: np.ndarray) -> None:
        bag = rows.field("v")
        lists = bag.field("ids")
        self.norm = bag.field("norm").to_numpy(zero_copy_only=False).astype(np.float64)
        offsets = lists.offsets.to_numpy()
        self.starts = (offsets - offsets[0]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.starts))
        self.ids = lists.flatten().to_numpy(zero_copy_only=False)
        self.counts = bag.field("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        place = np.searchsorted(head, self.ids)
        inside = (place < len(head)) & (head[np.minimum(place, len(head) - 1)] == self.ids) if len(head) else np.zeros(len(self.ids), bool)
        share = self.counts / np.sqrt(self.norm[self.row])
        self.outline = np.zeros((len(rows), len(head) + GROUPS), np.float32)
        self.outline[self.row[inside], place[inside]] = share[inside]
        group = self.row[~inside] * GROUPS + (self.ids[~inside].view(np.uint64) % np.uint64(GROUPS)).astype(np.int64)
        self.outline[:, len(head) :] = np.sqrt(np.bincount(group, share[~inside] ** 2, len(rows) * GROUPS)).reshape(len(rows), GROUPS)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The block's distinct tokens, sorted, and each token's place among them."""
        return np.unique(self.ids, return_inverse=True)


class Uris:
    """Chunks that lie by uri from ``starts``; ``order`` ranks uris of one similarity."""

    def __init__(self, starts: np.ndarray, order: np.ndarray, chunks: int) -> None:
        self.starts, self.order = starts, order
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, chunks)))
        self.ranked = np.argsort(order, kind="stable")


def _similarities(spans: Block, chunks: Block, open_: np.ndarray, at: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (at + i, j); ``open_`` has the counts of the spans from ``at`` on by the chunks' distinct tokens."""
    many = chunks.starts[j + 1] - chunks.starts[j]
    ends = np.cumsum(many)
    sums = np.zeros(len(j))
    done = 0
    while done < len(j):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
        part, own = slice(done, upto), many[done:upto]
        held = np.arange(own.sum()) + np.repeat(chunks.starts[j[part]] - (ends[part] - own - before), own)
        counts = open_[np.repeat(i[part], own), chunks.words[1][held]] * chunks.counts[held]
        sums[part] = np.bincount(np.repeat(np.arange(len(own)), own), counts, len(own))
        done = upto
    norms = np.sqrt(spans.norm[at + i] * chunks.norm[j])
    norms[norms == 0] = np.inf  # no tokens: similarity 0
    return sums / norms


def first_uris(i: np.ndarray, j: np.ndarray, sim: np.ndarray, uris: Uris, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j): each i's first ``most`` uris by their best similarity, then by their order, each with its best chunk (the first of equals)."""

    def taken(by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return i[by], j[by], sim[by]

    i, j, sim = taken(np.lexsort((j, -sim, uris.of[j], i)))
    place = i * len(uris.starts) + uris.of[j]
    i, j, sim = taken(np.flatnonzero(np.diff(place, prepend=-1)))
    i, j, sim = taken(np.lexsort((uris.order[uris.of[j]], -sim, i)))
    return taken(np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) < most))


def found(spans: Block, chunks: Block, uris: Uris, floors: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """span, chunk, similarity of each span's first uris in this block, if they may reach its floor. Raises the floors."""
    words = chunks.words[0]
    there = np.searchsorted(words, spans.words[0])
    there[(there == len(words)) | (words[np.minimum(there, len(words) - 1)] != spans.words[0]) if len(words) else slice(None)] = -1
    there = there[spans.words[1]]
    width = len(chunks.norm)
    rows = max(1, min(ROWS, DENSE // max(1, len(words))))
    open_ = np.zeros((rows, len(words)))
    for at in range(0, len(spans.norm), rows):
        floor = floors[at : at + rows]
        outlines = spans.outline[at : at + rows]
        # no span of these can reach its floor in a chunk that their largest shares together do not
        within = np.flatnonzero(chunks.outline @ outlines.max(0) >= floor.min() * SLACK)
        bounds = np.zeros((len(floor), width), np.float32)
        if len(within) < width:
            bounds[:, within] = outlines @ chunks.outline[within].T
        else:
            bounds = outlines @ chunks.outline.T
        near = bounds >= (floor * SLACK)[:, None].astype(np.float32)
        own = slice(spans.starts[at], spans.starts[at + len(floor)])
        shared = there[own] >= 0
        cells = spans.row[own][shared] - at, there[own][shared]
        open_[cells] = spans.counts[own][shared]

        def firsts(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sim = _similarities(spans, chunks, open_, at, i, j)  # noqa: B023
            high = np.flatnonzero(sim >= floor[i])  # noqa: B023
            i, j, sim = first_uris(i[high], j[high], sim[high], uris, most)
            last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == most - 1)
            np.maximum.at(floor, i[last], sim[last])  # noqa: B023
            return i, j, sim

        many = np.flatnonzero(np.count_nonzero(near, 1) > 2 * PROBE)
        if len(many):
            best = np.argpartition(bounds[many], width - PROBE, axis=1)[:, width - PROBE :]
            firsts(np.repeat(many, PROBE), best.ravel())
            near[many] = bounds[many] >= (floor[many] * SLACK)[:, None].astype(np.float32)
        for n in np.flatnonzero(floor <= 0):  # uris without a common token take part, as far as they can rank
            near[n] = bounds[n] > 0
            held = np.logical_or.reduceat(near[n], uris.starts)
            near[n, uris.starts[held]] = True  # the first chunk is the best of those that share no token after all
            near[n, uris.starts[uris.ranked[~held[uris.ranked]][:most]]] = True
        i, j, sim = firsts(*np.divmod(np.flatnonzero(near), width))
        yield i + at, j, sim
        open_[cells] = 0


def merged(pairs: pa.Table, most: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Each span's (``_i``) first ``most`` uris by similarity and first_ord, each with its best chunk; and the spans that have as many, with the last one's similarity."""
    column = lambda c: pairs.column(c).to_numpy()
    i, sim = column("_i"), column("sim")
    uri = pc.dictionary_encode(pairs.column("uri").combine_chunks()).indices.to_numpy()
    by = np.lexsort((column("chunk_ord"), column("uri_ord"), -sim, uri, i))
    by = by[np.flatnonzero((np.diff(uri[by], prepend=-1) != 0) | (np.diff(i[by], prepend=-1) != 0))]
    by = by[np.lexsort((column("first_ord")[by], -sim[by], i[by]))]
    place = np.arange(len(by)) - np.searchsorted(i[by], i[by])
    by, last = by[place < most], by[place == most - 1]
    return pairs.take(pa.array(by)), i[last], sim[last]


def best_uris(spans: DataFrame, chunks: DataFrame, scope: list[str], span_key: list[str], chunk_key: list[str], most: int = TOP_CANDIDATES) -> DataFrame:
    """scope, span_key, chunk_key, first_ord, sim: each span's ``most`` first uris, each with its best chunk.

    ``spans`` has scope, span_key, text; ``chunks`` has scope, chunk_key (with uri, uri_ord, chunk_ord), chunk. Uris rank by
    similarity and then by their smallest uri_ord (first_ord); chunks of a uri by similarity, uri_ord and chunk_ord.

    A block is written once and read by each task that needs it (a Cartesian product of partitions; no copy goes by way of a
    shuffle). Chunks take part in rounds, each of a few times the chunks before: a round starts with the floors of the last, so that
    it returns few rows of a span however many tasks it has.
    """
    firsts = chunks.groupBy(*scope, "uri").agg(F.min("uri_ord").alias("first_ord"))
    key, right_key = [*scope, *span_key], [*chunk_key, "first_ord"]
    right = cut(_bagged(chunks, [*scope, *chunk_key], "chunk").join(firsts, [*scope, "uri"]))
    left = _bagged(spans, key, "text")
    head = common_tokens(right)
    left_counts, right_counts = cut(blocks.counted(left, scope, blocks.LEFT)), cut(blocks.counted(right, scope, blocks.RIGHT))
    many = lambda counts: int(counts.agg(F.sum("blocks")).first()[0] or 1)
    wide = min(many(left_counts), WIDE * spans.sparkSession.sparkContext.defaultParallelism)  # partitions of the spans
    parts = -(-many(right_counts) // SIDE)  # partitions of the chunks, SIDE blocks in each
    held = lambda rows: rows.repartition(wide, *scope, "block").groupBy(*scope, "block")
    asked = cut(held(blocks.placed(left, left_counts, scope, span_key, "bag")).agg(F.collect_list("row").alias("_x")))
    pool = blocks.placed(right, right_counts, scope, right_key, "bag")
    part = F.pmod(F.pmod(F.xxhash64(*scope), F.lit(parts)) + F.col("block"), F.lit(parts))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple] = {}  # the last blocks met, unpacked: a block of spans comes with all of the task's blocks of chunks
        x_name, floor, best = None, np.zeros(0), None

        def met_again(name: tuple, made: Callable[[], tuple]) -> tuple:
            kept[name] = kept.pop(name) if name in kept else made()
            if len(kept) > SIDE + 1:
                kept.pop(next(iter(kept)))
            return kept[name]

        def span_block(x: pa.StructArray) -> tuple:
            by = np.argsort(Block(x, head).outline[:, : max(1, len(head))].argmax(1), kind="stable")  # like ones lie together
            x = x.take(pa.array(by))
            return x, Block(x, head)

        def chunk_block(y: pa.StructArray) -> tuple:
            by, starts = blocks._firsts(y, "uri", ["uri_ord", "chunk_ord"])
            y = y.take(pa.array(by))
            return y, Block(y, head), Uris(starts, y.field("first_ord").to_numpy(zero_copy_only=False)[starts], len(y))

        def keys_of(rows: pa.StructArray) -> Iterator[tuple]:
            return zip(*(rows.field(k).to_pylist() for k in span_key), strict=True)

        def left_of(best: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from best.drop_columns("_i").combine_chunks().to_batches()

        for batch in batches:
            for at in range(batch.num_rows):
                x, low, y = (batch.column(c).slice(at, 1).flatten() for c in ("_x", "_low", "_y"))
                here = [batch.column(c)[at].as_py() for c in scope]
                name = ("x", *here, *(x.field(k)[0].as_py() for k in span_key), len(x))
                x, spans_ = met_again(name, lambda x=x: span_block(x))
                if name != x_name:
                    if best is not None:
                        yield from left_of(best)
                    lows = dict(zip(keys_of(low), low.field("v").to_pylist(), strict=True))
                    x_name, floor, best = name, np.array([lows.get(k, 0.0) for k in keys_of(x)]), None
                name = ("y", *here, *(y.field(k)[0].as_py() for k in right_key), len(y))
                y, chunks_, uris = met_again(name, lambda y=y: chunk_block(y))
                i, j, sim = (np.concatenate(part) for part in zip(*found(spans_, chunks_, uris, floor, most), strict=True))
                scoped = [batch.column(c).take(pa.array(np.full(len(i), at))) for c in scope]
                pairs = [*(x.field(k).take(pa.array(i)) for k in span_key), *(y.field(k).take(pa.array(j)) for k in right_key)]
                new = pa.Table.from_arrays([*scoped, *pairs, pa.array(sim), pa.array(i)], names=[*key, *right_key, "sim", "_i"])
                best, full, sims = merged(new if best is None else pa.concat_tables([best, new]), most)
                floor[full] = np.maximum(floor[full], sims)
        if best is not None:
            yield from left_of(best)

    fields = [*(left.schema[c] for c in key), *(right.schema[c] for c in right_key)]
    low_of = T.StructType([*(left.schema[c] for c in span_key), T.StructField("v", T.DoubleType())])
    best = None
    for first, upto in blocks.rounds(parts):
        own = pool.where((part >= first) & (part < upto)).groupBy(*scope, "block").agg(F.collect_list("row").alias("_y"))
        y = cut(own.repartitionById(upto - first, (part - first).cast("int"))).drop("block")
        if best is None:
            x = asked.withColumn("_low", F.array().cast(T.ArrayType(low_of)))
        else:  # the last uri of each span that has as many as are asked for
            lows = blocks.placed(best.where(F.col("rank") == most), left_counts, scope, span_key, "sim").withColumnRenamed("row", "_low")
            x = held(asked.unionByName(lows, allowMissingColumns=True)).agg(F.first("_x", True).alias("_x"), F.collect_list("_low").alias("_low"))
        met = x.drop("block").hint("shuffle_replicate_nl").join(y, scope).select(*scope, "_x", "_low", "_y")
        made = met.mapInArrow(solve, T.StructType([*fields, T.StructField("sim", T.DoubleType())]))
        both = made if best is None else made.unionByName(best.drop("rank"))
        best = cut(rank(best_per_source(both, key, order=("uri_ord", "chunk_ord")), key, ["first_ord"], most))
    return best.drop("rank")
