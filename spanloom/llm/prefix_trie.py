"""Prefix trie of conversations by Patricia construction.

A conversation is the sequence of its turns' digests. Distinct sequences are sorted over range
partitions; each partition is swept once with a stack, and only branch, end and leaf points are made, with
the edge above each kept as the sizes of its turns. Aggregates are summed on this compressed tree;
unary nodes are expanded last, their sums by suffix sums along the edge.

Sequences of neighbouring partitions share a prefix: its nodes (the spine) have members in both. Each
partition is told how far it shares with the one before and after (one number for each), makes every spine node
a point of its own, and counts a node's bytes and a parent's child only where the node is met first. All sums
then add up over partitions, and only spine points are grouped by their node. A second sweep in the opposite
order, parents first, hands each node its parent's smallest member. So the root, or a first turn that a third
of all conversations share, is a row of each partition, not a group of its members.

Members that end at one node are listed in order by a range sort over (sequence, id), joined to pieces of
at most ``PIECE`` ids where they are sorted, and the pieces are hashed in order; a task holds one piece of a list.

What is held in one row: the digests and sizes of a conversation's turns (24 bytes a turn), never
their texts.

Defined results: rows without an id take no part; turns go by their number, null first, equal ones by digest;
null role or text is empty; a repeated row is a repeated turn; a conversation whose rebuilt form has no turns
is a member of the root alone; an empty table gives an empty one (no root); other columns are not read. Texts are
read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint

TOKEN = 16  # bytes of a turn's digest
PIECE = 65_536
BATCH = 4096
NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: for each conversation its turns' (digest, bytes) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TOKEN)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"),
    )
    # conversations of one base share a partition, so that rebuilding needs no other shuffle
    rows = rows.withColumn("base", _base("conv_id")).repartition("base")
    lists = rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def _base(conv: str) -> Column:
    return F.col(conv) - F.col(conv) % 5


def rebuilt(lists: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of the base conversation, then what follows the own first h; h is a checksum of the id, modulo 9."""
    base = Window.partitionBy("base")  # at most five rows
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(base)
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return lists.withColumn("head", head).withColumn("h", h).select("conv_id", F.concat(first, rest).alias("turns"))


def _keyed(convs: DataFrame) -> DataFrame:
    """conv_id, key (the digests in a row), sizes, seq (the key's digest)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    return rows.withColumn("seq", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * TOKEN)))


def ends_digests(convs: DataFrame) -> DataFrame:
    """seq, sha: SHA-256 of the comma-joined ids, ascending, of the conversations that are this sequence."""
    ordered = convs.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, own = TaskContext.get().partitionId(), 0, [], None

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            arrays = [pa.array([own], pa.binary()), pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([",".join(held)])]
            return pa.RecordBatch.from_arrays(arrays, names=["seq", "part", "place", "ids"])

        for batch in batches:
            for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (seq != own or len(held) == PIECE):
                    yield out()
                    held = []
                own = seq
                held.append(str(conv))
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            done = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if seq != own:
                    if own is not None:
                        done.append((own, state.hexdigest()))
                    own, state = seq, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(done, ENDS)
        if own is not None:
            yield _batch([(own, state.hexdigest())], ENDS)

    cut = ordered.mapInArrow(pieces, "seq binary, part int, place bigint, ids string")
    return cut.repartition("seq").sortWithinPartitions("seq", "part", "place").select("seq", "ids").mapInArrow(hashed, "seq binary, sha string")


ENDS = pa.schema([("seq", pa.binary()), ("sha", pa.string())])
POINTS = pa.schema([
    ("part", pa.int32()), ("place", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("least", pa.int64()),
    ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("sha", pa.string()), ("edge", pa.list_(pa.int64())),
    ("shared", pa.bool_()), ("owned", pa.bool_()),
])
POINT = (
    "part int, place bigint, depth bigint, node binary, n bigint, least bigint, kids bigint, leaves bigint, saved bigint, sha string, "
    "edge array<bigint>, shared boolean, owned boolean"
)
NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:  # prefixes are alike up to some length
        middle = (low + high + 1) // 2
        if a[low * TOKEN : middle * TOKEN] == b[low * TOKEN : middle * TOKEN]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    """An open point of the sweep: sums over what is closed below it."""

    __slots__ = ("depth", "n", "least", "kids", "met", "leaves", "saved", "sha")

    def __init__(self, depth: int, n: int = 0, least: int | None = None, sha: str | None = None) -> None:
        self.depth, self.n, self.least, self.sha = depth, n, least, sha
        self.kids = self.met = self.leaves = self.saved = 0  # children counted here, and met here


class Sweep:
    """Patricia points of sorted, distinct sequences, children before their parents.

    ``left`` and ``right`` tell how many turns the first and the last sequence share with the
    partitions around (-1: there is none).
    """

    def __init__(self, left: int, right: int) -> None:
        self.left, self.right = left, right
        self.key, self.sizes, self.nodes = b"", [], [b""]
        self.stack = [_Point(0)]
        self.spine = -1  # turns that the path shares with the first sequence; none yet

    def rows(self, sequences: Iterator[tuple[bytes, list[int], int, int, str]]) -> Iterator[tuple]:
        first = True
        for key, sizes, n, least, sha in sequences:
            shared = common_turns(self.key, key)
            if first:
                self.spine, first = len(sizes), False
            else:
                yield from self._close(shared, -1)
                self.spine = min(self.spine, shared)
            del self.nodes[shared + 1 :]
            for at in range(shared, len(sizes)):
                self.nodes.append(hashlib.blake2b(self.nodes[-1] + key[at * TOKEN : (at + 1) * TOKEN], digest_size=16).digest())
            self.key, self.sizes = key, sizes
            if sizes:
                self.stack.append(_Point(len(sizes), n, least, sha))
            else:  # the first sequence alone can be empty
                self.stack[0].n, self.stack[0].least, self.stack[0].sha = n, least, sha
        if not first:
            yield from self._close(0, self.right)
            root, shared = self.stack[0], max(self.left, self.right) >= 0
            root.leaves += not root.met and not shared
            yield 0, b"", root.n, root.least, root.kids, root.leaves, root.saved, root.sha, [0], shared, self.left < 0

    def _close(self, depth: int, right: int) -> Iterator[tuple]:
        """Closes all points deeper than ``depth``, which becomes a point if one was."""
        foreign = min(self.left, self.spine)  # nodes up to here are met in a partition before
        spine = max(foreign, right)
        while self.stack[-1].depth > depth:
            own = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth))
            above = self.stack[-1]
            own.leaves += not own.met and own.depth > spine
            at, kids, sha, total = own.depth, own.kids, own.sha, own.saved
            while at > above.depth:
                low = max(above.depth, spine) if at > spine else at - 1
                edge = self.sizes[low:at][::-1]
                total += own.n * edge[0] - (edge[0] if at > foreign else 0)
                yield at, self.nodes[at], own.n, own.least, kids, own.leaves, total, sha, edge, at <= spine, at > foreign
                total += (own.n - 1) * sum(edge[1:])  # an edge of more than one node lies below the spine
                kids, sha, at = int(low + 1 > foreign), None, low
            above.n += own.n
            above.least = own.least if above.least is None else min(above.least, own.least)
            above.met += 1
            above.kids += above.depth + 1 > foreign
            above.leaves += own.leaves
            above.saved += total


def _points(numbered: DataFrame, left: dict[int, int], right: dict[int, int]) -> DataFrame:
    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None

        def read() -> Iterator[tuple[Any, ...]]:
            nonlocal part
            for batch in batches:
                if batch.num_rows and part is None:
                    part = batch.column("part")[0].as_py()
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "n", "least", "sha")), strict=True)

        given = read()
        first = next(given, None)
        if first is None:
            return
        held = []

        def chained() -> Iterator[tuple[Any, ...]]:
            yield first
            yield from given

        for place, point in enumerate(Sweep(left[part], right[part]).rows(chained())):
            held.append((part, place, *point))
            if len(held) == BATCH:
                yield _batch(held, POINTS)
                held = []
        yield _batch(held, POINTS)

    return numbered.mapInArrow(swept, POINT)


def expand(points: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes of points (part, depth, n, least, kids, leaves, saved, sha, edge, owned) that come parents first."""
    path, own_part = [], None
    for part, depth, n, least, kids, leaves, saved, sha, edge, owned in points:
        if part != own_part:
            path, own_part = [], part
        above = depth - len(edge)
        while path and path[-1][0] > above:
            path.pop()
        parent = path[-1][1] if path else None
        path.append((depth, least))
        if owned:
            for k, size in enumerate(edge):
                if k:
                    saved += (n - 1) * size  # the suffix sum of the edge
                top = k == len(edge) - 1
                yield least, depth - k, parent if top else least, n, 1 if k else kids, leaves, saved, (None if k else sha) or NONE


def _nodes(points: DataFrame) -> DataFrame:
    names = ("part", "depth", "n", "least", "kids", "leaves", "saved", "sha", "edge", "owned")

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        held = []
        for node in expand(given):
            held.append(node)
            if len(held) == BATCH:
                yield _batch(held, NODES)
                held = []
        yield _batch(held, NODES)

    ordered = points.repartition("part").sortWithinPartitions("part", F.desc("place"))
    return ordered.select(*names).mapInArrow(expanded, NODE)


def _borders(numbered: DataFrame) -> list[tuple[int, int]]:
    """For each partition with rows, in order, its number and the turns its first sequence shares with the last one before (-1: none)."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("first").to_pylist(), batch.column("before").to_pylist(), strict=True)
            turns = [-1 if before is None else common_turns(first, before) for first, before in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(turns, pa.int64())], names=["part", "turns"])

    ends = numbered.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))  # one row for each partition
    lined = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    found = lined.select("part", "first", "before").mapInArrow(shared, "part int, turns bigint").orderBy("part").collect()
    return [(r["part"], r["turns"]) for r in found]


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns)."""
    keyed = checkpoint(_keyed(convs))
    distinct = keyed.groupBy("seq").agg(F.first("key").alias("key"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    named = distinct.join(ends_digests(keyed), "seq").select("key", "sizes", "n", "least", "sha")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32())], names=[*batch.schema.names, "part"])

    ranged = checkpoint(named).repartitionByRange("key").sortWithinPartitions("key")
    ordered = checkpoint(ranged.mapInArrow(numbered, "key binary, sizes array<bigint>, n bigint, least bigint, sha string, part int"))
    borders = _borders(ordered)
    left = dict(borders)
    right = dict(zip(left, [*left.values(), -1][1:], strict=True))
    points = checkpoint(_points(ordered, left, right))
    spine = points.where("shared")
    totals = spine.groupBy("depth", "node").agg(
        *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.min("least").alias("least"), F.max("sha").alias("sha")
    )
    whole = spine.select("part", "place", "depth", "node", "edge", "shared", "owned").join(totals, ["depth", "node"])
    return _nodes(points.where("not shared").unionByName(whole))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations."""
    return trie(rebuilt(sequences(conversations)))
