"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised once, each followed by a separator id. Whole windows are cut off a
document's front; the rest goes, in pieces of falling sizes (``piece``), into a block of windows
that differencing balances: the two partial partitions with the largest spread merge with
their sums in opposite order, until one partition is left. Its sums are near equal, so almost
no window is padded. Where the largest sum exceeds the window, the block gets one more window.

The work streams through each input partition, with no shuffle; a retried task makes the same
rows, since a block never leaves its partition.

Defined results: a null or empty text is one separator; each row is packed on its own, repeated
or not; a null doc_id is kept; an empty table gives no piece; other columns are not read. The
size of a text is not limited.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spanloom.llm.common import map_texts

WINDOW = 1024
PIECE, LEAST_PIECE = 256, 4
BLOCK = 64  # windows that are balanced together
SLACK = 2  # ids a window of a full block leaves free on average, so that near-equal sums fit
SEPARATOR = 0

SCHEMA = (
    "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint, padded_length bigint"
)


def difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Items of each bin after multiway differencing; every bin is listed, empty or not."""
    if bins == 1:
        return [list(range(len(sizes)))]
    # A partition: its non-zero sums, largest first, with their items; missing sums are zero.
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for item, size in enumerate(sizes):
        heap.append((-size, item, [(size, [item])]))
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # opposing imbalances: the largest sum of one meets the smallest (or no) sum of the other
        overlap = len(a) + len(b) - bins
        if overlap <= 0:
            merged = a + b
        else:
            lone_a, lone_b = a[: len(a) - overlap], b[: len(b) - overlap]
            pairs = zip(a[len(a) - overlap :], reversed(b[len(b) - overlap :]), strict=True)
            merged = lone_a + lone_b + [(x[0] + y[0], x[1] + y[1]) for x, y in pairs]
        merged.sort(key=lambda part: -part[0])
        low = merged[-1][0] if len(merged) == bins else 0
        heapq.heappush(heap, (low - merged[0][0], stamp, merged))
        stamp += 1
    bins_used = [items for _, items in heap[0][2]] if heap else []
    return bins_used + [[] for _ in range(bins - len(bins_used))]


def balance(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Near-equal bins of at most ``window``; one bin more each time the largest exceeds it."""
    bins = max(1, -(-sum(sizes) // window))
    while True:
        found = difference(sizes, bins)
        if all(sum(sizes[i] for i in items) <= window for items in found):
            return [items for items in found if items]
        bins += 1


def padded(length: int, window: int = WINDOW) -> int:
    return length if length & (length - 1) == 0 else window


def piece(left: int) -> int:
    """Ids of the next piece: two thirds of those left. Sizes of all kinds are what differencing evens out."""
    return min(PIECE, left, max(LEAST_PIECE, -(-2 * left // 3)))


class Encoder:
    """Ids of byte_bpe_50k for batches of texts; each distinct chunk of a batch is encoded once.

    A blank between two non-blanks always begins a pre-token, so a text may be cut there and its
    chunks encoded one by one. Chunks of Latin letters and ASCII go through the ranked form of the
    same vocabulary, which is several times faster and gives the same ids; all others go through
    the JSON form. A text that holds the string of a special token goes through the JSON form whole.
    """

    def __init__(self, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_tokenizers.path(json_name))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < "ɐ":
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def _careful(self, text: str) -> np.ndarray:
        """Cuts only at blanks between two non-blanks; what touches a blank run stays whole."""
        held, out = [], []
        parts = text.split(" ")
        for k, part in enumerate(parts):
            held.append(part)
            last = k + 1 == len(parts)
            if last or (part and not part[-1].isspace() and parts[k + 1] and not parts[k + 1][0].isspace()):
                out.append(self.encode(("" if not out else " ") + " ".join(held)))
                held = []
        return np.concatenate(out)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, each with its blank before; where each begins; how many."""
        count, ids, at = np.zeros(len(chunks), np.int64), [], 0
        start = np.zeros(len(chunks), np.int64)
        foreign = pc.match_substring_regex(chunks, "[^\\x00-\\x{24F}]").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~foreign)
        if len(plain):
            group = chunks.take(pa.array(plain))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group), " ")
            found = self.fast.encode_to_numpy(f" {joined[0].as_py()}", disallowed_special=())
            cuts = np.cumsum(pc.binary_length(group).to_numpy().astype(np.int64) + 1)
            ends = np.searchsorted(np.cumsum(self.width[found]), cuts, "right")
            start[plain], count[plain] = ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)
            ids.append(found)
            at = len(found)
        others = np.flatnonzero(foreign)
        coded = self.exact.encode_batch([f" {c}" for c in chunks.take(pa.array(others)).to_pylist()], add_special_tokens=False)
        for k, one in zip(others, coded, strict=True):
            start[k], count[k] = at, len(one.ids)
            ids.append(np.array(one.ids, np.uint32))
            at += len(one.ids)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), start, count

    def batch(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn; null gives none."""
        column = pc.fill_null(column.cast(pa.string()), "")
        split = pc.split_pattern(column, " ")
        offsets, chunks = split.offsets.to_numpy(), split.values
        coded = chunks.dictionary_encode()
        word, distinct = coded.indices.to_numpy(), coded.dictionary
        edged = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(distinct), distinct), pc.equal(distinct, ""))
        edged = edged.to_numpy(zero_copy_only=False)
        usable = distinct.filter(pa.array(~edged))
        ids, start, count = np.zeros(0, np.uint32), np.zeros(len(edged), np.int64), np.zeros(len(edged), np.int64)
        ids, start[~edged], count[~edged] = self._distinct(usable)
        special = np.zeros(len(column), bool)
        for token in self.special:
            special |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        for k in range(len(column)):
            own = word[offsets[k] : offsets[k + 1]]
            if special[k]:
                yield np.array(self.exact.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
                continue
            if len(own) < 2 or edged[own].any():
                text = column[k].as_py()
                yield self._careful(text) if text else np.zeros(0, np.uint32)
                continue
            rest = own[1:]
            many = count[rest]
            total = int(many.sum())
            place = np.repeat(start[rest] - (np.cumsum(many) - many), many) + np.arange(total)
            yield np.concatenate([self.encode(distinct[int(own[0])].as_py()), ids[place]])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(json_name: str, ranks_name: str) -> Encoder:
    """One encoder for each worker process."""
    if (json_name, ranks_name) not in _ENCODERS:
        _ENCODERS[json_name, ranks_name] = Encoder(json_name, ranks_name)
    return _ENCODERS[json_name, ranks_name]


class _Packer:
    """Packs the documents of one partition in the order they come."""

    def __init__(self, part: int, window: int):
        self.next_id = part << 33
        self.window = window
        self.pieces: list[tuple] = []  # of the open block: doc_id, start, length, crc, doc_tokens
        self.total = 0
        self.rows: list[tuple] = []
        self.room = BLOCK * (window - min(SLACK, window - 1))

    def _close(self) -> None:
        for items in balance([p[2] for p in self.pieces], self.window) if self.pieces else []:
            length, offset = sum(self.pieces[i][2] for i in items), 0
            for i in items:
                self.rows.append((*self.pieces[i], self.next_id, offset, padded(length, self.window)))
                offset += self.pieces[i][2]
            self.next_id += 1
        self.pieces, self.total = [], 0

    def add(self, doc_id, ids: bytes) -> None:
        tokens, at = len(ids) // 4, 0
        view = memoryview(ids)
        crc = lambda start, length: zlib.crc32(view[4 * start : 4 * (start + length)])
        while tokens - at >= self.window:
            self.rows.append((doc_id, at, self.window, crc(at, self.window), tokens, self.next_id, 0, self.window))
            self.next_id += 1
            at += self.window
        while at < tokens:
            length = min(piece(tokens - at), self.room - self.total)
            self.pieces.append((doc_id, at, length, crc(at, length), tokens))
            self.total += length
            at += length
            if self.total == self.room:
                self._close()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    json_name: str = "byte_bpe_50k.json",
    ranks_name: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``padded_length`` is the length of the piece's whole sequence with padding: the window, or
    the sum of its pieces where that is a power of two.
    """
    id_type = docs.select("doc_id").schema[0].dataType
    schema = SCHEMA.format(id=id_type.simpleString())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_name, ranks_name)
        packer = _Packer(TaskContext.get().partitionId(), window)

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            keys = batch.column("doc_id").to_pylist()
            for k, ids in enumerate(encode.batch(batch.column("text"))):
                packer.add(keys[k], np.append(ids, np.uint32(SEPARATOR)).astype("<u4").tobytes())
                if k % 1024 == 1023 and (rows := packer.take()):
                    yield out(rows, kind)
            if rows := packer.take():
                yield out(rows, kind)
        packer._close()
        if rows := packer.take():
            yield out(rows, kind)

    return map_texts(docs.select("doc_id", "text"), packed, schema)
