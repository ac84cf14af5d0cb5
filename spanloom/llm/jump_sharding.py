"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

The shard of a row depends on its key and the shard count only. Appending shard ``n`` to
shards ``0..n-1`` moves an expected ``1/(n+1)`` of the keys, all of them into the new shard.

Defined results: a null key counts as the empty key (one shard for all of them); a null text
has 0 bytes and the checksum of the empty text; repeated rows each keep a slot of their own;
equal keys share a shard; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint

# Fixed values of the published jump hash: the generator's multiplier, and 2 to the 31.
MULTIPLIER = 2862933555777941757
SPAN = 2147483648.0


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``shards``."""
    state = keys.astype(np.uint64)
    shard = np.full(len(state), -1, np.int64)
    upcoming = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = upcoming[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        upcoming[live] = np.floor((shard[live] + 1) * (SPAN / draw)).astype(np.int64)
        live = live[upcoming[live] < shards]
    return shard


def stable_key(column: Column) -> Column:
    """60 bits of the MD5 of the key as text: the same on every engine and for every key type."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return shard(stable_key(key))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the row's place among the partition's rows of its shard."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        place = np.zeros(len(shards), np.int64)
        for shard in np.unique(shards):
            rows = np.flatnonzero(shards == shard)
            first = seen.get(int(shard), 0)
            place[rows] = np.arange(first, first + len(rows))
            seen[int(shard)] = first + len(rows)
        columns = [*batch.columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(place)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def assign_shards(rows: DataFrame, key: str, text: str, shards: int = 16) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard for every row.

    Slots run without gaps from 0 in each shard, in the order of key, checksum and size. They
    come from one range shuffle of narrow rows (the text stays at the scan): rows are numbered
    within a partition, and partitions are offset by the counts of those before them. A key
    that holds a third of the rows is split by a row number that the checkpoint has fixed.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    narrow = checkpoint(
        rows.select(
            F.col(key).alias("key"),
            (F.octet_length(filled).cast("bigint") + 1).alias("size"),
            F.crc32(filled).alias("text_crc32"),
            shard_of(F.col(key), shards).alias("shard"),
            shard_of(F.col(key), shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = ["shard", "key", "text_crc32", "size", "row"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    schema = f"key {dict(narrow.dtypes)['key']}, size bigint, text_crc32 bigint, shard int, grown_shard int, part int, place bigint"
    numbered = checkpoint(ranged.mapInArrow(_numbered, schema))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("shard", "part")
        .agg(F.count("*").alias("rows"))
        .select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    )
    # offsets: at most one row for each partition and each shard's first partition
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        "key", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"), "grown_shard"
    )
