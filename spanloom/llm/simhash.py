"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint holds the majority bit of the XXH64 hashes of a text's word shingles. Two
fingerprints that differ in at most two bits, cut in two halves, have a half that differs in at
most one bit: they share that half as it is, or with one bit masked out. Each distinct
fingerprint is indexed under both halves and their 32 masked variants, equal keys are joined,
and every candidate pair is verified on all 64 bits.

Links hold between distinct fingerprints; copies follow theirs, so a group of thousands of
copies is one row here. A key that holds more than ``most`` fingerprints is not paired up: its
members get exact sub-keys (the masked bits of the other half), whose groups are linked by
construction, and hang on the smallest member; the rows stay linear in the group's size.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other;
fewer words than the shingle's width are one shingle; repeated rows are linked rows; a null
doc_id is kept, and is a component's id only if no other is there; an empty table gives an
empty table; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, map_texts, slices, texts
from spanloom.llm.components import components

SEED = 42
HALF = 0xFFFFFFFF


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of the text, A-Z in lower case; words are split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    return [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 3) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = shingles(text, width)
    return majority(np.array([digest(s, SEED) for s in found], np.uint64)) if found else 0


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, mark (XXH64 of the text), fp (as a signed 64-bit number)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def stamped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in texts(batch.column("text"))], np.uint64)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp"])

    given = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return map_texts(given, stamped, f"doc_id {kind}, mark bigint, fp bigint")


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keyed(fps: DataFrame) -> DataFrame:
    """fp, half, bit (-1: none masked), key: 66 rows for each fingerprint."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(HALF))
    bits = F.array(*[F.lit(b) for b in range(-1, 32)])
    halves = F.array(F.struct(F.lit(0).alias("half"), high.alias("v")), F.struct(F.lit(1).alias("half"), low.alias("v")))
    rows = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.v", F.explode(bits).alias("bit"))
    mask = F.when(F.col("bit") < 0, F.lit(HALF)).otherwise(F.expr(f"{HALF}L ^ shiftleft(1L, bit)"))
    # half, bit and masked value in one number: 1, 6 and 32 bits
    tag = F.col("half") * 64 + F.col("bit") + 1
    return rows.select("fp", (tag.cast("bigint") * (1 << 32) + F.col("v").bitwiseAND(mask)).alias("key"))


def _subkeyed(rows: DataFrame) -> DataFrame:
    """For members of a large group: fp, key, sub. All members of one (key, sub) are links.

    With one bit of this half masked, the other half may differ in one bit: it is masked in each
    place. With none masked, it may differ in two: each pair of places is masked.
    """
    tag = F.shiftrightunsigned("key", 32).cast("int")
    half = F.when(tag >= 64, 1).otherwise(0)
    exact = tag % 64 == 0
    other = F.when(half == 0, F.col("fp").bitwiseAND(F.lit(HALF))).otherwise(F.shiftrightunsigned("fp", 32))
    one = [HALF ^ (1 << i) for i in range(32)]
    two = [HALF ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(i)]
    masks = F.when(exact, F.array(*[F.lit(m).cast("bigint") for m in two])).otherwise(F.array(*[F.lit(m).cast("bigint") for m in one]))
    spread = rows.select("fp", "key", other.alias("o"), F.explode(masks).alias("mask"))
    return spread.select("fp", "key", F.struct("mask", F.col("o").bitwiseAND(F.col("mask")).alias("o")).alias("sub"))


def near_links(fps: DataFrame, most: int = 256) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of at most two differing bits."""
    keyed = _keyed(fps)
    # counts combine before the shuffle, and the join splits a hot key: no task holds all of one key
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = checkpoint(keyed.join(sizes, "key"))
    few = shared.where(F.col("size") <= most)
    tag = F.shiftrightunsigned("key", 32).cast("int")
    # the masked bit must differ: a pair that shares the whole half is found under that half alone
    place = (tag % 64 - 1) + F.when(tag < 64, 32).otherwise(0)
    masked = few.withColumn("bit", F.when(tag % 64 == 0, F.lit(0)).otherwise(F.expr("1") + place))
    one = lambda fp, bit: F.when(F.col(bit) == 0, 0).otherwise(F.call_function("shiftrightunsigned", fp, F.col(bit) - 1).bitwiseAND(F.lit(1)))
    a = masked.select("key", F.col("fp").alias("a"), one(F.col("fp"), "bit").alias("a_bit"), "bit")
    b = masked.select(F.col("key"), F.col("fp").alias("b"), one(F.col("fp"), "bit").alias("b_bit"))
    apart = F.when(F.col("bit") == 0, F.col("a") < F.col("b")).otherwise((F.col("a_bit") == 0) & (F.col("b_bit") == 1))
    pairs = a.join(b, "key").where(apart & (_differing(F.col("a"), F.col("b")) <= 2)).select("a", "b")
    subs = _subkeyed(shared.where(F.col("size") > most).select("fp", "key"))
    least = subs.groupBy("key", "sub").agg(F.min("fp").alias("a"))
    stars = subs.join(least, ["key", "sub"]).where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 256) -> DataFrame:
    """doc_id, mark, fp, root, component_id for every row.

    component_id is the smallest doc_id reachable, root the smallest fingerprint.
    """
    stamped = checkpoint(fingerprints(docs, width))
    distinct = checkpoint(stamped.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(named.join(least, "root").select("fp", "root", "component_id"))
    return stamped.join(named, "fp", "left").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last)."""
    found = near_duplicates(docs, width)
    return kept_rows(docs, found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")))


def kept_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """One row of ``docs`` for each r (none, doc_id, mark) of ``first``, with all its columns."""
    kept = first.select(F.col("r.doc_id").alias("id"), F.col("r.mark").alias("mark"))
    # the row is one column, so that none of its columns can clash with these names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("mark")))
    return met.dropDuplicates(["id", "mark"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def hexed(fp: str) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
