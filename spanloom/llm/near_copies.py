"""Near copies by the Jaccard similarity of five-word shingles, 0.8 or more.

Op7's method comes first: each set has a SimHash fingerprint, and fingerprints of at most two differing
bits meet by their halves with one masked bit (``simhash.near_links``). Sets of such fingerprints are
compared whole, so that copies with few edits are one component before anything else is compared. Sets that
share no key with any other (below) have no near copies and are left out.

At a similarity of 0.8 fingerprints differ in about ten bits, too many for segments that one differing
bit leaves alike. So what op7 leaves apart is found by the same signatures over minimum hashes in place of bits. A text's
``SEGMENTS`` * ``PER`` minimum hashes of its shingle set are cut into segments, and each segment is
indexed with one value masked out, in each place. Two sets share such a key where a segment differs
in at most one value; at a similarity of 0.8 exactly, one pair in a million shares none, at 0.85
one in 10^9. Sets that share a key are compared whole, so no link is wrong.

Links are wanted for their components alone. In a star round each set is compared with one set of
another component with which it shares a key: in the first round the one that shares the most keys
(what edits were made from shares more with each of them than they share with one another), then
others by a hash. Rounds go on, ``rounds`` at most, while the pairs left are more than ``LEFT`` for
each row of a key and a round still links some. Groups of copies thus need a comparison for each copy, not for
each pair. The sets that are left get a wide sketch, ``WIDE`` minimum hashes of four bits. Of the pairs that
share a key and still lie in two components, those whose sketches differ in at most ``APART`` places are
compared whole: of pairs at 0.8 exactly one in thirty thousand is missed, of those at 0.65 one in two thousand is compared. So
texts made from one template that are not near copies cost a bit count a pair, where they meet, and no row.
Keys of many sets are salted. All of it is joins and aggregates; nothing is gathered.

Defined results: null, empty and blank texts are copies of one another; fewer than five words are
one shingle; case of A-Z and white space do not count; a null doc_id is kept, last in its group;
other columns are kept whatever their names; an empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, map_texts, slices
from spanloom.llm.components import components
from spanloom.llm.simhash import kept_rows, majority, near_links

WIDTH = 5
SEGMENTS, PER = 13, 6
ROUNDS, LEFT = 8, 2
FRUITLESS = 32  # a star round that links fewer than one pair in so many is the last
FEW = 500_000  # rows of two numbers that may be sent to every executor
SALTED = 1024  # partners of one set, or sets of one key, that a task compares with it or with all others
WIDE, APART = 512, 134  # minimum hashes of a wide sketch, and of their nibbles what two sets that are compared whole may differ in
FIRST, FIRST_APART = 80, 31  # the same of the first of them, which are compared first
STEP = np.uint64(0x100000001B3)
_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, (4, SEGMENTS * PER), np.int64).view(np.uint64)
SALT, ODD, TAG = _RANDOM[0], _RANDOM[1] | np.uint64(1), _RANDOM[2:]
_WIDE = np.random.default_rng(6).integers(0, 1 << 63, (2, WIDE), np.int64).view(np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; distinct words are hashed once."""
    import xxhash

    lower = pc.ascii_lower(pc.fill_null(column.cast(pa.string()), ""))
    split = pc.ascii_split_whitespace(lower)
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11) for w in distinct], np.uint64)
    blank = np.array([w == "" for w in distinct], bool)
    word = coded.indices.to_numpy()
    for k in range(len(column)):
        own = word[offsets[k] : offsets[k + 1]]
        own = code[own[~blank[own]]]
        width = min(WIDTH, len(own))
        many = len(own) - width + 1 if len(own) else 0
        value = np.full(many, np.uint64(width))
        for j in range(width):
            value = (value ^ own[j : j + many]) * STEP
            value ^= value >> np.uint64(29)
        yield np.unique(value)


def sketch(held: np.ndarray, salt: np.ndarray = SALT, odd: np.ndarray = ODD) -> np.ndarray:
    """The minimum of each hash function, SEGMENTS * PER of them, over a set that is not empty."""
    least = np.full(len(salt), ~np.uint64(0))
    step = (1 << 16) // len(salt)  # half a megabyte of hashes at once
    for at in range(0, len(held), step):
        value = held[at : at + step, None] ^ salt
        value *= odd
        value ^= value >> np.uint64(32)
        np.minimum(least, value.min(0), out=least)
    return least


def variants(sketches: np.ndarray) -> np.ndarray:
    """For each row of minimum hashes its keys: each segment with each value masked out in turn."""
    mixed = (sketches ^ TAG[0]) * ODD
    mixed = (mixed ^ (mixed >> np.uint64(31))) * ODD[::-1]
    mixed = (mixed ^ (mixed >> np.uint64(29))).reshape(-1, SEGMENTS, PER)
    keys = (mixed.sum(2, dtype=np.uint64)[:, :, None] - mixed).reshape(-1, SEGMENTS * PER) ^ TAG[1]
    return keys * STEP


def _stamped(docs: DataFrame) -> DataFrame:
    """doc_id, mark (XXH64 of the text), sig (of the set), n (its size), fp (its SimHash), keys."""
    import xxhash

    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = list(shingle_sets(batch.column("text")))
            sigs = [xxhash.xxh64_intdigest(own.tobytes(), 3) - (1 << 63) for own in sets]
            sizes = np.array([len(own) for own in sets], np.int64)
            fps = np.array([majority(own) if len(own) else 0 for own in sets], np.uint64).view(np.int64)
            sketches = np.array([sketch(own) for own in sets if len(own)], np.uint64).reshape(-1, SEGMENTS * PER)
            lists = _lists(variants(sketches), sizes > 0)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(sigs, pa.int64()), pa.array(sizes), pa.array(fps), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "sig", "n", "fp", "keys"])

    given = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return map_texts(given, scan, f"doc_id {kind}, mark bigint, sig bigint, n bigint, fp bigint, keys array<bigint>")


def _lists(rows: np.ndarray, held: np.ndarray) -> pa.ListArray:
    """A list of each row where one is held, an empty one elsewhere."""
    cuts = np.concatenate([[0], np.cumsum(held * rows.shape[1])])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rows.ravel().view(np.int64)))


def _fit(n: Column, m: Column) -> Column:
    """Sizes that allow a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def nibbles(least: np.ndarray) -> np.ndarray:
    """The last four bits of each minimum hash, sixteen to a number."""
    return ((least & np.uint64(15)).reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)


def _differing(x: Column, y: Column) -> Column:
    """In how many of their sixteen nibbles two numbers differ."""
    bits = x.bitwiseXOR(y)
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
    bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
    return F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))


def _close(a: str, b: str) -> Column:
    """Whether two wide sketches differ in at most APART nibbles; of pairs that are far apart the first FIRST of them alone are read."""
    first = sum((_differing(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(FIRST // 16)), F.lit(0))
    whole = F.aggregate(F.zip_with(a, b, _differing), F.lit(0), lambda s, n: s + n)
    return (first <= FIRST_APART) & (whole <= APART)


def _texts(sigs: DataFrame, one: DataFrame, docs: DataFrame) -> DataFrame:
    """sig, text of these sets: one text of each."""
    marks = checkpoint(one.join(sigs, "sig", "left_semi").select(F.col("r.mark").alias("mark"), "sig"))
    wanted = F.broadcast(marks) if marks.count() <= FEW else marks
    return docs.select(F.xxhash64("text").alias("mark"), "text").join(wanted, "mark").select("sig", "text").dropDuplicates(["sig"])


def _wide(sigs: DataFrame, one: DataFrame, docs: DataFrame) -> DataFrame:
    """sig, wide: the nibbles of WIDE minimum hashes of each of these sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), 256):
                sets = shingle_sets(part.column("text"))
                rows = np.array([nibbles(sketch(own, _WIDE[0], _WIDE[1] | np.uint64(1))) for own in sets], np.uint64).reshape(-1, WIDE // 16)
                yield pa.RecordBatch.from_arrays([part.column("sig"), _lists(rows, np.ones(len(rows), bool))], names=["sig", "wide"])

    return map_texts(_texts(sigs, one, docs), scan, "sig bigint, wide array<bigint>")


def _verified(pairs: DataFrame, one: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of 0.8 or more.

    The texts of each a's partners are sorted behind its own, so that a task holds one set at a time
    and one text a row; an a of many partners is dealt over salts.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALTED).alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.col("b").alias("sig"))
    own = salts.select("a", F.lit(None).cast("bigint").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("sig"))
    rows = dealt.union(own)
    both = rows.join(_texts(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), one, docs), "sig")
    rows = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in slices(batches, 256):
            alike = []
            for b, own in zip(batch.column("b").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if b is None:
                    first = own
                alike.append(b is not None and 9 * len(np.intersect1d(first, own, assume_unique=True)) >= 4 * (len(first) + len(own)))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return map_texts(rows.select("a", "b", "text"), compare, "a bigint, b bigint")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with their components as root, of keys that members of two components share."""
    found = members.drop("root").join(components(links).withColumnRenamed("node", "sig"), "sig", "left")
    found = found.withColumn("root", F.coalesce("root", "sig"))
    split = found.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return checkpoint(found.join(split, "key"))


def _star(members: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) for each set that is not its keys' centre or of the centres' component."""
    order = F.col("met") if turn == 0 else F.xxhash64("sig", F.lit(turn))
    centre = F.max(F.struct(order.alias("order"), "sig", "n", "root"))
    centres = members.groupBy("key").agg(centre.alias("c"))
    met = members.join(centres, "key").where((F.col("c.root") != F.col("root")) & _fit(F.col("c.n"), F.col("n")))
    best = met.groupBy("sig").agg(F.max(F.struct("c.order", "c.sig")).alias("c"))
    return best.select("sig", F.col("c.sig").alias("other")).select(*_ordered("sig", "other")).distinct()


def _left(members: DataFrame) -> tuple[int, int]:
    """Rows of the keys, and pairs of them in two components."""
    groups = members.groupBy("key", "root").agg(F.count("*").alias("m"))
    keys = groups.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"))
    found = keys.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()
    return int(found[0] or 0), int(found[1] or 0)


def _rest(members: DataFrame, tested: DataFrame) -> DataFrame:
    """All pairs (a, b) of sets of two components that share a key and may be alike by their wide sketches, but for those compared before."""
    salts = members.groupBy("key").agg(F.ceil(F.count("*") / SALTED).alias("salts"))
    dealt = members.join(salts, "key")
    side = lambda name, salt: dealt.select("key", salt.alias("salt"), *[F.col(c).alias(f"{name}{c}") for c in ("sig", "n", "root", "wide")])
    x = side("x_", F.pmod(F.xxhash64("sig"), F.col("salts")))
    y = side("y_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    met = x.join(y, ["key", "salt"]).where(
        (F.col("x_root") < F.col("y_root")) & _fit(F.col("x_n"), F.col("y_n")) & _close("x_wide", "y_wide")
    )
    return met.select(*_ordered("x_sig", "y_sig")).distinct().join(tested, ["a", "b"], "left_anti")


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (sig, fp) whose fingerprints differ in at most two bits: one of each pair of fingerprints, and each set with the first of its own."""
    fps = checkpoint(sets.groupBy("fp").agg(F.min("sig").alias("least"), F.count("*").alias("sets")))
    same = sets.join(fps.where("sets > 1"), "fp").where("sig <> least").select(*_ordered("sig", "least"))
    side = lambda name: fps.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_sig"))
    near = near_links(fps.select("fp")).join(side("a"), "a").join(side("b"), "b").select(*_ordered("a_sig", "b_sig"))
    return same.union(near).distinct()


def links(one: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Edges (a, b) between sets of similarity 0.8 or more that have the components of all such edges."""
    keyed = one.select("sig", "n", "fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    rows = checkpoint(keyed.join(shared, "key"))
    met = checkpoint(rows.groupBy("sig").agg(F.first("fp").alias("fp"), F.sum("sets").alias("met")))
    members = rows.drop("sets", "fp").join(met.drop("fp"), "sig").withColumn("root", F.col("sig"))
    tested = checkpoint(_simhash_pairs(met.select("sig", "fp")))
    found = checkpoint(_verified(tested, one, docs))
    members = _rooted(members, found)
    for turn in range(rounds):
        held, pairs_left = _left(members)
        if pairs_left <= LEFT * held and turn:
            break
        pairs = checkpoint(_star(members, turn))
        alike = checkpoint(_verified(pairs, one, docs))
        tested, found = tested.union(pairs), checkpoint(found.union(alike))
        members = _rooted(members, found)
        if turn and alike.count() * FRUITLESS < pairs.count():
            break
    wide = checkpoint(_wide(members.select("sig").distinct(), one, docs))
    return found.union(_verified(checkpoint(_rest(members.join(wide, "sig"), tested)), one, docs))


def keep_one(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest doc_id (null last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")
    one = _stamped(docs).groupBy("sig").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    one = checkpoint(one)
    roots = components(links(one, docs, rounds)).withColumnRenamed("node", "sig")
    named = one.select("sig", "r").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    return kept_rows(docs, named.groupBy("root").agg(F.min("r").alias("r")))
