"""Benchmark decontamination by template windows with slot consistency.

Texts become sequences of words in which numbers, units and names are typed placeholders
("slots"); so a benchmark question whose parameters were changed has the same templates. Windows
of five template words are hashed, and documents' windows are joined to benchmark items' windows
by hash; a window with a name counts in its literal form as well, for texts in another case. Where windows hold slots, an item's value must stand for one value of the document
throughout an alignment (same distance between the positions); windows that break this do not
count. A document is contaminated by an item if it holds at least 0.8 of the item's windows, or a run
of ``RUN`` words of it, as whole windows one after the other on one alignment.

Where placeholders would say too little, words stand for themselves: a window of fewer than two literal words is hashed
in its literal form, and an item of two to four words is found by all its words inside longer texts.

Before the join, documents drop windows that a Bloom filter of the benchmark's windows rules out
(a fixed number of bits, whatever the benchmark's size), and documents with fewer windows left
than the least item needs. Both are exact: nothing that could match is dropped.

Defined results: a null or empty text has no window, and such an item takes no part; a text of fewer than five words is
one window; an item of a single word is found only in a text that is this word alone (a word is no passage);
each place of an item's windows counts; repeated
documents are each judged, repeated items (same item_id) should be the same text (places are counted by item_id); a null doc_id is kept; empty
tables give an empty table; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint, map_texts

WORDS = 5
SHARE = 0.8
LITERALS = 2
RUN = 13  # words in a row that are a leak, whatever the item's length
BLOOM_BITS = 1 << 23
FEW = 500_000  # rows of some numbers that may be sent to every executor
SPREAD = 16

# Units that become a placeholder.
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer
    kilometers g kg mg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs l ml litre litres
    liter liters second seconds minute minutes hour hours day days week weeks month months year years km/h mph percent dollar
    dollars euro euros cent cents usd eur gbp degree degrees celsius fahrenheit volt volts watt watts joule joules newton
    newtons pascal hz khz mhz ghz kb mb gb tb""".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*%?")
EDGE = re.compile(r"^\W+|\W+$")
LITERAL, NUM, UNIT, NAME, NOTHING = range(5)
CODES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)
PLAIN = np.uint64(0x27D4EB2F165667C5)  # sets windows of literal words apart
STEP = np.uint64(0x100000001B3)


def _classes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, class, capitalised or not, and sentence end or not, of each distinct raw word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    code, kind = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int8)
    capital, ends = np.zeros(len(words), bool), np.zeros(len(words), bool)
    for i, word in enumerate(words):
        bare = word
        if not word.isalnum():
            bare = EDGE.sub("", word)
            ends[i] = word.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":", "…")
        lower = bare.lower()
        if not bare:
            kind[i] = NOTHING
        else:
            code[i] = digest(lower.encode("utf-8", "surrogatepass"), 7)
            if lower in UNITS:
                kind[i] = UNIT
            elif bare[0].isdigit() and NUMBER.fullmatch(bare):
                kind[i] = NUM
            else:
                capital[i] = bare[0].isupper() and bare[1:].islower()
    return code, kind, capital, ends


def _rolled(codes: np.ndarray, width: int, start: np.uint64) -> np.ndarray:
    """Hashes of all windows of a width."""
    many = max(0, len(codes) - width + 1)
    value = np.full(many, start ^ np.uint64(width))
    for k in range(width):
        value = (value ^ codes[k : k + many]) * STEP
        value ^= value >> np.uint64(29)
    return value


class Template:
    """The template words of one text: hash and class of each, with its place among the raw words."""

    __slots__ = ("codes", "kinds", "raw", "begins", "words")

    def __init__(self, codes: np.ndarray, kinds: np.ndarray, raw: np.ndarray, words: np.ndarray, begins: bool = False):
        self.codes, self.kinds, self.raw = codes, kinds, raw
        self.words = words  # hashes of the words themselves
        self.begins = begins  # the first word is capitalised: inside a sentence it would be a name

    def plain(self) -> Template:
        """The same text with names as literal words, as it reads in another case or punctuation."""
        names = self.kinds == NAME
        return Template(np.where(names, self.words, self.codes), np.where(names, LITERAL, self.kinds), self.raw, self.words)

    def inside(self) -> Template:
        """The same text as it reads where it does not begin a sentence."""
        codes, kinds = self.codes.copy(), self.kinds.copy()
        codes[0], kinds[0] = CODES[NAME], NAME
        return Template(codes, kinds, self.raw, self.words)

    def windows(self) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """Hashes and first places of all windows, their width, and which of them are literal, as they have few literal words."""
        size = len(self.codes)
        width = min(WORDS, size)
        if not size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(0, bool)
        value = _rolled(self.codes, width, np.uint64(0))
        literal = np.convolve(self.kinds == LITERAL, np.ones(width, np.int64), "valid")
        few = literal < min(LITERALS, width)
        if few.any():
            value = np.where(few, _rolled(self.words, width, PLAIN), value)
        return value, np.arange(len(value)), width, few

    def literally(self, width: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        """The same of all windows of a width in their literal form."""
        value = _rolled(self.words, width, PLAIN)
        return value, np.arange(len(value)), width, np.ones(len(value), bool)


def templates(column: pa.Array) -> Iterator[tuple[Template, pa.Array]]:
    """The template of each text of a batch; distinct raw words are classed once."""
    split = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    word, distinct = coded.indices.to_numpy(), coded.dictionary
    code, kind, capital, ends = _classes(distinct.to_pylist())
    for k in range(len(column)):
        own = word[offsets[k] : offsets[k + 1]]
        kinds = kind[own].copy()
        first = np.ones(len(own), bool)
        first[1:] = ends[own[:-1]]
        kinds[capital[own] & ~first & (kinds == LITERAL)] = NAME
        used = np.flatnonzero(kinds != NOTHING)
        kinds = kinds[used]
        codes = np.where(kinds == LITERAL, code[own[used]], CODES[kinds])
        begins = bool(len(used) and kinds[0] == LITERAL and capital[own[used[0]]])
        yield Template(codes, kinds, own[used], code[own[used]], begins), distinct


def _slots(template: Template, distinct: pa.Array, at: int, width: int) -> list[str]:
    """Class and value of each slot of a window."""
    places = [p for p in range(at, at + width) if template.kinds[p] != LITERAL]
    return [f"{template.kinds[p]}:{EDGE.sub('', distinct[int(template.raw[p])].as_py()).lower()}" for p in places]


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (hashes & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
    high = ((hashes >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
    return low, high


def _passing(bloom, hashes: np.ndarray, places: np.ndarray, width: int, few: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    if not len(hashes):
        return hashes, places, width, few
    low, high = probes(hashes)
    hit = np.flatnonzero(bloom[low] & bloom[high])
    return hashes[hit], places[hit], width, few[hit]


def _windows(rows: DataFrame, key: str, text: str, bloom: np.ndarray | None, least: int, short: tuple[int, ...] = ()) -> DataFrame:
    """row, key, mark (of the text), hash, place, slots, width: the windows that the filter lets pass.

    Windows without slots are given once for each text, unless they are of WORDS words. ``short`` are widths under WORDS, of which a longer text's literal windows
    are given as well. Without a filter (for items), a short text's literal window is, and a first
    window that would read as a name inside a sentence in that form.
    """
    kind = rows.select(key).schema[0].dataType.simpleString()
    given = rows.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            taken = []
            for k, (template, distinct) in enumerate(templates(batch.column("text"))):
                forms = [(template, *template.windows())]
                size = len(template.codes)
                if (template.kinds == NAME).any():
                    other = template.plain()
                    value, at, width, few = other.windows()
                    # only windows that hold a name read differently; both forms have all places' windows
                    named = np.convolve(template.kinds == NAME, np.ones(width, np.int64), "valid") > 0
                    forms.append((other, value[named], at[named], width, few[named]))
                if bloom is not None:
                    forms += [(template, *template.literally(w)) for w in short if w < size]
                    forms = [(f, *_passing(bloom, *found_in)) for f, *found_in in forms]
                else:
                    if 1 < size < WORDS:
                        forms.append((template, *template.literally(size)))
                    if template.begins:
                        other = template.inside()
                        value, at, width, few = other.windows()
                        forms.append((other, value[:1], at[:1], width, few[:1]))
                if len(np.unique(np.concatenate([value for _, value, *_ in forms]))) < max(1, least):
                    continue
                seen = set()
                for form, hashes, places, width, few in forms:
                    for value, place, literal in zip(hashes.view(np.int64).tolist(), places.tolist(), few.tolist(), strict=True):
                        slots = [] if literal or (form.kinds[place : place + width] == LITERAL).all() else _slots(form, distinct, place, width)
                        if slots or width == WORDS or bloom is None or value not in seen:
                            seen.add(value)
                            taken.append(k)
                            for values, one in zip(found, (row + k, value, place, slots, width), strict=True):
                                values.append(one)
            row += batch.num_rows
            chosen = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found[0], pa.int64()), batch.column("key").take(chosen), batch.column("mark").take(chosen),
                    pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.list_(pa.string())),
                    pa.array(found[4], pa.int64()),
                ],
                names=["row", "key", "mark", "hash", "place", "slots", "width"],
            )

    return map_texts(given, scan, f"row bigint, key {kind}, mark bigint, hash bigint, place bigint, slots array<string>, width bigint")


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, windows, matched, share, mark: the pairs of a document and an item it holds.

    ``mark`` is the XXH64 of the document's text, which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    asked = _windows(items, "item_id", "text", None, 0)
    asked = checkpoint(asked.select(F.col("key").alias("item_id"), "hash", F.col("place").alias("at"), F.col("slots").alias("asked"), F.col("width").alias("wide")).distinct())
    # a window is known by its first place, which its other forms share
    sizes = asked.groupBy("item_id").agg(F.countDistinct("at").alias("windows"))
    # the filter's set bits, 64 to a row: at most BLOOM_BITS / 64 rows
    bit = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("h")
    bits = asked.select(bit).select(F.col("h").bitwiseAND(F.lit(BLOOM_BITS - 1)).alias("p"))
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toPandas()
    filled = np.zeros(BLOOM_BITS // 64, np.uint64)
    filled[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    bloom = np.unpackbits(filled.astype("<u8").view(np.uint8), bitorder="little").astype(bool)
    # distinct hashes that any item needs at least: a document's hash may stand for all places that have it
    most = asked.groupBy("item_id", "hash").agg(F.countDistinct("at").alias("n")).groupBy("item_id").agg(F.max("n").alias("repeated"))
    wanted = F.least(F.col("windows") * F.lit(share) - 1e-9, F.lit(float(RUN - WORDS + 1)))
    fewest = sizes.join(most, "item_id").agg(F.min(F.ceil(wanted / F.col("repeated")))).first()[0] or 1
    short = tuple(r["wide"] for r in asked.where(F.col("wide").between(2, WORDS - 1)).select("wide").distinct().collect())  # at most WORDS - 2
    shared = spark.sparkContext.broadcast(np.packbits(bloom, bitorder="little"))

    held = _windows_filtered(docs, shared, int(fewest), short)
    # few items' windows go to where the documents are read; else a window that many documents hold is spread
    if asked.count() <= FEW:
        met = held.drop("width").join(F.broadcast(asked), "hash")
    else:
        spread = asked.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SPREAD)])))
        met = held.drop("width").withColumn("salt", F.pmod("row", F.lit(SPREAD)).cast("int")).join(spread, ["hash", "salt"]).drop("salt")
    pairs = checkpoint(met)
    diagonal = (F.col("place") - F.col("at")).alias("diagonal")
    slotted = pairs.where(F.size("slots") > 0).select(
        "row", "item_id", "hash", "at", "place", diagonal, F.explode(F.arrays_zip("asked", "slots")).alias("s")
    )
    broken = (
        slotted.groupBy("row", "item_id", "diagonal", "s.asked")
        .agg(F.min("s.slots").alias("a"), F.max("s.slots").alias("b"))
        .where("a <> b")
        .select("row", "item_id", "diagonal", "asked")
    )
    bad = slotted.select("row", "item_id", "diagonal", "hash", "at", "place", F.col("s.asked").alias("asked")).join(
        broken, ["row", "item_id", "diagonal", "asked"], "left_semi"
    )
    sound = pairs.join(bad.select("row", "item_id", "hash", "at", "place").distinct(), ["row", "item_id", "hash", "at", "place"], "left_anti")
    counted = sound.groupBy("row", "key", "mark", "item_id").agg(F.countDistinct("at").alias("matched"))
    line = Window.partitionBy("row", "item_id", "diagonal").orderBy("at")  # at most an item's windows
    places = sound.where(F.col("wide") == WORDS).select("row", "item_id", diagonal, "at").distinct()
    runs = places.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("row", "item_id", "diagonal", "run").agg(F.count("*").alias("n"))
    longest = runs.groupBy("row", "item_id").agg(F.max("n").alias("longest"))
    return (
        counted.join(longest, ["row", "item_id"], "left")
        .join(sizes, "item_id")
        .withColumn("share", F.col("matched") / F.col("windows"))
        .where((F.col("share") >= share - 1e-9) | (F.col("longest") > RUN - WORDS))
        .select(F.col("key").alias("doc_id"), "item_id", "windows", "matched", "share", "mark")
    )


def _windows_filtered(docs: DataFrame, shared, least: int, short: tuple[int, ...]) -> DataFrame:
    class Lazy:
        """The broadcast filter, unpacked once in each worker."""

        bits: np.ndarray | None = None

        def __getitem__(self, at: np.ndarray) -> np.ndarray:
            if self.bits is None:
                self.bits = shared.value
            return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return _windows(docs, "doc_id", "text", Lazy(), least, short)


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns.

    The rows to go are counted first: few are sent to where the documents are read, many are joined.
    """
    found = contaminated(docs, items, share).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    found = checkpoint(found.distinct())
    gone = F.broadcast(found) if found.count() <= FEW else found
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_mark"]), "left_anti")
