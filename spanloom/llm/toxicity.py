"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text's vector has all its words that any example holds, whole texts on both sides: (1 + ln tf) *
idf * rf. Document frequencies count all documents; rf is the published relevance frequency of
supervised term weighting, log2(2 + odds of the word in toxic examples against the others), with the
odds one standard error below what is seen, to the power ``LEAN``. It is at least 1, so no word is
left out and every text with a known word has neighbours.

The examples are a bounded sample of labelled rows: at most ``EXAMPLES`` of each label and
``SAMPLE_BYTES`` of their text, those with the smallest hashes of their doc_id (a text of over a
sixteenth of that is no example; it is scored like all others). The base rate counts all labelled rows.

Examples lie in an inverted index: sparse postings of each word, cut in blocks of ``BLOCK``
examples, each with the word's largest weight in it. A query sums these maxima to bound every block,
scores blocks from the highest bound on, and stops when no bound exceeds its k-th best cosine: exact
top k. Neighbours vote with weights that fall with distance, and the base rate as a pseudo-vote; a
logistic curve fitted on leave-one-out votes of the examples makes the vote a probability. The
nearest example, its cosine and the words shared with it are the evidence.

Defined results: a null or empty text, or one without a known word, gets the score of no evidence;
texts are read whole; labels other than 0 and 1 and rows without a label do not train; a doc_id
labelled twice counts as toxic if any says so; copies among the examples count once; without labels
of both kinds every score is the base rate (0 if there is none); repeated rows are scored alike; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, map_texts, slices, texts

EXAMPLES = 4096  # of each label
SAMPLE_BYTES = 1 << 25  # of each label's texts
LEAN = 1.5
BLOCK = 512
FIRST = 2  # blocks that are scored first, for a floor under the k best
COMMON, SHARE = 512, 64  # words at most whose postings are rows of a matrix, if one of SHARE examples holds them
TOGETHER = 128  # queries
SLIP = 1e-9  # more than sums in another order can differ by
NEIGHBOURS = 15
PSEUDO = 0.5
REMEMBERED = 10_000
TOXIC_FROM = 0.7
EVIDENCE = 5  # words
STEP = 1 << 18  # postings handled at once where the index is made

BLANKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8: what stands between ASCII characters other than letters and digits."""
    return text.lower().encode("utf-8", "replace").translate(BLANKS).split()


class Vocabulary:
    """Numbers of words, in the order of their XXH64: eight bytes a word; two of 2**26 words are taken for one in 1 of 8000 cases."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes  # sorted

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, words: Iterable[bytes], many: int) -> np.ndarray:
        """The number of each of ``many`` words, -1 if it is not known."""
        from xxhash import xxh64_intdigest

        own = np.fromiter(map(xxh64_intdigest, words), np.uint64, many)
        place = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[place] == own, place, -1) if len(self.hashes) else np.full(many, -1)


def spelled(words: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Known words of a text by number, ascending, how often each stands there, the text's words, and which of them each is."""
    found = Counter(words_of(text))
    numbers = words.numbers(found, len(found))
    many = np.fromiter(found.values(), np.float64, len(found))
    order = np.argsort(numbers)[np.count_nonzero(numbers < 0) :]
    return numbers[order], many[order], list(found), order


def counted(words: Vocabulary, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Known words of a text by number, ascending, and how often each stands there."""
    return spelled(words, text)[:2]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Postings of words over examples in blocks of BLOCK, with each word's largest weight in a block.

    The commonest words' postings are rows of a matrix, which many queries multiply at once; those
    of all other words are sparse, sorted by word and example. Block maxima are kept as bytes, rounded
    up. It is made where it is used; only the examples' words travel.
    """

    def __init__(self, examples: np.ndarray, held: np.ndarray, weights: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int):
        """Postings by word, then example: ``held`` is how many each word has, ``weights`` of (places, their words)."""
        many, blocks = len(held), -(-size // BLOCK)
        common = np.argsort(-held, kind="stable")[:COMMON]
        common = common[held[common] * SHARE >= size]
        self.row = np.full(many, -1, np.int32)  # of each word in the matrix
        self.row[common] = np.arange(len(common))
        word = np.repeat(np.arange(many, dtype=np.int32), held)
        dense = np.flatnonzero(self.row[word] >= 0)
        self.matrix = np.zeros((len(common), blocks * BLOCK))
        self.matrix[self.row[word[dense]], examples[dense]] = weights(dense, word[dense])
        sparse = np.ones(len(word), bool)
        sparse[dense] = False
        self.example, word = examples[sparse], word[sparse]
        self.weight = np.empty(len(word))
        rest = np.flatnonzero(sparse)
        del dense, sparse
        for at in range(0, len(rest), STEP):  # in steps, which bound the memory
            self.weight[at : at + STEP] = weights(rest[at : at + STEP], word[at : at + STEP])
        del rest
        self.word = np.searchsorted(word, np.arange(many))  # first posting of each word
        self.first = np.zeros((many, blocks + 1), np.uint16 if size < 1 << 16 else np.uint32)  # of each word in each block, from its first on
        self.most = np.zeros((many, blocks), np.uint8)  # largest weight of a word in a block, in units
        self.unit = float(self.weight.max(initial=0.0)) / 255 or 1.0
        ends = np.append(self.word, len(word))
        for at in range(0, many, STEP // blocks):
            some = np.arange(at, min(many, at + STEP // blocks))
            here = slice(ends[some[0]], ends[some[-1] + 1])
            run = (word[here].astype(np.int64) - at) * blocks + self.example[here] // BLOCK
            places = np.searchsorted(run, (np.arange(len(some)) * blocks)[:, None] + np.arange(blocks + 1))
            self.first[some] = places - (self.word[some] - here.start)[:, None]
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            if len(starts):
                most = np.zeros(len(some) * blocks, np.uint8)
                most[run[starts]] = np.ceil(np.maximum.reduceat(self.weight[here], starts) / self.unit)
                self.most[some] = most.reshape(len(some), blocks)

    def shared(self, words: np.ndarray, example: int) -> np.ndarray:
        """Which of the words the example holds."""
        rows, block = self.row[words], example // BLOCK
        met = (rows >= 0) & (self.matrix[rows, example] > 0) if len(self.matrix) else np.zeros(len(words), bool)
        begins = self.first[words, block].astype(np.int64)
        sizes = self.first[words, block + 1] - begins
        hits = np.repeat(np.arange(len(words)), sizes)[self.example[_runs(begins + self.word[words], sizes)] == example]
        met[hits] = True
        return met

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (words, weights) the k nearest examples with a cosine above 0, and the cosines.

        Ties go to the earlier example. A query leaves out its example of ``without``.
        """
        for at in range(0, len(queries), TOGETHER):
            group = queries[at : at + TOGETHER]
            asked = np.zeros((len(group), len(self.matrix)))
            for n, (words, weights) in enumerate(group):
                rows = self.row[words]
                asked[n, rows[rows >= 0]] = weights[rows >= 0]
            for n, (score, (words, weights)) in enumerate(zip(asked @ self.matrix, group, strict=True)):
                if without is not None:
                    score[without[at + n]] = -np.inf
                rare = self.row[words] < 0
                yield self._best(score, words[rare], weights[rare], k)

    def _best(self, score: np.ndarray, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``score`` holds the common words' share of the cosines."""
        by_block = score.reshape(-1, BLOCK)
        highest = by_block.max(1)
        bounds = highest + (weights * self.unit) @ self.most[words]
        # the common words' share alone is a floor of each cosine, and as many blocks as asked for hold one each
        least = max(np.partition(highest, len(highest) - k)[len(highest) - k] if len(highest) > k else 0.0, 0.0)
        order = np.argsort(-bounds, kind="stable")
        found, best = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST
        while at < len(order):
            within = np.count_nonzero(bounds[order[at : at + step]] >= max(least - SLIP, SLIP))
            if not within:
                break
            group = np.sort(order[at : at + within])
            at, step = at + within, len(order)
            begins = self.first[words[:, None], group].astype(np.int64)
            sizes = (self.first[words[:, None], group + 1] - begins).ravel()
            postings = _runs((begins + self.word[words][:, None]).ravel(), sizes)
            own = np.repeat(np.repeat(weights, len(group)), sizes)
            score += np.bincount(self.example[postings], self.weight[postings] * own, minlength=len(score))
            held = by_block[group]
            place, inside = np.nonzero(held >= max(least - SLIP, SLIP))
            found, best = np.concatenate([found, group[place] * BLOCK + inside]), np.concatenate([best, held[place, inside]])
            if len(best) > k:
                least = max(least, np.partition(best, len(best) - k)[len(best) - k])
        best = np.round(best, 12)
        order = np.lexsort((found, -best))[:k]
        return found[order], best[order]


@dataclass
class Model:
    words: Vocabulary
    worth: np.ndarray  # idf * rf of each word
    toxic: np.ndarray  # of each example
    example_ids: list
    marks: np.ndarray  # XXH64 of the examples' texts
    held: np.ndarray  # how many examples hold each word
    postings: np.ndarray  # examples by word
    counts: np.ndarray  # how often the word stands there
    norms: np.ndarray  # of the examples' vectors
    base: float
    weight: tuple[float, float]  # of an example with label 0 and 1
    curve: tuple[float, float] = (1.0, 0.0)
    shared: Broadcast | None = None  # of this model, all but its curve
    held_index: BlockMaxIndex | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None, "held_index": None}

    @property
    def index(self) -> BlockMaxIndex:
        """Made once in each worker."""
        if self.held_index is None:

            def weights(places: np.ndarray, words: np.ndarray) -> np.ndarray:
                return (1 + np.log(self.counts[places].astype(np.float64))) * self.worth[words] / self.norms[self.postings[places]]

            self.held_index = BlockMaxIndex(self.postings, self.held, weights, len(self.toxic))
        return self.held_index

    def vector(self, words: np.ndarray, many: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(many)) * self.worth[words]
        return raw / max(np.sqrt((raw**2).sum()), 1e-300)

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        """Votes in proportion to the cosine, the nearest one's being 1, against the base rate as a pseudo-vote."""
        if not len(examples):
            return self.base
        weights = cosines / cosines[0] * np.where(self.toxic[examples] == 1, self.weight[1], self.weight[0])
        return float(((weights * self.toxic[examples]).sum() + PSEUDO * self.base) / (weights.sum() + PSEUDO))


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    vote = min(max(vote, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(-(curve[0] * np.log(vote / (1 - vote)) + curve[1]))))


def _fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Logistic curve on the log odds of the votes, by Newton's method with a small penalty."""
    odds = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / np.clip(1 - votes, 1e-6, 1))
    x = np.stack([odds, np.ones_like(odds)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - 0.1 * (at - [1.0, 0.0])
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        at = at + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _examples(docs: DataFrame, usable: DataFrame, most: int) -> DataFrame:
    """h, doc_id, toxic, text of the sampled rows: at most ``most`` rows and SAMPLE_BYTES of text of each label."""
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))  # at most 2 * most pairs of numbers
    held = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES // 16).join(chosen, "doc_id")
    once = held.withColumn("h", F.xxhash64("doc_id")).groupBy("text").agg(F.min(F.struct("h", "doc_id", "toxic")).alias("r")).select("r.*", "text").withColumn("mark", F.xxhash64("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("h", "doc_id", F.xxhash64("text")))
    return once.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).drop("so_far")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """A model from all documents' statistics and a bounded sample of the labelled rows."""
    import xxhash

    sc = docs.sparkSession.sparkContext
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usable = training_labels(labels)
    totals = dict(usable.groupBy("toxic").count().collect())
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    sample = checkpoint(_examples(docs, usable, examples))
    found = sample.toArrow()  # the documented bound
    toxic = found["toxic"].to_numpy().astype(np.int64)
    if not 0 < toxic.sum() < len(toxic):
        none = np.zeros(0, np.int64)
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), none, [], none, none, none, none, np.zeros(0), base, (1.0, 1.0))
    met: set[int] = set()
    for text in found["text"]:
        met.update(map(xxhash.xxh64_intdigest, set(words_of(text.as_py()))))
    words = Vocabulary(np.sort(np.fromiter(met, np.uint64, len(met))))
    del met
    shared = sc.broadcast(words)  # bounded by SAMPLE_BYTES

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = shared.value, 0
        held = np.zeros(len(known), np.int64)
        for batch in slices(batches):
            for text in texts(batch.column("text")):
                own = set(words_of(text))
                place = known.numbers(own, len(own))
                held[place[place >= 0]] += 1
            rows += batch.num_rows
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(held[place], rows))], names=["word", "n"])

    counts = map_texts(docs.select("text"), frequency, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    number, n = counts["word"].to_numpy(), counts["n"].to_numpy()
    held, rows = np.zeros(len(words)), int(n[number < 0].sum())
    held[number[number >= 0]] = n[number >= 0]
    model = _assemble(found, toxic, words, held, rows, base)
    shared.unpersist()
    model.shared = judges = sc.broadcast(model)  # bounded by EXAMPLES and SAMPLE_BYTES

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judges.value
        by_mark = np.argsort(own.marks)
        for batch in slices(batches, TOGETHER):
            ids = by_mark[np.searchsorted(own.marks[by_mark], batch.column("mark").to_numpy())]
            asked = [(words, own.vector(words, many)) for words, many in (counted(own.words, t) for t in texts(batch.column("text")))]
            votes = [own.vote(*near) for near in own.index.nearest(asked, NEIGHBOURS, without=ids)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(votes, pa.float64())], names=["id", "vote"])

    voted = map_texts(sample.select("mark", "text").repartition(tasks), vote, "id bigint, vote double").toArrow()
    votes = np.zeros(len(model.toxic))
    votes[voted["id"].to_numpy()] = voted["vote"].to_numpy()
    model.curve = _fit_curve(votes, model.toxic, np.where(model.toxic == 1, model.weight[1], model.weight[0]))
    return model


def _assemble(found: pa.Table, toxic: np.ndarray, words: Vocabulary, held: np.ndarray, rows: int, base: float) -> Model:
    """Weights and vectors of the examples (h, doc_id, text) and the words' document frequencies; no curve yet."""
    parts: list[list[np.ndarray]] = [[], []]
    for text in found["text"]:
        for values, value, kind in zip(parts, counted(words, text.as_py()), (np.int32, np.int32), strict=True):
            values.append(value.astype(kind))
    sizes = np.array([len(f) for f in parts[0]], np.int64)
    flat, many = (np.concatenate(p) for p in parts)
    del parts
    label = np.repeat(toxic, sizes)
    inside = [np.bincount(flat[label == y], minlength=len(words)) + 0.5 for y in (0, 1)]
    log_odds = np.log(inside[1] / (toxic.sum() + 1)) - np.log(inside[0] / (len(toxic) - toxic.sum() + 1))
    error = np.sqrt(1 / inside[1] + 1 / inside[0])
    worth = (np.log((rows + 1) / (held + 1)) + 0.01) * np.log2(2 + np.exp(log_odds - error)) ** LEAN
    weights = (1 + np.log(many.astype(np.float64))) * worth[flat]
    # examples that share their commonest word (of one language, mostly) and their weightiest one share
    # blocks, so that a block's maxima say much about its examples
    own = [slice(e - n, e) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    common, heavy = ([flat[s][by[s].argmax()] if s.start < s.stop else -1 for s in own] for by in (held[flat], weights))
    order = np.lexsort((found["h"].to_numpy(), heavy, toxic, common))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    place, toxic = np.repeat(rank, sizes), toxic[order]
    norms = np.sqrt(np.bincount(place, weights**2, minlength=len(order)))
    del weights
    by_word = np.lexsort((place, flat))
    share = toxic.mean()
    weight = ((1 - base) / max(1 - share, 1e-9), base / max(share, 1e-9))
    place = place[by_word].astype(np.uint16 if len(order) < 1 << 16 else np.int32)
    counts = many[by_word].astype(np.min_scalar_type(int(many.max(initial=1))))
    ids, marks = (found[c].take(pa.array(order)) for c in ("doc_id", "mark"))
    held_by = np.bincount(flat, minlength=len(words))
    return Model(words, worth, toxic, ids.to_pylist(), marks.to_numpy(), held_by, place, counts, norms, base, weight)


class Scorer:
    """Scores batches of texts; texts with equal counts of words are scored once."""

    def __init__(self, model: Model, curve: tuple[float, float]):
        self.model, self.curve = model, curve
        self.none = (calibrated(model.base, curve) if len(model.words) else model.base, None, 0.0, None)
        self.known: dict[bytes, tuple] = {}

    def batch(self, column: pa.Array) -> list[tuple]:
        """(score, nearest example, cosine, words) of each text."""
        import xxhash

        own, wanted, new = self.model, [], {}
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        for text in texts(column) if len(own.words) else ():
            words, many, names, order = spelled(own.words, text)
            same = xxhash.xxh128_digest(words.tobytes() + many.tobytes()) if len(words) else b""
            wanted.append(same)
            if same and same not in self.known:
                new.setdefault(same, (words, own.vector(words, many), names, order))
        near = own.index.nearest([asked[:2] for asked in new.values()], NEIGHBOURS) if new else ()
        for (same, asked), (examples, cosines) in zip(new.items(), near, strict=True):
            self.known[same] = self._judged(*asked, examples, cosines) if len(examples) else self.none
        return [self.known[same] if same else self.none for same in wanted] if len(own.words) else [self.none] * len(column)

    def _judged(self, words: np.ndarray, weights: np.ndarray, names: list[bytes], order: np.ndarray, examples: np.ndarray, cosines: np.ndarray) -> tuple:
        own = self.model
        met = own.index.shared(words, int(examples[0]))
        most = order[met][np.argsort(-weights[met], kind="stable")[:EVIDENCE]]
        shown = b" ".join(names[k] for k in most.tolist()).decode()
        return calibrated(own.vote(examples, cosines), self.curve), own.example_ids[examples[0]], float(cosines[0]), shown


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, nearest (id of the nearest example), cosine, terms (weightiest words shared with it)."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    shared, curve = model.shared or docs.sparkSession.sparkContext.broadcast(model), model.curve

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, curve)
        for batch in slices(batches):
            ids = batch.schema.field("doc_id").type
            columns = list(zip(*scorer.batch(batch.column("text")), strict=True)) or [(), (), (), ()]
            types = (pa.float64(), ids, pa.float64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "score", "nearest", "cosine", "terms"])

    return map_texts(docs.select("doc_id", "text"), scan, f"doc_id {kind}, score double, nearest {kind}, cosine double, terms string")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence for every document."""
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        "nearest",
        "cosine",
        "terms",
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns: scored and dropped in one pass."""
    model = fit(docs, labels)
    shared, curve = model.shared or docs.sparkSession.sparkContext.broadcast(model), model.curve
    del model

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, curve)
        for batch in slices(batches):
            yield batch.filter(pa.array([s < TOXIC_FROM for s, *_ in scorer.batch(batch.column("text"))], pa.bool_()))

    return map_texts(docs, scan, docs.schema)
