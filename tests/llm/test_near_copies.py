"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import near_copies

DOCS = "doc_id bigint, text string, sig string, _id string, _mark string, r string"  # the last four clash with internal names


def held(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_ids(rows):
    sets = [held(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(k for g, (k, _) in zip(group, rows, strict=True) if g == x) for x in set(group))


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("mnopqrstuvwxyz") + rng.choice("aeiou")
    notice = " ".join(word() for _ in range(30))
    texts = [None, "", " \n", "one", "ONE", "one two three", "a b c d e", "a b c d e f"]
    for k in range(20):
        words = [word() for _ in range(rng.choice((25, 60, 150, 400)))]
        texts.append(" ".join(words))
        for _ in range(4):
            edited = list(words)
            for _ in range(rng.choice((1, 2, len(words) // 40, len(words) // 25))):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited) + (" " + notice if k % 2 else ""))
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("rounds", [0, 1, 8])  # 0: all pairs that share a key are compared
def test_kept_as_brute_force(spark, rounds):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", "i", "m", "r") for k, t in rows], DOCS)
    kept = near_copies.keep_one(df, rounds)
    assert kept.columns == df.columns
    assert {tuple(r[2:]) for r in kept.collect()} == {("x", "i", "m", "r")}
    expected = kept_ids(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert len(expected) < len({t for _, t in rows}) - 20
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_stage_drops_edited_copies(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    edited = [w if k % 60 else "other" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words), *"ximr"), (2, " ".join(edited), *"ximr"), (3, " ".join(reversed(words)), *"ximr")], DOCS)
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()) == [1, 3]


def test_keys_are_shared_as_often_as_promised():
    """Of sets with a similarity of 0.8 exactly, all share a key; of unlike sets hardly any do."""
    rng = np.random.default_rng(3)
    missed, unlike = 0, 0
    for _ in range(300):
        common, rest = rng.integers(0, 1 << 63, 160, np.int64), rng.integers(0, 1 << 63, (3, 200), np.int64)
        sets = [np.concatenate([common, rest[0][:20]]), np.concatenate([common, rest[1][:20]]), np.concatenate([common[:20], rest[2][:160]])]
        keys = near_copies.variants(np.array([near_copies.sketch(s.view(np.uint64)) for s in sets]))
        missed += not np.isin(keys[0], keys[1]).any()
        unlike += np.isin(keys[0], keys[2]).any()
    assert missed == 0 and unlike <= 3


def test_edits_of_one_text_are_one_group(spark, monkeypatch):
    """Edits that are like their origin, but not like one another: the first round finds the origin."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):
        edited = list(words)
        for at in rng.sample(range(200), 4):
            edited[at] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(edited)))
    sets = [held(t) for _, t in rows]
    assert all(len(sets[0] & x) >= 0.8 * len(sets[0] | x) for x in sets) and sum(len(x & y) < 0.8 * len(x | y) for x in sets[1:] for y in sets[1:]) > 1000
    compared = []
    real = near_copies._rest
    monkeypatch.setattr(near_copies, "_rest", lambda m, t: (lambda d: (compared.append(d.count()), d)[1])(real(m, t)))
    df = spark.createDataFrame([(k, t, *"ximr") for k, t in rows], DOCS)
    assert [r["doc_id"] for r in near_copies.keep_one(df).collect()] == [0]
    assert compared[0] <= 60


def test_simhash_links_copies_of_few_edits(spark, monkeypatch):
    """Op7's fingerprints and their masked halves alone, without the minimum hashes: a copy with one edit goes, and no link is wrong."""
    rng = random.Random(15)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    edited = [*words[:-1], "other"]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(reversed(words))), (4, "short text"), (5, None), (6, " ")]
    rest = near_copies._rest
    monkeypatch.setattr(near_copies, "_rest", lambda members, tested: rest(members, tested).limit(0))
    df = spark.createDataFrame([(k, t, *"ximr") for k, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df, 0).collect()) == [1, 3, 4, 5]


def test_pairs_far_apart_are_told_in_the_join(spark):
    """Sketches are compared by a column, so that the join of sets that share a key makes no row of a pair that is far apart."""
    rng = np.random.default_rng(11)
    ours = rng.integers(0, 16, near_copies.WIDE, np.int64)
    rows, want = [], []
    for k, places in enumerate(range(0, near_copies.WIDE, 15)):
        theirs = ours.copy()
        theirs[rng.permutation(near_copies.WIDE)[:places]] ^= rng.integers(1, 16)
        apart = ours != theirs
        packed = [near_copies.nibbles(v.astype(np.uint64)).view(np.int64).tolist() for v in (ours, theirs)]
        rows.append((k, *packed))
        want.append(bool(apart.sum() <= near_copies.APART and apart[: near_copies.FIRST].sum() <= near_copies.FIRST_APART))
    found = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>").select("k", near_copies._close("a", "b").alias("close")).orderBy("k")
    assert [r["close"] for r in found.collect()] == want and 3 < sum(want) < 15


def edits(count, seed=4, size=200, changed=18):
    """Edits of one text, each with other words changed: none is a near copy of another, but they share keys."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(size)]
    out = []
    for n in range(count):
        own = list(base)
        for at in rng.sample(range(size), changed):
            own[at] = f"x{n}-{at}"
        out.append(" ".join(own))
    return out


def test_unlike_edits_are_compared_in_proportion(spark, monkeypatch):
    made, whole = {}, near_copies._verified
    for count in (60, 120):
        pairs = []
        monkeypatch.setattr(near_copies, "_verified", lambda p, one, docs, pairs=pairs: pairs.append(p.count()) or whole(p, one, docs))
        docs = spark.createDataFrame(list(enumerate(edits(count))), "doc_id bigint, text string")
        assert near_copies.keep_one(docs).count() == count
        made[count] = sum(pairs)
    assert made[120] <= 3 * made[60] + 60 and made[120] < 120 * 119 / 2 / 10


def test_wide_sketches_tell_alike_from_unlike():
    salt, odd = near_copies._WIDE[0], near_copies._WIDE[1] | np.uint64(1)
    rng = np.random.default_rng(7)

    def apart(similarity, size=400):
        common = int(round(2 * size * similarity / (1 + similarity)))
        values = rng.integers(0, 1 << 63, 2 * size, np.int64).view(np.uint64)
        a, b = values[:size], np.concatenate([values[:common], values[size : 2 * size - common]])
        x, y = (near_copies.nibbles(near_copies.sketch(v, salt, odd)) for v in (a, b))
        bits = x ^ y
        return sum((int(v) >> (4 * k)) & 15 != 0 for v in bits for k in range(16))

    assert max(apart(0.8) for _ in range(60)) <= near_copies.APART < min(apart(0.6) for _ in range(60))


def test_stars_are_not_contracted_again(spark, monkeypatch):
    """Components of what is stars already take no round, others the rounds they need and none to confirm them."""
    from spanloom.llm import components

    rounds = []
    monkeypatch.setattr(components, "_least", lambda edges, of=components._least: (rounds.append(1), of(edges))[1])
    pairs = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    star = components.components(pairs([(k, 1) for k in range(1, 9)]))
    assert {(r["node"], r["root"]) for r in star.collect()} == {(k, 1) for k in range(1, 9)} and not rounds
    hub = components.components(pairs([(5, k) for k in range(1, 9)]))
    assert {(r["node"], r["root"]) for r in hub.collect()} == {(k, 1) for k in range(1, 9)} and len(rounds) == 1
    path = components.components(pairs([(k, k + 1) for k in range(1, 40)] + [(50, 51), (51, 50)]))
    assert {(r["node"], r["root"]) for r in path.collect()} == {(k, 1) for k in range(1, 41)} | {(50, 50), (51, 50)}
    assert components.components(pairs([])).count() == 0
