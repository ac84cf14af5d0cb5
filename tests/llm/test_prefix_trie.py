"""The conversation trie against every prefix in a dictionary."""

import hashlib
import random
import zlib

import pytest

from spanloom.llm import prefix_trie as P


def digest(turn):
    return hashlib.md5(repr(turn).encode()).digest()


def brute(convs):
    """Nodes of conversations (id, tuple of (role, text)), from every prefix."""
    members, ends = {}, {}
    for conv, turns in convs:
        ends.setdefault(turns, []).append(conv)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(conv)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]), sum(not kids[q] for q in below), saved,
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def swept(convs, cuts):
    """The same by sweeps over pieces of the sorted sequences."""
    held = {}
    for conv, turns in convs:
        held.setdefault(b"".join(digest(t) for t in turns), ([len(t[1].encode()) for t in turns], []))[1].append(conv)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    rows = [(key, sizes, len(ids), min(ids), sha(ids)) for key, (sizes, ids) in sorted(held.items())]
    cuts = sorted(min(c, len(rows)) for c in cuts)
    pieces = [p for p in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)) if p]
    left = [-1] + [P.common_turns(a[-1][0], b[0][0]) for a, b in zip(pieces, pieces[1:], strict=False)]
    points = [(part, place, *p) for part, piece in enumerate(pieces) for place, p in enumerate(P.Sweep(left[part], [*left, -1][part + 1]).rows(iter(piece)))]
    total = {}
    for _, _, depth, node, n, least, kids, leaves, saved, end, _, shared, _ in points:
        if shared:
            t = total.get((depth, node), (0, least, 0, 0, 0, None))
            total[depth, node] = (t[0] + n, min(t[1], least), t[2] + kids, t[3] + leaves, t[4] + saved, t[5] or end)
    whole = []
    for part, place, depth, node, *sums, edge, shared, owned in points:
        whole.append((part, -place, (part, depth, *(total[depth, node] if shared else sums), edge, owned)))
    return sorted(P.expand(row for _, _, row in sorted(whole, key=lambda r: r[:2])), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_sweeps_over_any_pieces(seed):
    for trial in range(10):
        rng = random.Random(seed * 10 + trial)
        turns = [("user", "x" * rng.randint(0, 5)), ("assistant", "é"), ("", "")][: rng.randint(1, 3)]
        convs = [(c, tuple(rng.choices(turns, k=rng.randint(0, rng.choice([2, 5, 9]))))) for c in rng.sample(range(100), rng.randint(1, 14))]
        assert swept(convs, [rng.randint(0, 14) for _ in range(rng.randint(0, 4))]) == brute(convs)


def rebuild(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out.append((c, tuple(own.get(c - c % 5, [])[:h] + turns[h:])))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node binary, part int")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for c in range(60) if c % 11 for t in range(rng.randint(1, 6))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(200) for t in range(12)]  # a large group of copies
    rows += [(400, t, "user", str(t)) for t in range(500)] + [(401, None, "user", "first"), (401, 0, "user", "second"), (None, 1, "user", "none")]
    rng.shuffle(rows)
    found = P.conversation_trie(table(spark, [(*r, b"x", 1) for r in rows]).repartition(5))
    assert plain(found) == brute(rebuild(rows))


def test_pieces_of_a_long_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    keyed = P._keyed(P.sequences(table(spark, [(c, 0, "user", "x" if c % 3 else "y", None, None) for c in range(100)])).select("conv_id", "turns"))
    found = {r["sha"] for r in P.ends_digests(keyed).collect()}
    lists = [[c for c in range(100) if c % 3], [c for c in range(100) if c % 3 == 0]]
    assert found == {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in lists}


def test_empty_table_and_turnless(spark):
    assert P.conversation_trie(table(spark, [])).collect() == []
    # the only turns are within the first h, and the base conversation is absent
    conv = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    found = plain(P.conversation_trie(table(spark, [(conv, 0, "user", "x", None, None)])))
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]
