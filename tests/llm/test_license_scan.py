"""License scans against plain Python."""

import re

from spanloom.llm import license_scan as L

MIT = next(text for label, text in L.NOTICES if text.startswith("Permission is hereby"))


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def base(text):
    own = words(text)
    return sorted((i, label) for label, phrase in L.PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())


def spans(text, label, phrase, threshold):
    """Shares of merged diagonals, by dictionaries of places."""
    own, of = words(text), words(phrase)
    width = L.GRAM if len(of) >= L.GRAM else min(len(of), L.SHORT)
    slack = 0 if threshold >= 1 else int(len(of) * (1 - threshold) / 2)
    votes = {}
    for j in range(len(of) - width + 1):
        for i in range(len(own) - width + 1):
            if own[i : i + width] == of[j : j + width]:
                votes.setdefault(i - j, set()).update(range(j, j + width))
    groups, before = [], None
    for d in sorted(votes):
        if before is None or d - before > slack:
            groups.append([])
        groups[-1].append(d)
        before = d
    for g in groups:
        t = {p for d in g for p in votes[d]}
        x = {p + d for d in g for p in votes[d]}
        yield min(len(t), len(x)) / len(of)


def brute(text):
    found = base(text)
    labels, score = {label for _, label in found}, 0.0
    for label, phrase, least in [(x, y, 1.0) for x, y in L.PHRASES] + [(x, y, 0.8) for x, y in L.NOTICES]:
        for share in spans(text, label, phrase, least):
            score = max(score, share)
            if share >= least:
                labels.add(label)
    starts = [i for i, _ in found]
    return (
        len(words(text)), len(found), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), round(score, 9),
    )


def texts():
    own = MIT.split()
    changed = own[:20] + ["whatsoever"] + own[20:40] + own[42:]  # a word put in, two left out
    filler = " ".join(f"word{i}" for i in range(L.STRETCH - 1))
    return [
        None, "", "  ...  ", "MIT License", "the MIT-license, mit license mit license.", "GNU General Public\nLicense v3; general public licence",
        " ".join(changed), " ".join(own[: len(own) // 2]), MIT + " " + MIT, MIT.upper(), filler + " mit license " + filler + " general public license",
        "Löwe MIT License é", "MİT License", "apache", "license", "All rights reserved. Licensed under CC BY-NC 4.0.", "a b c\x00mit\x00license",
        "licensed under the apache license version 2 0 " * 50,
    ]


def test_labels_against_dictionaries(spark):
    given = [(i, t, i, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(given, "doc_id bigint, text string, w bigint, template string")
    got = {r["doc_id"]: tuple(r)[1:7] + (round(r["score"], 9),) for r in L.label(docs, L.license_templates(spark)).collect()}
    assert got == {i: brute(t) for i, t, *_ in given}
    assert got[6][5] == "mit" and got[7][5] == ""  # edited wording is found, half of it is not


def test_findings_name_their_words(spark):
    docs = spark.createDataFrame([(1, "x y " + MIT + " z")], "doc_id bigint, text string")
    found = L.findings(docs, L.license_templates(spark)).where("not is_base").collect()
    assert [(r["label"], r["start"], r["end"], r["share"]) for r in found] == [("mit", 2, 2 + len(words(MIT)), 1.0)]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "MIT license")] * 3 + [(1, "apache license")] + [(None, "MIT license"), (None, ""), (None, "MIT license")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["labels"], r["n_base"]) for r in L.label(docs, L.license_templates(spark)).collect())
    assert got == sorted([("1", "mit", 1)] * 3 + [("1", "apache", 1), ("None", "mit", 1), ("None", "", 0), ("None", "mit", 1)])


def test_empty_tables_and_joined_templates(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "MIT license " + MIT)], "doc_id bigint, text string")
    assert L.label(docs.where("false"), L.license_templates(spark)).collect() == []
    none = L.label(docs, L.license_templates(spark).where("false")).collect()
    assert [(r["n_base"], r["labels"], r["score"]) for r in none] == [(0, "", 0.0)]
    sent = L.label(docs, L.license_templates(spark)).collect()
    monkeypatch.setattr(L, "FEW", 0)
    assert L.label(docs, L.license_templates(spark)).collect() == sent


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "MIT license")], "doc_id bigint, text string")
    plan = L.label(docs, L.license_templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan
