"""The pipeline's stages on a small corpus: what must go goes, what is clean stays."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import pii_crf, toxicity

DATA = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    read = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = read.columns, {r["doc_id"] for r in read.select("doc_id").collect()}
    docs, sizes = read, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
        assert left <= ids
        sizes.append(len(left))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] >= 0.6 * len(ids)
    assert sizes[2] == sizes[3] == sizes[4]
    lengths = docs.groupBy("doc_id").sum("length").count()
    assert lengths == sizes[-1]


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def bare(text):
    import re

    words = (re.sub(r"^\W+|\W+$", "", w) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()))
    return [w for w in words if w]


def holds(words, item):
    """Whether a document holds 0.8 of an item's windows of five words, or of fewer where it has fewer."""
    width = min(5, len(item))
    own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    windows = [tuple(item[i : i + width]) for i in range(len(item) - width + 1)]
    return bool(windows) and sum(w in own for w in windows) >= 0.8 * len(windows) - 1e-9


def test_each_stage_against_a_plain_version(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    model = toxicity.fit(docs, labels)  # its scores are held against dictionaries of words elsewhere
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert ids(stages["toxicity"](spark, docs, DATA)) == {k for k, x in scores.items() if x < 0.7}

    sets = {k: five_words(r["text"]) for k, r in rows.items()}
    group = {k: k for k in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                new, old = sorted((group[a], group[b]))
                group = {k: new if g == old else g for k, g in group.items()}
    assert ids(stages["near_duplicates"](spark, docs, DATA)) == set(group.values())

    items = [bare(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {k for k, r in rows.items() if not any(holds(bare(r["text"]), item) for item in items)}
    assert ids(stages["decontamination"](spark, docs, DATA)) == clean and len(clean) < len(rows)

    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["personal_data"](spark, docs, DATA).collect()}
    crf = pii_crf.default_crf()
    for k, r in rows.items():
        text = pii_crf.masked(r["text"], pii_crf.find_spans([r["text"]], crf)[1][0])
        assert masked[k] == (text, len(text) if text != r["text"] else r["n_chars"])

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {k: np.array([*exact.encode(r["text"], add_special_tokens=False).ids, 0], "<u4") for k, r in rows.items()}
    held = {}
    for r in stages["packing"](spark, docs, DATA).collect():
        held.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert {k: sum(r["length"] for r in rs) for k, rs in held.items()} == {k: len(x) for k, x in whole.items()}


def test_edges_pass_through_all_stages(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    extra = ("mark", "sig", "key", "row", "_id", "root", "score", "h")
    schema = ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{c} string" for c in extra)])
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "null id here"), (6, "word " * 20000), (7, "mail a.b@c.org now")]
    docs = spark.createDataFrame([(k, t, None, "s", None, *extra) for k, t in texts], schema)
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, DATA)
            assert left.columns == docs.columns, name
            left = left.cache()
        found = left.collect()
        assert all(tuple(r[c] for c in extra) == extra for r in found)
        packed = corpus_pipeline.STAGES[-1][1](spark, left, DATA)
        if table is docs:
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in found) == [-1, 1, 4, 5, 6, 7]
            assert next(r["text"] for r in found if r["doc_id"] == 7) == "mail [EMAIL] now"
            assert packed.agg(F.countDistinct("sequence_id")).first()[0] >= 1
        else:
            assert not found and packed.count() == 0
