"""License scans by diagonal voting, in DataFrame functions alone.

Every text is cut into words, and all its rolling word grams are joined with the places of the same
grams in the templates. A gram at word i of a text and word j of a template votes for the diagonal
i - j, the word where the template would begin. Votes are counted by diagonal, diagonals of a
template that lie within its slack are merged (words left out or put in shift the rest by some), and
each merged span is verified: the share of the template is the lesser of the template words that
its grams cover and of the text's words that they cover, over the template's length. A span whose
share reaches the template's own threshold is a finding. Phrases have a threshold of one and no slack, so that
they are found exactly where their words stand consecutively.

Templates of at least ``GRAM`` words vote by grams of that width, shorter ones by pairs of words (a
single word by itself). Grams are compared by their hash and word by word, so no vote is a collision.

Long texts are cut into stretches of ``STRETCH`` words that overlap by a gram, so that no row holds all grams
of a text. A text's grams are joined where they are made; only votes are shuffled, and those of
equal rows (same id and text) are counted together before the shuffle. Templates are broadcast if their grams
are at most ``FEW``, else joined.

Defined results: a null text is empty; a text without words has no findings and score 0; rows with equal
id and text each get their row; a null id is kept as an id of its own; an empty table gives an empty
table; other columns are not read, whatever their names. Without templates nothing is found. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

GRAM, SHORT = 4, 2
STRETCH = 4096
FEW = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words

# Phrases whose every place counts.
PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# The wording of public license notices, found with words changed, left out or put in.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
            "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
]


def license_templates(spark: SparkSession) -> DataFrame:
    """label, text, is_base, threshold of the phrases and notices above."""
    rows = [(label, text, True, 1.0) for label, text in PHRASES] + [(label, text, False, 0.8) for label, text in NOTICES]
    return spark.createDataFrame(rows, "label string, text string, is_base boolean, threshold double")


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row, however often it is read."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _gram_hash(width: Column, widths: list[int], word: Callable[[int], Column]) -> Column:
    """The hash of a gram of one of the widths. It can't be null, so that no filter computes it once more."""
    hashes = {w: F.xxhash64(F.lit(w), *[word(j) for j in range(w)]) for w in widths}
    made = hashes.pop(widths[0])
    for w, value in hashes.items():
        made = F.when(width == w, value).otherwise(made)
    return made


def template_grams(templates: DataFrame) -> DataFrame:
    """template, label, is_base, threshold, size, slack, place, width, hash, gram: the grams of each template by their first word."""
    named = templates.select("label", "is_base", "threshold", words_of(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    named = named.withColumn("template", F.xxhash64("label", "is_base", "threshold", "w")).withColumn("size", F.size("w"))
    slack = F.when(F.col("threshold") >= 1, 0).otherwise(F.floor(F.col("size") * (1 - F.col("threshold")) / 2)).cast("int")
    width = F.when(F.col("size") >= GRAM, GRAM).otherwise(F.least(F.col("size"), F.lit(SHORT)))
    cut = named.withColumn("width", width).select("*", slack.alias("slack"), F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width"))).alias("place"))
    hashed = _gram_hash(F.col("width"), sorted({1, SHORT, GRAM}), lambda j: F.get("w", F.col("place") + j))
    return cut.select("template", "label", "is_base", "threshold", "size", "slack", "place", "width", hashed.alias("hash"), F.slice("w", F.col("place") + 1, F.col("width")).alias("gram"))


def _votes(docs: DataFrame, grams: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, mark, diagonal and the template's columns for each common gram; and for each text a row of width 0
    with the number of words as its diagonal.

    Places are expanded from a row that holds a stretch of words, and grams are hashed and joined in the same
    generated code, so that a gram is never a row of its own before it has met a template.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _held(docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("mark"), "text"), "w", words_of(F.col("text"))).drop("text")
    reach = max(widths) - 1
    ends = lambda i: F.least(i + (STRETCH + reach), F.size("w")) - 1
    part = lambda i: F.when(F.size("w") > 0, F.transform(F.sequence(i, ends(i)), lambda j: F.get("w", j))).otherwise(F.col("w"))
    firsts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRETCH))
    stretches = F.transform(firsts, lambda i: F.struct(i.alias("first"), part(i).alias("part"), F.size("w").alias("n")))
    cut = rows.select("doc_id", "mark", F.explode(stretches).alias("s")).select("doc_id", "mark", "s.*")
    kinds = F.when(F.col("first") == 0, F.array(*map(F.lit, [0, *widths]))).otherwise(F.array(*map(F.lit, widths)))
    cut = cut.select("*", F.explode(kinds).alias("wide"))
    last = F.least(F.lit(STRETCH), F.size("part") - F.col("wide") + 1) - 1
    places = F.when(F.col("wide") == 0, F.array("n")).when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cut = cut.select("doc_id", "mark", "first", "part", "wide", F.explode(places).alias("at"))
    word = lambda j: F.get("part", F.col("at") + j)
    hashed = _gram_hash(F.col("wide"), [0, *widths], word)
    same = F.col("wide") == F.col("width")
    for j in range(max(widths)):
        same = same & ((F.col("wide") <= j) | (word(j) == F.get("gram", F.lit(j))))
    met = cut.withColumn("own", hashed).join(grams, (F.col("own") == F.col("hash")) & same)
    return met.withColumn("diagonal", F.col("first").cast("bigint") + F.col("at") - F.col("place")).drop("part", "gram")


def scan(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, mark, n_words, copies) and their merged diagonals (doc_id, mark, template, label, is_base,
    threshold, start, end, share): begin and end are words from 0, the end exclusive.

    Spans below the threshold are kept with their share; a finding is one that reaches it.
    """
    rows = _spans(docs, templates)
    texts = rows.where("template is null").select("doc_id", "mark", F.col("start").alias("n_words"), "copies")
    return texts, rows.where("template is not null").drop("copies")


def _spans(docs: DataFrame, templates: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    grams = template_grams(templates)
    facts = grams.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()  # at most three widths
    # meets each text's own row
    head = spark.range(1).select(_gram_hash(F.lit(0), [0], F.lit).alias("hash"), *[F.lit(0).alias(c) for c in ("width", "place", "size", "slack")])
    grams = grams.unionByName(head, allowMissingColumns=True)
    votes = _votes(docs, F.broadcast(grams) if facts["n"] <= FEW else grams, sorted(facts["widths"]) or [1])
    kept = ["label", "is_base", "threshold", "size", "slack", "width"]
    counted = votes.groupBy("doc_id", "mark", "template", "diagonal").agg(
        *[F.first(c).alias(c) for c in kept], F.array_sort(F.collect_set("place")).alias("places"), F.count("*").alias("copies")
    )
    dealt = counted.repartition("doc_id", "mark")
    line = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    begins = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.col("slack"), F.lit(True))
    grouped = dealt.withColumn("begins", begins.cast("int")).withColumn("merged", F.sum("begins").over(line))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1))))
    grouped = grouped.withColumn("own", F.when(F.col("template").isNotNull(), covered))
    of_template = F.size(F.array_distinct(F.flatten(F.collect_list("own"))))
    of_text = F.array_distinct(F.flatten(F.collect_list(F.transform("own", lambda p: p + F.col("diagonal")))))
    spans = grouped.groupBy("doc_id", "mark", "template", "merged").agg(
        *[F.first(c).alias(c) for c in kept], F.min("diagonal").alias("least"), F.sum("copies").alias("copies"),
        of_template.alias("template_words"), of_text.alias("text_words"),
    )
    share = F.least(F.col("template_words"), F.size("text_words")) / F.col("size")
    start = F.when(F.col("template").isNull(), F.col("least")).otherwise(F.array_min("text_words"))
    return spans.select(
        "doc_id", "mark", "template", "label", "is_base", "threshold", start.alias("start"), (F.array_max("text_words") + 1).alias("end"),
        F.when(F.col("template").isNotNull(), share).alias("share"), "copies",
    )


def findings(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, label, is_base, start, end, share of each finding, once for texts with equal id and words."""
    found = _spans(docs, templates).where("template is not null and share >= threshold")
    return found.select("doc_id", "mark", "label", "is_base", "start", "end", "share")


def label(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    The score is the highest share of any span, whether it reaches its threshold or not.
    """
    spans = _spans(docs, templates)
    text = F.col("template").isNull()
    found = F.coalesce(F.col("share") >= F.col("threshold"), F.lit(False))
    base = found & F.col("is_base")
    joined = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    rows = spans.groupBy("doc_id", "mark").agg(
        F.max(F.when(text, F.col("start"))).cast("bigint").alias("n_words"), F.max(F.when(text, F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(found).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
