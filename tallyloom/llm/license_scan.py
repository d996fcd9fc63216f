"""License scans: phrases by place, and an exact containment join with templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Phrases are
found wherever their words stand consecutively.

Beyond phrases, every block of every text is held against a set of license
templates: a block belongs to a template if it holds at least ``CONTAINMENT`` of
the template's different words. Blocks are the lines, and, as notices are wrapped,
all runs of a template's number of words / ``CONTAINMENT`` consecutive words,
wherever lines end. The runs are looked for in pieces of a text that overlap by
the longest run, so that each run is whole in one piece; a piece that passes the
filters below is held against the template run by run. The join is exact. Template
words are ordered by the number of texts that hold them, rarest first. A block with
the needed overlap must share a word with the template's prefix (its first
size - needed + 1 words), so only blocks with a prefix word are looked at; then it must
have enough template words at all (length filter), and from the place of the shared
word on, enough words must be left on both sides (positional filter). Survivors are
verified by their whole intersection.

Texts are read once. That pass finds words, phrases and the template words that a
text has anywhere; only texts with enough of them for some template, in which alone
a block can have them, are kept for the join.

Templates are a fixed list, so their words, the counts of those words and the
prefix index are bounded by it; the index joins as a small broadcast table.
Everything is DataFrame functions.

Defined results: a null text is empty, has no words and no label; places are
null without a match; equal labels count once, and equal scores are one; a row that
repeats gets equal results; very long texts are taken whole, in pieces; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import quoted, same, saved

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wording of public license notices, as words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
CONTAINMENT = 0.8
#: Words of a piece, beside those it shares with the next.
PIECE = 128
_APART = "".join(chr(i) for i in range(128) if not (chr(i).isdigit() or chr(i).islower() or chr(i).isupper()))


def spaced(text: Column) -> Column:
    """The text in lower case (A-Z) with a space for every character that is not of a word."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase + _APART, string.ascii_lowercase + " " * len(_APART))


def phrase_places(words: Column, phrase: str) -> Column:
    """All places (in words, from 0) where the words of a phrase stand one after another."""
    parts = phrase.split(" ")
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + at) == part for at, part in enumerate(parts)])
    some = F.size(words) >= len(parts)
    return F.when(some & F.array_contains(words, parts[-1]), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def prepared(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_words, p0, p1, ... (places of each phrase), common (the
    template words that it has), and, where those may be enough for a template, text."""
    sets = [set(words.split()) for _, words in templates]
    every = sorted(set().union(*sets))
    text = F.col(quoted(text_col)).cast("string")
    t = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.array_remove(F.split(spaced(text), " "), "").alias("words"))
    common = F.array_intersect("words", F.array(*[F.lit(w) for w in every])) if every else F.array().cast("array<string>")
    places = [phrase_places(F.col("words"), phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(phrases)]
    t = t.select("doc_id", "text_key", "text", F.size("words").cast("long").alias("n_words"), common.alias("common"), *places)
    enough = F.lit(False)
    for own in sets:
        enough = enough | (F.size(F.array_intersect("common", F.array(*[F.lit(w) for w in sorted(own)]))) >= needed(len(own), containment))
    return t.withColumn("text", F.when((F.size("common") > 0) & enough, F.col("text")))


def word_order(common: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of the templates, those that the fewest texts hold first (ties by the word)."""
    own = sorted({w for _, t in templates for w in t.split()})
    # as many rows as the templates have words
    counts = {r["word"]: r["count"] for r in common.select(F.explode("common").alias("word")).groupBy("word").count().collect()}
    return sorted(own, key=lambda w: (counts.get(w, 0), w))


def needed(size: int, containment: float) -> int:
    """The least overlap o with o / size >= containment."""
    return next(o for o in range(size + 1) if o / size >= containment)


def _contained(blocks: DataFrame, order: list[str], templates, containment: float) -> DataFrame:
    """doc_id, text_key, block, ranked (its words' ranks in their order, 0 for others), template, label, t_own, t_size, need, overlap.

    blocks: doc_id, text_key, block, words. A block that shares several prefix words with a template repeats.
    """
    rank = {w: i + 1 for i, w in enumerate(order)}
    index, sets = [], []
    for number, (label, words) in enumerate(templates):
        own = sorted(rank[w] for w in set(words.split()))
        need = needed(len(own), containment)
        sets.append((number, label, own, need))
        index += [(own[at], number, label, at, len(own), need, own) for at in range(len(own) - need + 1)]
    prefix_words = sorted({order[i[0] - 1] for i in index})
    # as a branch, not only as a filter: Spark may put a test of what follows before a filter
    candidate = F.arrays_overlap("words", F.array(*[F.lit(w) for w in prefix_words]))
    every = F.array(*[F.lit(w) for w in order])
    ranked = F.transform("words", lambda w: F.array_position(every, w))
    blocks = blocks.select("doc_id", "text_key", "block", F.when(candidate, ranked).otherwise(F.array().cast("array<bigint>")).alias("ranked"))
    own = F.array_sort(F.array_distinct(F.filter("ranked", lambda r: r > 0)))
    blocks = blocks.select("doc_id", "text_key", "block", "ranked", own.alias("own"))
    smallest = min(need for *_, need in sets)
    placed = blocks.filter(F.size("own") >= smallest).select("*", F.posexplode("own").alias("at", "word"))
    prefix = blocks.sparkSession.createDataFrame(index, "word long, template int, label string, t_at int, t_size int, need int, t_own array<long>")
    met = placed.join(F.broadcast(prefix), "word")
    long_enough = F.size("own") >= F.col("need")
    left = F.least(F.size("own") - F.col("at"), F.col("t_size") - F.col("t_at"))
    met = met.filter(long_enough & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("own", "t_own"))
    return met.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))


def line_matches(texts: DataFrame, order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_key, label, score for each line of ``texts`` (doc_id, text_key, text) that meets a template."""
    blocks = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    blocks = blocks.select("doc_id", "text_key", "block", F.split(spaced(F.col("line")), " ").alias("words"))
    met = _contained(blocks, order, templates, containment)
    return met.select("doc_id", "text_key", "label", (F.col("overlap") / F.col("t_size")).alias("score"))


def run_words(template: str, containment: float) -> int:
    """How many consecutive words are held against a template."""
    return ceil(len(template.split()) / containment - 1e-9)


def run_matches(texts: DataFrame, order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_key, label, score (of the best run) for each piece of ``texts`` with a run of words that meets a template."""
    runs = [run_words(words, containment) for _, words in templates]
    words = texts.select("doc_id", "text_key", F.array_remove(F.split(spaced(F.col("text")), " "), "").alias("all"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all"), F.lit(1)), F.lit(PIECE)), lambda at: F.slice("all", at, PIECE + max(runs) - 1))
    met = _contained(words.select("doc_id", "text_key", F.posexplode(pieces).alias("block", "words")), order, templates, containment)
    length = F.element_at(F.array(*[F.lit(n) for n in runs]), F.col("template") + 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ranked") - length + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda at: F.size(F.array_intersect(F.slice("ranked", at, length), "t_own"))))
    met = met.withColumn("best", best).filter(F.col("best") >= F.col("need"))
    return met.select("doc_id", "text_key", "label", (F.col("best") / F.col("t_size")).alias("score"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base (array), labels (array), score."""
    read = saved(prepared(docs, phrases, templates, containment, id_col, text_col), "license-words")
    places = [F.col(f"p{i}") for i in range(len(phrases))]
    at = F.concat(*places)
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, phrases, strict=True)]))))
    base = read.select("doc_id", "text_key", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), base.alias("base"))
    if not templates:
        return base.drop("text_key").withColumn("labels", F.col("base")).withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    order = word_order(read, templates)
    texts = read.filter(F.col("text").isNotNull()).select("doc_id", "text_key", "text")
    found = line_matches(texts, order, templates, containment).unionByName(run_matches(texts, order, templates, containment))
    # a document has at most as many labels as there are templates
    own = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    both = base.join(own, same(base["doc_id"], F.col("_id")) & (base["text_key"] == F.col("_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("_score", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", labels.alias("labels"), score.alias("score"))
