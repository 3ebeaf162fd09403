"""License scans by an exact set-similarity join, in DataFrame functions only.

Templates and text blocks are sets of words. Words are ordered by their frequency over all texts,
rarest first; a block can only contain the needed share of a template if it has one of the
template's first words in that order (prefix), enough words at all (length), and enough words
left after the match on both sides (position). Pairs that pass are checked in full.

A block is a window of `WINDOW` words at every `STRIDE` words, so that each run of STRIDE + 1
words lies whole in one. Only words of the templates count, so other words are left out first.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import held, text_of

#: Share of a template's words that a block must contain.
CONTAINMENT = 0.8
WINDOW, STRIDE = 64, 32

#: Phrases whose consecutive places count as base matches, with their label (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Sentences of common licenses with their label (fixed values).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased: everything outside ASCII and ASCII letters and digits.

    Full lower-casing keeps the borders of words, and U+212A is the only other character that it
    turns into a plain letter, so that one is set aside. Splitting is ten times as fast as
    extracting here.
    """
    lower = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def places(words: str, phrase: str) -> Column:
    """Starts of all places where the words of a phrase stand consecutively; `words` names a column."""
    wanted = phrase.split()
    array = F.col(words)
    match = lambda i: reduce(lambda a, b: a & b, [F.get(array, i + k) == w for k, w in enumerate(wanted)])
    there = F.array_contains(array, wanted[0]) & (F.size(array) >= len(wanted))  # most texts lack the first word
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(array) - len(wanted)), match)).otherwise(F.expr("cast(array() as array<int>)"))


def word_order(rows: DataFrame, words: str, vocabulary: list[str]) -> list[str]:
    """The template words, rarest over all texts first (ties by word). One row per template word is
    collected, so the templates bound it."""
    seen = rows.select(F.explode(words).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in seen}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(blocks: DataFrame, by: list[str], words: str, order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Every (block, template) whose block has at least `containment` of the template's words.

    `blocks`: the columns `by`, and an array of words. Adds label and containment.
    """
    spark = blocks.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for number, (label, sentence) in enumerate(templates):
        own = sorted(set(sentence.split()), key=rank.__getitem__)
        needed = math.ceil(round(containment * len(own), 9))
        prefixes += [(w, number, label, own, at, needed) for at, w in enumerate(own[: len(own) - needed + 1])]
    firsts = sorted({p[0] for p in prefixes})
    table = spark.createDataFrame(prefixes, "token string, template int, label string, own array<string>, at int, needed int")
    shortest = min(p[5] for p in prefixes)
    in_order = F.array_intersect(F.array(*map(F.lit, order)), F.col(words))  # keeps the order of the first
    sets = blocks.where(F.arrays_overlap(words, F.array(*map(F.lit, firsts)))).select(*by, in_order.alias("set"))
    sets = sets.where(F.size("set") >= shortest)  # length
    tokens = sets.select(*by, "set", F.posexplode("set").alias("place", "token")).where(F.col("token").isin(firsts))
    # the templates are a constant of a few sentences
    pairs = tokens.join(F.broadcast(table), "token")
    left_over = 1 + F.least(F.size("own") - 1 - F.col("at"), F.size("set") - 1 - F.col("place"))
    pairs = pairs.where((F.size("set") >= F.col("needed")) & (left_over >= F.col("needed")))  # length and position
    share = F.size(F.array_intersect("set", "own")) / F.size("own")
    pairs = pairs.where(F.size(F.array_intersect("set", "own")) >= F.col("needed"))
    return pairs.select(*by, "label", "template", share.alias("containment"))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: id, n_words, base (places by label), blocks (label, start word,
    containment of each matching window), labels and score.

    The score is 1 where a phrase stands, else the best containment found, else 0. Null and empty
    texts have no words. Rows with one id are told apart by their texts.
    """
    key, digest, array = "doc_id", "digest", "words"
    rows = docs.select(F.col(id_column).alias(key), text_of(text).alias("text"))
    rows = held(rows.select(key, F.xxhash64("text").alias(digest), words_of(F.col("text")).alias(array)), array)
    vocabulary = sorted({w for _, sentence in templates for w in sentence.split()})
    order = word_order(rows, array, vocabulary)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / STRIDE)).cast("int"))
    # texts without any first word of a template have no matching block
    rank = {w: k for k, w in enumerate(order)}
    firsts: set[str] = set()
    for _, sentence in templates:
        own = sorted(set(sentence.split()), key=rank.__getitem__)
        firsts |= set(own[: len(own) - math.ceil(round(containment * len(own), 9)) + 1])
    near = rows.where(F.arrays_overlap(array, F.array(*map(F.lit, sorted(firsts)))))
    blocks = near.select(key, digest, array, F.explode(starts).alias("number"))
    blocks = blocks.select(key, digest, (F.col("number") * STRIDE).alias("start"), F.slice(array, F.col("number") * STRIDE + 1, WINDOW).alias("block"))
    found = matches(blocks, [key, digest, "start"], "block", order, templates, containment)
    found = found.groupBy(F.col(key).alias("found_id"), F.col(digest).alias("found_digest")).agg(F.array_sort(F.collect_set(F.struct("label", "start", "containment"))).alias("blocks"))
    base = rows.select(key, digest, F.size(array).cast("long").alias("n_words"), *(places(array, phrase).alias(label) for phrase, label in PHRASES))
    joined = base.join(found, F.col(key).eqNullSafe(F.col("found_id")) & (F.col(digest) == F.col("found_digest")), "left")
    base_labels = F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for _, label in PHRASES)))
    blocks_ = F.coalesce("blocks", F.expr("cast(array() as array<struct<label:string,start:int,containment:double>>)"))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(blocks_, lambda b: b.label))))
    best = F.coalesce(F.array_max(F.transform(blocks_, lambda b: b.containment)), F.lit(0.0))
    return joined.select(
        F.col(key).alias(id_column), "n_words", F.struct(*(label for _, label in PHRASES)).alias("base"), F.array_sort(base_labels).alias("base_labels"),
        blocks_.alias("blocks"), labels.alias("labels"), F.when(F.size(base_labels) > 0, 1.0).otherwise(best).alias("score"),
    )
