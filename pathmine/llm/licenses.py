"""License scan: phrases and notices by an exact set-similarity join, in DataFrame functions only.

A text's blocks are overlapping word windows, whatever its line breaks: for a template of n words, 1.5 n words long and so
close that every span of 1.25 n words lies inside one. A template's containment in a block is the share of its distinct
words that the block holds. Words of all templates are ordered by their frequency over all documents, rarest first. Of a
template with m words and needed overlap a, only the first m - a + 1 words can be the rarest shared one (prefix filter),
so only blocks around such words are looked at; a block needs a template words itself (length filter); and a shared
word's places in both ordered sets bound the overlap (positional filter). The base phrases are templates of the same join
with every word needed and blocks of their own length, whose word order is then compared.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

#: What separates words; base phrases; notices of the method's own.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License Version 2 0"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("cc-by-nc", "licensed under the Creative Commons Attribution NonCommercial 4 0 International License"),
    ("cc-by", "licensed under the Creative Commons Attribution 4 0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
]


def words_of(text: Column) -> Column:
    # lower() changes more than A-Z, but no word boundary and no letter into one of the phrases'
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def ordered_templates(docs: DataFrame, templates: list[tuple[str, str, float]]) -> tuple[list, dict[str, int]]:
    """[(label, words in order, distinct words rarest first, needed overlap)] and the rank of each template word by its
    count over all rows."""
    texts = [(label, "".join(c if c.isalnum() else " " for c in t.lower()).split(), threshold) for label, t, threshold in templates]
    vocab = sorted({w for _, words, _ in texts for w in words})
    counted = docs.select(F.explode(F.filter(words_of(F.col("_text")), lambda w: w.isin(vocab))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # at most the template words
    rank = {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (seen.get(w, 0), w)))}
    return [(label, words, sorted(set(words), key=rank.__getitem__), _needed(len(set(words)), threshold)) for label, words, threshold in texts], rank


def windows(n: int, exact: bool) -> tuple[int, int]:
    """(length, distance) of the blocks for a template of n words."""
    length, span = (n, n) if exact else (math.ceil(1.5 * n), math.ceil(1.25 * n))
    return length, length - span + 1


def blocks_around(docs: DataFrame, templates: list, exact: set[int]) -> DataFrame:
    """(_id, _h, _t, _start, _block) of the blocks that hold one of their template's prefix words."""
    heads = [(w, t, *windows(len(words), t in exact)) for t, (_, words, rare, need) in enumerate(templates) for w in rare[: len(rare) - need + 1]]
    rare = sorted({w for w, *_ in heads})
    table = docs.sparkSession.createDataFrame(heads, "_w string, _t int, _length int, _step int")
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    hits = docs.withColumn("_words", words_of(F.col("_text"))).where(F.exists("_words", lambda w: w.isin(rare))).select(
        "_id", "_h", "_words", F.explode(at).alias("_hit")).join(F.broadcast(table), F.col("_hit.w") == F.col("_w"))
    first = F.ceil(F.greatest(F.col("_hit.i") - F.col("_length") + 1, F.lit(0)) / F.col("_step")).cast("int")
    starts = F.transform(F.sequence(first, F.floor(F.col("_hit.i") / F.col("_step")).cast("int")), lambda k: k * F.col("_step"))
    return hits.select("_id", "_h", "_t", "_length", "_words", F.explode(starts).alias("_start")).select(
        "_id", "_h", "_t", "_start", F.slice("_words", F.col("_start") + 1, F.col("_length")).alias("_block")).dropDuplicates(["_id", "_h", "_t", "_start"])


def block_matches(blocks: DataFrame, key: list[str], templates: list, rank: dict[str, int]) -> DataFrame:
    """``blocks`` (key columns, _t = number of the template, _words array) -> (key columns, _t, containment) of those at or
    over the needed overlap. ``templates`` and ``rank`` are bounded by the template list; what is gathered per block is
    too."""
    spark = blocks.sparkSession
    ranks = spark.createDataFrame(list(rank.items()), "w string, rank int")
    sets = blocks.select(*key, "_t", F.explode(F.array_distinct("_words")).alias("w")).join(F.broadcast(ranks), "w").groupBy(*key, "_t").agg(
        F.sort_array(F.collect_set("rank")).alias("_set"))
    heads = spark.createDataFrame(
        [(t, rank[w], i, len(s), need, [rank[x] for x in s]) for t, (_, _, s, need) in enumerate(templates)
         for i, w in enumerate(s[: len(s) - need + 1])],
        "_t int, rank int, i int, m int, need int, all array<int>")
    least = min(need for *_, need in templates)
    tails = sets.where(F.size("_set") >= least).select(*key, "_t", "_set", F.posexplode(F.slice("_set", 1, F.size("_set") - (least - 1))).alias("j", "rank"))
    size = F.size("_set")
    pairs = tails.join(F.broadcast(heads), ["_t", "rank"]).where(
        (size >= F.col("need")) & (F.col("j") <= size - F.col("need"))
        & (F.least("i", "j") + 1 + F.least(F.col("m") - F.col("i") - 1, size - F.col("j") - 1) >= F.col("need")))
    shared = F.size(F.array_intersect("_set", "all"))
    return pairs.where(shared >= F.col("need")).groupBy(*key, "_t").agg(F.max(shared / F.col("m")).alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                  templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest
    containment found, 1 with a base phrase, 0 without any).

    Null and empty texts: no words, no labels. Rows with equal id and text, null ids too, get equal results. A text of any
    length is scanned whole. Other columns are not read. Empty table: empty result.
    """
    d = C.id_text(docs, id_col, text_col).withColumn("_h", F.xxhash64("_text"))
    listed = [(label, phrase, 1.0) for label, phrase in PHRASES.items()] + [(label, t, threshold) for label, t in templates or TEMPLATES]
    known, rank = ordered_templates(d, listed)
    exact = set(range(len(PHRASES)))
    spark = docs.sparkSession
    said = spark.createDataFrame([(t, label, words if t in exact else None) for t, (label, words, _, _) in enumerate(known)],
                                 "_t int, _label string, _phrase array<string>")
    blocks = C.written(blocks_around(d.select("_id", "_h", "_text"), known, exact), "license-blocks")
    # a phrase's words must stand in its order, too; a notice (no phrase) is told by containment alone
    blocks = blocks.join(F.broadcast(said), "_t").select(
        "_id", "_h", "_t", "_start", F.col("_block").alias("_words"), (F.col("_block") == F.col("_phrase")).alias("_base"))
    found = block_matches(blocks, ["_id", "_h", "_start", "_base"], known, rank)
    every = found.where("_base is null or _base").join(F.broadcast(said.select("_t", "_label")), "_t")
    start = F.when(F.col("_base"), F.col("_start"))
    per = every.groupBy(F.col("_id").alias("_fid"), F.col("_h").alias("_fh")).agg(
        F.count(start).alias("_n"), F.min(start).alias("_first"), F.max(start).alias("_last"), F.collect_set(F.when(F.col("_base"), F.col("_label"))).alias("_own"),
        F.collect_set("_label").alias("_labels"), F.max("containment").alias("_best"))
    table = d.select("_id", "_h", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"))
    out = table.join(per, table["_id"].eqNullSafe(per["_fid"]) & (table["_h"] == per["_fh"]), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("_n", F.lit(0)).cast("long").alias("n_base"),
        F.col("_first").cast("long").alias("first_word"), F.col("_last").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce("_own", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.coalesce("_labels", none)), ",").alias("labels"), F.coalesce("_best", F.lit(0.0)).alias("score"))
