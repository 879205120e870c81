"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A text block is `block` consecutive words, starting every block // 2 words, so a statement of up to
block // 2 + 1 words lies whole inside one block. A block matches a template when it holds at least the template's own share of its distinct words:
each template states how much of it a statement must hold, since in a short one a single word tells two licences
apart. The join is exact: words are ordered by how many
documents of the whole input hold them, rarest first; a matching block must hold one of a template's
first |T| - need + 1 words (prefix filter), need template words at least (length filter), and enough
words after the first shared one (positional filter). What passes is verified on the full sets.
Words outside all templates can't change a result and are left out of the blocks' sets, so a block's
row is bounded by the templates. The broadcast side is the templates' prefixes, which don't grow with
the data. Only built-in functions run.

Fixed phrases are found as well: every place where a phrase's words stand consecutively.

Defined results: a null or empty text has no words, no labels and score 0; rows repeated with the same
id and text each get that text's result; ties don't arise, since all matches are reported; very long
texts are scanned whole, block by block; an empty table gives none; columns other than id and text don't reach the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm._shared import let, lower_ascii, text_key

# Phrases and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# Opening statements of public licences, their labels, and the share of its words that a statement must hold.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", 1.0),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", 0.85),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.85),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.85),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    ("gpl", "this work is licensed under the gnu general public license version 3", 0.85),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.85),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.85),
    ("mit", "released under the mit license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.85),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.85),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of the whole text; none for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _in(word: Column, known: Sequence[str]) -> Column:
    return word.isin(list(known))


def phrase_places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """array<struct<pos, label>> of all places; looked for word by word only in texts that hold a phrase at all."""
    found = [F.array().cast("array<struct<pos:bigint,label:string>>")]
    for phrase, label in phrases:
        parts = phrase.split()

        def stands(words, i, parts=parts):
            match = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                match = match & (F.get(words, i + k) == part)
            return F.coalesce(match, F.lit(False))

        def places(words, parts=parts, label=label, stands=stands):
            starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: stands(words, i))
            return F.transform(starts, lambda i: F.struct(i.cast("long").alias("pos"), F.lit(label).alias("label")))

        held = (F.size(words) >= len(parts)) & F.arrays_overlap(words, F.array(F.lit(parts[-1])))
        none = F.lit(None).cast("array<struct<pos:bigint,label:string>>")
        found.append(F.coalesce(F.when(held, places(words)).otherwise(none), F.array().cast("array<struct<pos:bigint,label:string>>")))
    return F.concat(*found)


def _frequencies(words: DataFrame, known: Sequence[str]) -> dict[str, int]:
    """Documents that hold each template word, over all documents: at most one row for each known word."""
    held = words.select(F.explode(F.array_distinct(F.filter("_words", lambda w: _in(w, known)))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = 64,
    templates: Sequence[tuple[str, str, float]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best template's containment)."""
    step = block // 2
    sets = [(label, sorted(set(t.split())), share) for label, t, share in templates]
    if too_long := [t for _, t, _ in templates if len(t.split()) > step + 1]:
        raise ValueError(f"templates longer than {step + 1} words need a larger block: {too_long}")
    known = sorted({w for _, ws, _ in sets for w in ws})
    keyed = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    words = keyed.select("_id", "_key", words_of(F.col("_text")).alias("_words"))

    seen = _frequencies(words, known)
    order = sorted(known, key=lambda w: (seen.get(w, 0), w))  # rarest first over the whole input
    rank = {w: i for i, w in enumerate(order)}
    prefixes, sizes = [], []
    for t, (label, ws, share) in enumerate(sets):
        ranks = sorted(rank[w] for w in ws)
        need = math.ceil(share * len(ranks) - 1e-9)
        sizes.append((t, label, ranks, need))
        prefixes += [(r, t, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    spark = docs.sparkSession
    prefix = spark.createDataFrame(prefixes, "rank int, template int, at int, size int, need int")
    full = spark.createDataFrame(sizes, "template int, label string, ranks array<int>, need int")
    first_words = sorted({order[r] for r, *_ in prefixes})
    to_rank = F.create_map(*[x for w in known for x in (F.lit(w), F.lit(rank[w]))])

    def blocks(words):
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - step - 1, F.lit(0)), F.lit(step))
        each = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_distinct(F.filter(F.slice(words, s + 1, block), lambda w: _in(w, known))).alias("held")))
        return F.filter(each, lambda b: F.exists(b["held"], lambda w: _in(w, first_words)))

    any_first = lambda words: F.exists(words, lambda w: _in(w, first_words))
    none = F.array().cast("array<struct<start:int,held:array<string>>>")
    found = (
        words.select("_id", "_key", F.explode(let(F.col("_words"), lambda ws: F.when(any_first(ws), blocks(ws)).otherwise(none))).alias("b"))
        .select("_id", "_key", "b.start", F.array_sort(F.transform("b.held", lambda w: F.element_at(to_rank, w))).alias("ranks"))
    )
    candidates = (
        found.select("_id", "_key", "start", "ranks", F.posexplode("ranks").alias("j", "rank"))
        .join(F.broadcast(prefix), "rank")
        .where("size(ranks) >= need")
        .where("least(at, j) + 1 + least(size - at - 1, size(ranks) - j - 1) >= need")
        .groupBy("_id", "_key", "start", "template")
        .agg(F.first("ranks").alias("held"))
    )
    shared = F.size(F.array_intersect("held", "ranks"))
    matched = (
        candidates.join(F.broadcast(full), "template")
        .where(shared >= F.col("need"))
        .groupBy("_id", "_key")
        .agg(F.collect_set("label").alias("_labels"), F.max(shared / F.size("ranks")).alias("_score"))
        .withColumnsRenamed({"_id": "_mid", "_key": "_mkey"})
    )

    places = let(words_of(F.col("_text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), phrase_places(ws, phrases).alias("at")))
    base = keyed.select("_id", "_key", places.alias("p"))
    joined = base.join(matched, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_key") == F.col("_mkey")), "left")
    own = F.array_distinct(F.transform("p.at", lambda x: x["label"]))
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("p.n").alias("n_words"),
        F.size("p.at").cast("long").alias("n_base"),
        F.array_min(F.transform("p.at", lambda x: x["pos"])).alias("first_word"),
        F.array_max(F.transform("p.at", lambda x: x["pos"])).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("_labels", none))), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
