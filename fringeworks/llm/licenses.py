"""License scans by an exact set-similarity join; DataFrame functions only.

Texts are sequences of words; blocks are windows of two steps of words that begin every step, so that a passage of up to one step lies wholly in one; a step has STEP words, or as many as the longest
template. Templates are license sentences, and the base phrases with a containment of 1. A block meets a template of n distinct words at containment c if it has at least need = ceil(c n) of
them, and if the template's distinguishing phrases stand in it word by word: which license is meant hangs on few words ("lesser", "nc", a version), which containment alone would let go.
1. Vocabulary: the words of all templates, ordered by their frequency in the whole table, rare first (one pass; the counts are bounded by the templates).
2. Prefix filter: a block that meets a template has one of the template's n - need + 1 rarest words. Words of the text that are in no prefix never start a block's work.
3. Blocks around such words become sorted sets of vocabulary ranks; each rank that is in a prefix is joined with its templates, which stand in an array by rank (bounded by the templates).
   Length filter: a block has at least need ranks. Positional filter: the words from the first shared one on, in both orders, must suffice.
4. Overlaps are counted in full; phrases are then looked for word by word in the blocks that the join found.
Index and templates are constants of the expression, so the join runs within a row: one pass over the texts, and no shuffle whatever ids and blocks there are.

Defined cases: null and empty texts have no words and no labels; every row gets its own result, whether its id is null or repeated; templates without words are an error; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64
#: Parts words; all characters from U+0080 on belong to words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (phrase, label), fixed by the query's contract: found where the words stand consecutively.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: (sentence, label, distinguishing phrases), found where a block holds CONTAINMENT of its words and the phrases: common license notices.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2.0", ("apache license version 2 0",)),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-notice", ("gnu general public license as published by",)),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", ("gnu general public license version 3",)),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit-grant", ("free of charge to any person obtaining a copy",)),
    ("Released under the MIT License.", "mit-release", ("the mit license",)),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", ("in source and binary forms",)),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0", ("mozilla public license v 2 0",)),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", ("cc by nc 4 0",)),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0", ("attribution sharealike 4 0",)),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", ("permission to use copy modify and or distribute this software",)),
    ("All rights reserved", "all-rights-reserved", ("all rights reserved",)),
)
CONTAINMENT = 0.8


def split_words(text: str) -> list[str]:
    """The words of a template, as word_array() takes them from a column."""
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SEPARATOR, low) if w]


def word_array(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null is empty. lower() changes further letters, of which only two become ASCII."""
    text = F.coalesce(text, F.lit(""))
    capitals = "".join(map(chr, range(65, 91)))
    low = F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a")), F.translate(text, capitals, capitals.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATOR), "")


def _vocabulary(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word by its count in the table, rare first, ties by the word. What is collected is bounded by the templates."""
    counts = words.select(F.explode("words").alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()
    seen = {r["w"]: r["count"] for r in counts}
    return {w: i + 1 for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}


def step_of(templates=TEMPLATES) -> int:
    return max([STEP, *(len(split_words(t)) for t, *_ in templates)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, places (array of (start, label) of phrases) and met (array of (label, containment) of templates, one for each block that meets one)."""
    words = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), word_array(F.col(text_col)).alias("words"))
    sets = [(split_words(t), label, 1.0, [], True) for t, label in phrases] + [(split_words(t), label, containment, list(must), False) for t, label, must in templates]
    if not all(s for s, *_ in sets):
        raise ValueError("a template without words")
    step = step_of(templates)
    rank = _vocabulary(words, sorted({w for s, *_ in sets for w in s}))
    by_rank, known = {r: w for w, r in rank.items()}, []
    asks: list[list[int]] = [[] for _ in by_rank]
    for k, (seq, label, share, must, exact) in enumerate(sets):
        ranks = sorted({rank[w] for w in seq})
        need = ceil(share * len(ranks) - 1e-9)
        for r in ranks[: len(ranks) - need + 1]:
            asks[r - 1].append(k + 1)
        known.append((ranks, need, label, seq if exact else None, [f" {' '.join(split_words(m))} " for m in must]))

    def constant(x) -> Column:
        return F.array(*map(constant, x)) if isinstance(x, list) else F.lit(x)

    none = F.array().cast("array<int>")
    prefix = [r for r in by_rank if asks[r - 1]]
    by_prefix = F.array(*[constant(ks) if ks else none for ks in asks])
    template = F.array(*[F.struct(constant(r).alias("ranks"), F.lit(need).alias("need"), F.lit(label).alias("label"), (constant(seq) if seq else F.lit(None).cast("array<string>")).alias("seq"), constant(must).cast("array<string>").alias("must")) for r, need, label, seq, must in known])
    # frequent words first, as they are looked up most: position from the end is the rank
    ordered, n = constant([by_rank[r] for r in sorted(by_rank, reverse=True)]), len(by_rank)

    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin([by_rank[r] for r in prefix]), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.floor(i / step), F.greatest(F.floor(i / step) - 1, F.lit(0))))))
    blocks = F.transform(starts, lambda b: F.struct((b * step).alias("start"), F.slice("words", (b * step).cast("int") + 1, 2 * step).alias("words")))

    def ranked(b: Column) -> Column:
        own = F.array_distinct(F.filter(b["words"], lambda w: w.isin(list(rank))))
        ranks = F.array_sort(F.transform(own, lambda w: (F.lit(n + 1) - F.array_position(ordered, w)).cast("int")))
        return F.struct(b["start"].alias("start"), b["words"].alias("words"), ranks.alias("ranks"))

    def judged(b: Column) -> Column:
        # only words of prefixes ask for templates
        asked = F.array_distinct(F.flatten(F.transform(b["ranks"], lambda r: F.element_at(by_prefix, r))))
        return F.transform(F.filter(F.transform(asked, lambda k: F.element_at(template, k)), lambda t: holds(b, t)), lambda t: found(b, t))

    def holds(b: Column, t: Column) -> Column:
        shared = F.array_intersect(t["ranks"], b["ranks"])
        first = F.element_at(shared, 1)
        room = 1 + F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], first), F.size(b["ranks"]) - F.array_position(b["ranks"], first))
        text = F.concat(F.lit(" "), F.array_join(b["words"], " "), F.lit(" "))
        return (F.size(b["ranks"]) >= t["need"]) & (room >= t["need"]) & (F.size(shared) >= t["need"]) & F.forall(t["must"], lambda m: F.contains(text, m))

    def found(b: Column, t: Column) -> Column:
        # a phrase's places in the block's own half; those in the other half belong to the next block
        own = F.filter(F.sequence(F.lit(0), F.least(F.size(b["words"]), F.lit(step)) - 1), lambda i: (F.element_at(b["words"], i + 1) == F.element_at(t["seq"], 1)) & (F.slice(b["words"], i + 1, F.size(t["seq"])) == t["seq"]))
        hit = F.when(t["seq"].isNotNull(), F.transform(own, lambda i: F.struct((b["start"] + i).cast("bigint").alias("start"), t["label"].alias("label"))))
        met = F.when(t["seq"].isNull(), F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["ranks"], b["ranks"])) / F.size(t["ranks"])).alias("containment")))
        return F.struct(hit.alias("hit"), met.alias("met"))

    done = words.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.flatten(F.transform(F.transform(blocks, ranked), judged)).alias("found"))
    hits = F.flatten(F.transform(F.filter("found", lambda x: x["hit"].isNotNull()), lambda x: x["hit"]))
    met = F.array_distinct(F.transform(F.filter("found", lambda x: x["met"].isNotNull()), lambda x: x["met"]))
    return done.select("doc_id", "n_words", hits.alias("places"), met.alias("met"))
