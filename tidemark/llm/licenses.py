"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line; its words are runs of digits, letters a to z (after lower-casing A to Z)
and characters beyond ASCII. A block meets a template when it holds at least `threshold` of
the template's distinct words. Template words are ordered by the number of documents of the
whole table that hold them, rarest first; a template's prefix is its first |T| - a + 1 words, a the overlap it
asks for, so a block without a prefix word can't meet it. Surviving blocks pass the length filter
(at least a words of the vocabulary) and the positional filter (words left in either after
the first shared word), then the overlap is counted. The templates are fixed and few, so the
join runs inside each row against literals: no shuffle, nothing of the corpus on the driver but
one count for each template word. Blocks are not capped.

With `wrapped`, as the registered query has it, each run of as many words as the template has is
a block too, so a notice broken over lines is met. A run that meets it holds a prefix word;
only runs around one are counted, in documents that hold enough of the template's words.
The SQL knows lines alone: it has fewer labels where a notice is wrapped.

Phrases are base labels: each place where a phrase's words stand next to each other counts.

Null texts are empty: no words, no labels, null first_word and last_word, score 0. Repeated
rows and doc_ids stay as they are; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
import string
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP, _BEFORE, _AFTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: License statements and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
]


def _words(text):
    """A lower-cased text's words, with an empty one before or after them where the text begins or ends with none."""
    return F.split(text, _GAP, -1)


def _count(words):
    """How many of these are words."""
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (F.size(words) - ends).cast("long")


def _literal(words):
    return F.array(*map(F.lit, words))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8, wrapped: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    score is 1 for a document with a phrase, else the largest share of a template that a block
    of it holds, among those met; 0 without any. wrapped: blocks cross line ends too.
    """
    # lower() turns these two, alone of all beyond ASCII, into ASCII letters; other letters beyond it may change case.
    text = F.lower(F.replace(F.replace("text", F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))
    rows = texts_of(docs).select("doc_id", text.alias("t")).withColumn("words", _words("t"))
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    # The number of documents that hold each template word: one row a word comes to the driver.
    held = rows.select(F.explode(F.array_intersect(_literal(vocabulary), "words")).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in held.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    sets = []
    for label, text in templates:
        own = [w for w in order if w in set(text.split())]
        needed = math.ceil(threshold * len(own) - 1e-9)
        sets.append((label, own, needed, own[: len(own) - needed + 1], len(text.split())))
    prefixes = sorted({w for s in sets for w in s[3]})

    def share_of(own, needed, prefix):
        """Of a block, its vocabulary words in global order, the share of a template it holds; null if it is not met."""

        def share(block):
            first = F.element_at(F.array_intersect(_literal(prefix), block), 1)
            room = F.least(F.lit(len(own) + 1) - F.array_position(_literal(own), first), F.size(block) + 1 - F.array_position(block, first))
            overlap = F.size(F.array_intersect(block, _literal(own)))
            candidate = (F.size(block) >= needed) & F.arrays_overlap(block, _literal(prefix))
            return F.when(candidate, F.when(room >= needed, F.when(overlap >= needed, overlap / F.lit(float(len(own))))))

        return share

    def run_share(own, needed, prefix, length):
        """The largest share of a template that a run of `length` words holds; null if none meets it."""
        at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(prefix), i)))
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - F.lit(length - 1), F.lit(0)), i))))
        best = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i + 1, length), _literal(own)))))
        share = F.when(best >= needed, best / F.lit(float(len(own))))
        return F.when(F.arrays_overlap("hits", _literal(prefix)), F.when(F.size(F.array_intersect(_literal(own), "words")) >= needed, share))

    blocks = F.filter(F.transform(F.split("t", "\n", -1), lambda b: F.array_intersect(_literal(order), _words(b))), lambda b: F.arrays_overlap(b, _literal(prefixes)))
    phrase = f"{_BEFORE}(?:{'|'.join(_GAP.join(p.split()) for p in phrases)}){_AFTER}"
    hits = _literal(sorted({*prefixes, *(w for p in phrases for w in p.split())}))
    seen = rows.select("doc_id", "t", _count(F.col("words")).alias("n_words"), F.array_intersect(hits, "words").alias("hits"), *["words"] * wrapped)
    # A document without all words of some phrase needs no search for one.
    maybe = reduce(or_, [F.size(F.array_intersect(F.col("hits"), _literal(p.split()))) == len(set(p.split())) for p in phrases])
    found = seen.select(
        "doc_id", "n_words",
        F.when(F.arrays_overlap("hits", _literal(prefixes)), blocks).alias("blocks"),
        F.when(maybe, F.regexp_extract_all("t", F.lit(phrase), F.lit(0))).alias("places"),
        F.when(maybe, F.split("t", phrase, -1)).alias("around"),
        *[run_share(*s[1:]).alias(f"r{i}") for i, s in enumerate(sets) if wrapped],
    )
    words = lambda c: _count(_words(c))
    n_base = F.coalesce(F.greatest(F.size("places"), F.lit(0)), F.lit(0))
    label_of = lambda p: F.coalesce(*[F.when(F.array_join(_words(p), " ") == k, F.lit(v)) for k, v in phrases.items()])
    base = F.array_sort(F.array_distinct(F.transform(F.coalesce("places", F.array().cast("array<string>")), label_of)))
    met = [F.array_max(F.transform("blocks", share_of(*s[1:4]))) for s in sets]
    met = [(F.greatest(m, f"r{i}") if wrapped else m).alias(f"m{i}") for i, m in enumerate(met)]
    scored = found.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), base.alias("base"),
        F.when(n_base > 0, words(F.element_at("around", 1))).alias("first_word"),
        F.when(n_base > 0, F.col("n_words") - words(F.element_at("around", -1)) - words(F.element_at("places", -1))).alias("last_word"),
        *met,
    )
    added = F.array_compact(F.array(*[F.when(F.col(f"m{i}").isNotNull(), F.lit(s[0])) for i, s in enumerate(sets)]))
    return scored.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", added)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest(*[f"m{i}" for i in range(len(sets))]), F.lit(0.0))).alias("score"),
    )


def license_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8) -> str:
    """The same rows in DuckDB SQL: every line against every template, without filters."""
    word = WORD.replace("'", "''")
    places = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        places.append(f"list_transform(list_filter(range(len(w)), lambda i: {test}), lambda i: {{'at': i, 'label': '{label}'}})")
    shares = []
    for label, text in templates:
        own = sorted(set(text.split()))
        needed = math.ceil(threshold * len(own) - 1e-9)
        listed = "[" + ", ".join(f"'{x}'" for x in own) + "]"
        shares.append(f"list_transform(list_filter(b, lambda x: len(list_intersect(x, {listed})) >= {needed}), lambda x: {{'share': len(list_intersect(x, {listed})) / {float(len(own))}::DOUBLE, 'label': '{label}'}})")
    joined = lambda lists: "list_concat(" * (len(lists) - 1) + lists[0] + "".join(f", {x})" for x in lists[1:])
    labels = lambda c: f"coalesce(array_to_string(list_sort(list_distinct({c})), ','), '')"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w,
  list_transform(string_split(t, chr(10)), lambda x: list_distinct(regexp_extract_all(x, '{word}'))) AS b FROM t),
p AS (SELECT doc_id, w, {joined(places)} AS p, {joined(shares)} AS s FROM w)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base,
  list_min(list_transform(p, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(p, lambda x: x.at))::BIGINT AS last_word,
  {labels("list_transform(p, lambda x: x.label)")} AS base_labels,
  {labels("list_concat(list_transform(p, lambda x: x.label), list_transform(s, lambda x: x.label))")} AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(s, lambda x: x.share)), 0.0)::DOUBLE END AS score
FROM p"""
