"""License scans: fixed phrases with their places, and an exact set-similarity join with license templates.

The phrases are found as consecutive words. The join finds every text block that contains at least ``threshold`` of the
distinct words of a template. Blocks are windows of words, two strides wide and one stride apart, so a notice of up to
a stride of words stands whole in one of them, however its lines are wrapped. The join is exact:

* words are ordered by how many blocks hold them, rarest first, counted over all blocks that could match;
* a template of n words needs ``ceil(threshold * n)`` of them, so a match holds one of its rarest
  ``n - needed + 1`` words (prefix filter), the block has at least ``needed`` template words (length filter, first on
  whole texts, then on blocks), and after the first common word enough words are left on both sides (positional filter);
* blocks that pass are compared in full.

Only template words ever leave a block, and only the rare ones are joined, so common words and long texts do
not multiply rows. The template index is a fixed table and so is broadcast. Built-in expressions only.

Only A-Z are lower-cased. Results: null and empty texts have no words, places or labels (labels are empty strings);
texts of any length are read whole; each row of the table is judged on its own, also when ids repeat; an empty table gives
none.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.session import materialize

#: A word before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words from one block to the next; a block has twice as many.
STRIDE = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Columns that a scan adds; columns of the table with these names give way.
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices in lower case without punctuation, and the labels they stand for.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the software is provided as is without warranty of any kind express or implied": "no-warranty",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved no part of this publication may be reproduced without permission": "reserved",
    "this work is dedicated to the public domain": "public-domain",
}


def _starts(words: Column, phrase: Sequence[str]) -> Column:
    """Where the words of the phrase stand one after another."""
    same = lambda i: [F.get(words, i + k) == word for k, word in enumerate(phrase)]
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0)))

    def here(i: Column) -> Column:
        tests = same(i)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return F.coalesce(out, F.lit(False))

    return F.filter(places, here)


def known_words(words: Column, vocabulary: Sequence[str]) -> Column:
    """The words in lower case where they are in the vocabulary, else null."""
    # Lower-casing changes letters beyond A-Z too; it only screens for the slower exact one.
    exact = lambda w: F.translate(w, _UPPER, _LOWER)
    return F.transform(words, lambda w: F.when(F.lower(w).isin(list(vocabulary)) & exact(w).isin(list(vocabulary)), exact(w)))


def phrase_places(known: Column, distinct: Column, phrases: Mapping[str, str]) -> Column:
    """An array with one array of word places for each phrase; texts without all its words skip the search."""
    none = F.array().cast("array<int>")

    def places(phrase: list[str]) -> Column:
        words = F.array(*[F.lit(w) for w in dict.fromkeys(phrase)])
        return F.when(F.size(F.array_intersect(distinct, words)) == len(set(phrase)), _starts(known, phrase)).otherwise(none)

    return F.array(*[places(p.split()) for p in phrases])


def blocks(known: Column, distinct: Column, table: Sequence[Mapping], stride: int) -> Column:
    """The distinct known words of every window that could match; none where the whole text holds too few."""
    few = [F.size(F.array_intersect(distinct, F.array(*[F.lit(w) for w in t["words"]]))) >= t["needed"] for t in table]
    last = F.greatest(F.ceil((F.size(known) - 2 * stride) / F.lit(stride)), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_distinct(F.array_compact(F.slice(known, k * stride + 1, F.lit(2 * stride)))))
    least = min(t["needed"] for t in table)
    return F.when(reduce(or_, few), F.filter(windows, lambda b: F.size(b) >= least)).otherwise(F.array().cast("array<array<string>>"))


def _joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def scan(
    df: DataFrame, text_col: str = "text", *, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES,
    threshold: float = 0.8, stride: int = STRIDE,
) -> DataFrame:
    """The other columns of ``df`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 where a phrase stands, else the largest share of a template's words found in one block.
    ``stride`` is that of the blocks; templates are no longer than that.
    """
    kept = [c for c in df.columns if c not in (text_col, *OUTPUTS)]
    table = [
        {"label": label, "words": sorted(set(text.split())), "needed": math.ceil(threshold * len(set(text.split())) - 1e-9)}
        for text, label in templates.items()
    ]
    vocabulary = sorted({w for t in table for w in t["words"]})
    least = min(t["needed"] for t in table)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    searched = sorted({*vocabulary, *(w for p in phrases for w in p.split())})
    # Names by transforms of one element: each use would cut the text again otherwise.
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    facts = lambda known, distinct: F.struct(
        F.size(known).cast("long").alias("n_words"), phrase_places(known, distinct, phrases).alias("places"), blocks(known, distinct, table, stride).alias("blocks")
    )
    found = named(known_words(words, searched), lambda known: named(F.array_distinct(F.array_compact(known)), lambda distinct: facts(known, distinct)))
    first = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.monotonically_increasing_id().alias("key"), found.alias("found"))
    first = first.select("row", "key", "found.*")
    rows = materialize(first, "licenses")
    # The order: rarest words first, over all blocks that could match any template.
    frequency = {r[0]: r[1] for r in rows.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("w")).filter(F.col("w").isin(vocabulary)).groupBy("w").count().collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for number, t in enumerate(table):
        ordered = sorted(rank[w] for w in t["words"])
        index += [(word, place, number, len(ordered), t["needed"], t["label"], ordered) for place, word in enumerate(ordered[: len(ordered) - t["needed"] + 1])]
    spark = df.sparkSession
    prefixes = spark.createDataFrame(index, "word int, place int, template int, size int, needed int, label string, words array<int>")
    rank_of = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    rare = F.array(*[F.lit(w) for w in sorted({i[0] for i in index})])
    ranked = F.filter(F.transform("b", lambda w: F.element_at(rank_of, w)), lambda r: r.isNotNull())
    ordered = rows.select("key", F.explode("blocks").alias("b")).select("key", F.array_sort(ranked).alias("block")).filter(F.size("block") >= least)
    probes = ordered.select("key", "block", F.explode(F.array_intersect(F.slice("block", F.lit(1), F.size("block") - least + 1), rare)).alias("word"))
    at = F.array_position("block", F.col("word")) - 1
    pairs = (
        probes.join(F.broadcast(prefixes), "word")  # fixed size: the templates' own words
        .filter((F.size("block") >= F.col("needed")) & (F.least(F.col("size") - F.col("place"), F.size("block") - at) >= F.col("needed")))
        .withColumn("common", F.size(F.array_intersect("block", "words")))
        .filter(F.col("common") >= F.col("needed"))
    )
    matched = pairs.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("share"))
    empty = F.array().cast("array<string>")
    names = F.array(*[F.lit(label) for label in phrases.values()])
    base = F.coalesce(
        F.filter(F.transform(F.arrays_zip(F.col("places").alias("p"), names.alias("n")), lambda z: F.when(F.size(z["p"]) > 0, z["n"])), lambda n: n.isNotNull()), empty
    )
    every = F.flatten("places")
    return (
        rows.select("row", "key", "n_words", "places").join(matched, "key", "left")
        .select(
            *[F.col(f"row.`{c}`") for c in kept],
            "n_words",
            F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_base"),
            F.array_min(every).cast("long").alias("first_word"),
            F.array_max(every).cast("long").alias("last_word"),
            _joined(base).alias("base_labels"),
            _joined(F.concat(base, F.coalesce("found", empty))).alias("labels"),
            F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        )
    )
