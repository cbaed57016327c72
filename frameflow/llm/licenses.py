"""Licence scans by exact set-similarity join, in DataFrame functions throughout.

A template is the set of its words; a text block is a run of BLOCK words (blocks overlap by half, so every phrase of up to
BLOCK/2 words stands whole in some block). Block and template join where the block contains at least the threshold's share of the template's
set. Words are ordered by their frequency in the corpus, rarest first. With n words in a template and o = ceil(threshold * n) needed:
prefix filter: any block that qualifies has one of the template's first n-o+1 words, so only these are looked up;
length filter: a block with fewer than o words of the templates' vocabulary can't qualify;
positional filter: if the first shared word stands at place i (template) and j (block, within the vocabulary), at most
min(n-i, m-j) words can be shared, and fewer than o end the comparison. What passes is compared in full.
Phrases are templates too, of threshold 1 (so their prefix is their rarest word), and must stand consecutively.

Defined results: a null or empty text has no words, no places and score 0; rows with equal ids stay rows of their own (blocks
are grouped by a number given to each row); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BETWEEN, LOWER, UPPER

BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8
#: Phrases that must stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Openings of public licence texts, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution noncommercial international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike international license": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
}


def words(text: Column) -> Column:
    """The words of a text, for comparison with the templates' (ASCII) words: lower() serves, as of all letters beyond ASCII only the
    Kelvin sign becomes an ASCII one; texts with it take the slow way."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def vocabulary(phrases: dict[str, str], templates: dict[str, str]) -> list[str]:
    return sorted({w for t in (*phrases, *templates) for w in t.split()})


def frequencies(docs: DataFrame, known: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each word of the templates stands in the corpus (as many rows as they have words)."""
    found = docs.select(F.explode(F.filter(words(F.col(text_col)), lambda w: w.isin(known))).alias("w")).groupBy("w").count()
    return dict.fromkeys(known, 0) | {r["w"]: r["count"] for r in found.collect()}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: n_words, places (array of start and label of each phrase), matches (array of block, label and
    containment of each template in each block), by the join above."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = vocabulary(phrases, templates)
    often = frequencies(docs, known, text_col)
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (often[w], w)))}
    prefix = []
    for text, label in (*phrases.items(), *templates.items()):
        whole = text in phrases
        own = sorted(set(text.split()), key=rank.get)
        need = len(own) if whole else math.ceil(threshold * len(own) - 1e-9)
        prefix += [(w, i, label, text.split() if whole else own, need, [o for o, x in enumerate(text.split()) if x == w] if whole else [], whole)
                   for i, w in enumerate(own[: len(own) - need + 1])]
    schema = "word string, i int, label string, own array<string>, need int, offsets array<int>, whole boolean"
    # as many rows as the templates have prefix words: fixed by the templates, whatever the corpus
    lookup = F.broadcast(spark.createDataFrame(prefix, schema))
    wanted = sorted({p[0] for p in prefix})
    ranked = F.create_map(*[F.lit(x) for w in known for x in (w, rank[w])])

    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    found = rows.withColumn("hit", F.explode_outer(hits)).select("row", "doc_id", "words", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
    pairs = found.join(lookup, "word", "left")

    starts = F.filter(F.transform("offsets", lambda o: F.col("at") - o), lambda s: (s >= 0) & (F.slice("words", s + 1, F.size("own")) == F.col("own")))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - BLOCK) / STRIDE).cast("int") + 1)
    blocks = F.when(F.col("whole") == F.lit(False), F.sequence(first, F.floor(F.col("at") / STRIDE).cast("int")))

    def compare(b: Column) -> Column:
        block = F.array_distinct(F.filter(F.slice("words", b * STRIDE + 1, F.lit(BLOCK)), lambda w: w.isin(known)))
        order = F.array_sort(F.transform(block, lambda w: ranked[w]))
        j = F.array_position(order, ranked[F.col("word")]) - 1
        bound = F.least(F.size("own") - F.col("i"), F.size(order) - j)
        shared = F.when((F.size(order) >= F.col("need")) & (bound >= F.col("need")), F.size(F.array_intersect(block, F.col("own")))).otherwise(F.lit(0))
        return F.struct(b.alias("block"), F.col("label").alias("label"), (shared / F.size("own")).alias("containment"), (shared >= F.col("need")).alias("ok"))

    out = pairs.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.col("whole"), F.transform(starts, lambda s: F.struct(s.cast("long").alias("start"), F.col("label").alias("label")))).alias("places"),
        F.filter(F.transform(blocks, compare), lambda m: m["ok"]).alias("matches"))
    return out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches")).drop("row")


def summary(scanned: DataFrame) -> DataFrame:
    """The digest of scan(): counts, first and last place, labels and the best containment."""
    base, all_labels = F.col("places")["label"], F.concat(F.col("places")["label"], F.col("matches")["label"])
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.col("places")["start"]).alias("first_word"),
        F.array_max(F.col("places")["start"]).alias("last_word"), join(base).alias("base_labels"), join(all_labels).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
