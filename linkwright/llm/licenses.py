"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.plans.runtime import stash

__all__ = ["TEMPLATES", "PHRASES", "license_words", "phrase_places", "read_licenses", "template_matches", "scan_licenses"]

_SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
LICENSE_WORD = f"[^{_SEPARATORS}]+"

#: Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Usual license statements, one sentence or notice each; several may share a label.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def _lower(text: Column) -> Column:
    """A-Z lowered, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(LICENSE_WORD), F.lit(0))


def _count(lowered: Column) -> Column:
    return F.regexp_count(lowered, F.lit(LICENSE_WORD)).cast("long")


def phrase_places(lowered: Column, n_words: Column, phrases: dict[str, str] | None = None) -> dict[str, Column]:
    """``n_base, first_word, last_word, base_labels``: where a phrase's words stand one after the other.

    Phrases may not overlap one another in a text (no phrase's last word begins another).
    """
    phrases = phrases or PHRASES
    gap = f"[{_SEPARATORS}]++"
    forms = "|".join(gap.join(p.split()) for p in phrases)
    regex = f"(?<![^{_SEPARATORS}])(?:{forms})(?![^{_SEPARATORS}])"
    some = lowered.rlike(regex)
    pieces = F.split(lowered, regex, -1)
    places = F.regexp_extract_all(lowered, F.lit(regex), F.lit(0))
    label = F.create_map(*[F.lit(x) for p in phrases.items() for x in p])
    found = F.array_sort(F.array_distinct(F.transform(places, lambda p: F.element_at(label, F.regexp_replace(p, f"[{_SEPARATORS}]+", " ")))))
    return {
        "n_base": F.when(some, F.size(pieces).cast("long") - 1).otherwise(F.lit(0).cast("long")),
        "first_word": F.when(some, _count(F.element_at(pieces, 1))),
        "last_word": F.when(some, n_words - _count(F.element_at(pieces, -1)) - _count(F.element_at(places, -1))),
        "_base": F.when(some, found).otherwise(F.array().cast("array<string>")),
    }


def _template_words(text: str) -> list[str]:
    import re

    return re.findall(LICENSE_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(_template_words(text)))) for label, text in templates]


def _wrapped_matches(docs: DataFrame, table: DataFrame, first_words: Column) -> DataFrame:
    """``(rid, label, block, containment)`` of runs of words across lines, the best of each template; ``block`` is null.

    A run that matches holds one of the template's first words (prefix filter), so only runs
    of ``span`` words around these are looked at, and only where the words within reach suffice.
    """
    several = docs.where((F.instr("lowered", "\n") > 0) & F.arrays_overlap("own", first_words))
    some = several.join(F.broadcast(table), F.size(F.array_intersect("own", "texts")) >= F.col("need")).select("rid", "words", "label", "texts", "prefix", "need", "span")
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("prefix", w), i + 1)), lambda i: i.isNotNull())

    def held(start, length):
        return F.size(F.array_intersect(F.slice("words", start, length), F.col("texts")))

    def first(p):
        return F.greatest(F.lit(1), p - F.col("span") + 1)

    near = F.filter(places, lambda p: held(first(p), p - first(p) + F.col("span")) >= F.col("need"))
    best = F.array_max(F.transform(near, lambda p: F.array_max(F.transform(F.sequence(first(p), p), lambda i: held(i, F.col("span"))))))
    out = some.select("rid", "label", F.lit(None).cast("int").alias("block"), best.alias("n"), "need", F.size("texts").alias("all"))
    return out.where("n >= need").select("rid", "label", "block", (F.col("n") / F.col("all")).alias("containment"))


def _needs(templates: list[tuple[str, str]], threshold: float) -> list[int]:
    return [math.ceil(threshold * len(ws) - 1e-9) for _, ws in _template_sets(templates)]


def read_licenses(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, phrases: dict[str, str] | None = None) -> DataFrame:
    """``rid, doc_id, n_words, own, lowered`` of every row, from one pass over the texts; written.

    ``own`` are the distinct words of templates and phrases that the text has. ``lowered`` is
    kept where the text has all words of a phrase (``phrase``) or the share of a template's
    words that a block of it would need (``template``); no block of any other text can match.
    """
    sets = _template_sets(templates)
    phrases = phrases or PHRASES
    vocabulary = sorted({w for _, ws in sets for w in ws} | {w for p in phrases for w in p.split()})
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() may touch more than A-Z outside ASCII
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(_lower(text))
    lowered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", low.alias("lowered"))
    words = lowered.withColumn("words", license_words(F.col("lowered")))
    own = words.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _array(vocabulary)).alias("own"), "lowered")
    has = lambda ws, n: F.size(F.array_intersect("own", _array(ws))) >= n
    needs = _needs(templates, threshold)
    phrase, template = F.lit(False), F.lit(False)
    for p in phrases:
        phrase = phrase | has(p.split(), len(set(p.split())))
    for (_, ws), need in zip(sets, needs, strict=True):
        template = template | has(ws, need)
    own = own.withColumn("phrase", phrase).withColumn("template", (F.size("own") >= min(needs, default=1)) & template)
    return stash(own.withColumn("lowered", F.when(F.col("phrase") | F.col("template"), F.col("lowered"))))


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def template_matches(read: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """``(rid, label, block, containment)`` of every block and template that meet the threshold.

    ``read`` is the result of ``read_licenses``. A block is a line, or a run of words across
    lines, no longer than the template's number of words over the threshold; containment is
    the share of the template's distinct words that the block has. Words are ordered by the
    number of documents that have them, over all documents, rarest first. A template that
    needs o of its n words shares one of its first n - o + 1 with every block it matches
    (prefix filter), the block has o words at least (length filter), and from the first
    shared word on, template and block still have enough (positional filter). What passes is
    verified. The prefix index has at most as many rows as the templates have words, whatever
    the corpus, so it is broadcast.
    """
    templates = templates or TEMPLATES
    sets = _template_sets(templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    vocab = _array(vocabulary)
    counted = read.select(F.explode("own").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    frequency = {r["w"]: r["n"] for r in counted.collect()}  # at most the templates' and phrases' own words
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    needs = _needs(templates, threshold)
    index, shapes, spans = [], [], []
    for t, ((label, ws), need) in enumerate(zip(sets, needs, strict=True)):
        ranks = sorted(rank[w] for w in ws)
        shapes.append((t, label, ranks, need))
        index += [(r, t, i, need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        spans.append((label, ws, sorted(ws, key=rank.get)[: len(ws) - need + 1], need, math.ceil(len(_template_words(templates[t][1])) / threshold - 1e-9)))
    spark = read.sparkSession
    prefix = spark.createDataFrame(index, "rank int, template int, place int, need int")
    table = spark.createDataFrame(shapes, "template int, label string, ranks array<int>, need int")
    by_rank = sorted(rank, key=rank.get)
    first_words = _array([by_rank[r] for r in sorted({x[0] for x in index})])
    rank_of = F.create_map(*[F.lit(x) for w in by_rank for x in (w, rank[w])])
    docs = read.where("template").select("rid", "own", "lowered").withColumn("words", license_words(F.col("lowered")))
    lines = (
        docs.where(F.arrays_overlap("own", first_words))
        .select("rid", F.posexplode(F.split("lowered", "\n")).alias("block", "line"))
        .withColumn("own", F.array_intersect(license_words(F.col("line")), vocab))
        .where(F.size("own") >= min(needs))
        .select("rid", "block", F.array_sort(F.transform("own", lambda w: F.element_at(rank_of, w))).alias("own"))
    )
    met = lines.withColumn("rank", F.explode("own")).join(F.broadcast(prefix), "rank")
    first = met.groupBy("rid", "block", "template").agg(F.min("rank").alias("rank"), F.min("place").alias("place"), F.max("need").alias("need"), F.first("own").alias("own"))
    behind = F.size(F.filter("own", lambda r: r >= F.col("rank")))
    passed = first.where(behind >= F.col("need")).join(F.broadcast(table.drop("need")), "template")
    passed = passed.where(F.size("ranks") - F.col("place") >= F.col("need"))
    share = F.size(F.array_intersect("own", "ranks")) / F.size("ranks")
    whole = passed.withColumn("containment", share).where(F.col("containment") >= threshold - 1e-9).select("rid", "label", "block", "containment")
    runs = spark.createDataFrame(spans, "label string, texts array<string>, prefix array<string>, need int, span int")
    return whole.unionByName(_wrapped_matches(docs, runs, first_words))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``labels`` are the phrases' and the templates' together; ``score`` is 1 where a phrase
    stands, else the best containment that met the threshold, else 0. A null text counts as
    empty; null ids and rows that repeat are rows of their own; other columns are ignored.
    """
    templates = templates or TEMPLATES
    read = read_licenses(docs, templates, threshold)
    matched = template_matches(read, templates, threshold)
    found = matched.groupBy("rid").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    places = phrase_places(F.col("lowered"), F.col("n_words"))
    none = F.array().cast("array<string>")
    known = read.where("phrase or template").select("rid", "doc_id", "n_words", *[F.when(F.col("phrase"), c).alias(n) for n, c in places.items()]).join(found, "rid", "left").drop("rid")
    blank = {"n_base": "long", "first_word": "long", "last_word": "long", "_base": "array<string>", "_more": "array<string>", "_best": "double"}
    plain = read.where("not (phrase or template)").select("doc_id", "n_words", *[F.lit(None).cast(t).alias(n) for n, t in blank.items()])
    rows = plain.unionByName(known).withColumn("_base", F.coalesce("_base", none)).withColumn("n_base", F.coalesce("n_base", F.lit(0).cast("long")))
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_more", none))))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
