"""License scans by MinHash bands over text windows, by DataFrame functions only.

Templates and texts are words; five words make a shingle (fewer words: all of them). Windows of a text overlap and have
about twice the words of a template's size class c: 2c - 1, from every c-th word on, so every passage of c words lies
in one whole. Up to EXACT words a class is the template's own length, above it classes grow by a quarter. A window and a
template of its class collide if in one of BANDS bands (of one row) their MinHash agrees. A template that lies in a
window whole has a Jaccard similarity of (n - 4) / (2c - 5) or more to it, at least 1/5 (of 5 words, one shingle against
the window's five), and so is missed with a probability of (4/5)^BANDS = 6e-7 at most. Collisions are verified by exact
containment: the share of the template's shingles in the window.

Only a window that holds a template's minimal shingle can collide with it, so texts are first tested for the templates'
shingles by Bloom filters of bounded size (one of all, one for each class), and MinHashes are taken where one occurs.

Null texts have no words. Texts without a license get a row with no licenses. Repeated rows each get a row. Templates
of no words are never found; templates with equal words are all found. Other columns don't matter. Very long texts are
scanned whole; their words and the words' hashes are held as arrays in memory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import common
from tesselar.llm.decontaminate import hash_of, run_hash, runs_in, word_hashes, words_of

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 64
EXACT, GROWTH = 16, 1.25  # size classes
BROADCAST_ROWS = 200_000

#: License notices, in the words of their publishers but for what they set in brackets or leave to fill in.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("reserved", "All rights reserved"),
]


def size_class(n_words: int) -> int:
    """The least class that is no less: all numbers to EXACT, then each over the last by GROWTH."""
    c = n_words if n_words <= EXACT else EXACT
    while c < n_words:
        c = math.ceil(c * GROWTH)
    return c


def shingles(w: Column, s: Column) -> Column:
    """The distinct runs of s words in an array of s words at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.array_join(F.slice(w, i + 1, s), " ")))


def minhashes(texts: Column) -> Column:
    """The least hash of an array of texts in each band's order."""
    hashes = F.transform(texts, lambda x: F.xxhash64(x))
    return F.transform(F.array(hashes), lambda hs: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(hs, lambda h: F.xxhash64(h, b)))))[0]


def templates(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """template (its number), license, c (size class), s (words in a shingle), shingles, signature."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "template int, license string, text string")
    rows = common.cut(rows.select("template", "license", words_of(F.col("text")).alias("w")).where("size(w) > 0"))
    lengths = sorted(r[0] for r in rows.select(F.size("w")).distinct().collect())
    classes = F.coalesce(*[F.when(F.size("w") == n, F.lit(size_class(n))) for n in lengths]) if lengths else F.lit(0)
    rows = rows.select("template", "license", classes.alias("c"), F.least(F.size("w"), F.lit(SHINGLE)).alias("s"), "w")
    return common.cut(rows.select("template", "license", "c", "s", shingles(F.col("w"), F.col("s")).alias("shingles")).withColumn("signature", minhashes(F.col("shingles"))))


WINDOW_TYPE = "array<struct<c:int,s:int,start:int,w:array<string>>>"


def _windows(w: Column, blooms: dict[tuple[int, int], common.Bloom], bloom: common.Bloom) -> Column:
    """The windows of an array of words, for each (c, s), that hold a shingle of a template of that kind.

    Words are hashed once; places with any template's shingle are found once, and then asked for each kind.
    """

    def of(hashes: Column, places: Column, c: int, s: int) -> Column:
        return _around(w, F.filter(places, lambda i: blooms[c, s].has(run_hash(hashes, i, s))), c, s)

    def at(hashes: Column, s: int) -> Column:
        found = lambda places: F.concat(*[of(hashes, places, c, t) for c, t in sorted(blooms) if t == s])
        return F.transform(F.array(runs_in(hashes, s, bloom)), lambda places: F.when(F.size(places) > 0, found(places)).otherwise(F.array().cast(WINDOW_TYPE)))[0]

    return F.transform(F.array(word_hashes(w)), lambda hashes: F.concat(*[at(hashes, s) for s in sorted({s for _, s in blooms})]))[0]


def _around(w: Column, places: Column, c: int, s: int) -> Column:
    """The windows of 2c - 1 words that hold a shingle at one of the places: they start at the multiple of c below it, and at that before."""
    at = F.flatten(F.transform(places, lambda i: F.array((F.floor(i / c) * c).cast("int"), F.greatest(F.floor(i / c) * c - c, F.lit(0)).cast("int"))))
    return F.transform(F.array_distinct(at), lambda a: F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"), a.alias("start"), F.slice(w, a + 1, 2 * c - 1).alias("w")))


def scan(df: DataFrame, texts: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df: doc_id, n_licenses (long), licenses (names, sorted, comma-joined), containment (the greatest; 0 if none)."""
    known = templates(df.sparkSession, texts)
    runs = common.cut(known.select("c", "s", F.explode("shingles").alias("x")).distinct())
    kinds = sorted(map(tuple, runs.groupBy("c", "s").agg(F.count("*").alias("n")).collect()))  # a few dozen classes, and 1 to SHINGLE
    found = F.array().cast(WINDOW_TYPE)
    if kinds:
        hashed = common.cut(runs.select("c", "s", hash_of(F.split("x", " "), sorted({s for _, s, _ in kinds})).alias("h")))
        blooms = {(c, s): common.Bloom(hashed.where((F.col("c") == c) & (F.col("s") == s)).select("h"), n) for c, s, n in kinds}
        bloom = common.Bloom(hashed.select("h"), runs.count())
        found = F.transform(F.array(words_of(F.col("text"))), lambda w: _windows(w, blooms, bloom))[0]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", found.alias("v"))
    rows = common.stash(rows, "license-windows")
    wide = rows.where("size(v) > 0").select("rid", F.explode("v").alias("v")).select("rid", "v.*").where("size(w) >= s").withColumn("shingles", shingles(F.col("w"), F.col("s"))).drop("w")
    wide = common.stash(wide, "license-shingles")
    small = known.count() <= BROADCAST_ROWS // BANDS
    bands = known.select("template", "c", "s", F.posexplode("signature").alias("band", "m"))
    signed = wide.select("rid", "c", "s", "start", F.posexplode(minhashes(F.col("shingles"))).alias("band", "m"))
    met = signed.join(F.broadcast(bands) if small else bands, ["c", "s", "band", "m"]).select("rid", "c", "s", "start", "template").distinct()
    texts_of = known.select("template", "license", F.col("shingles").alias("wanted"))
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    judged = met.join(wide.select("rid", "c", "s", "start", "shingles"), ["rid", "c", "s", "start"]).join(F.broadcast(texts_of) if small else texts_of, "template").select("rid", "license", share.alias("share")).where(F.col("share") >= CONTAINMENT)
    verdict = judged.groupBy("rid").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.round(F.max("share"), 6).alias("containment"), F.count_distinct("license").alias("n_licenses"))
    return rows.select("rid", "doc_id").join(verdict, "rid", "left").select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses, containment of every document."""
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    """Exact containment in every window: banding misses none but with a probability under 1e-6."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
    classes = "CASE " + " ".join(f"WHEN len(w) <= {c} THEN {c}" for c in sorted({size_class(n) for n in range(1, 129)})) + " END"
    words = r"list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    runs = "list_distinct([array_to_string({0}[i:i + s - 1], ' ') for i in range(1, len({0}) - s + 2)])"
    return f"""
WITH t0 AS (SELECT n, license, {words.format("t")} AS w FROM (VALUES {quoted}) AS v(n, license, t)),
t1 AS (SELECT n, license, w, {classes} AS c, least(len(w), {SHINGLE})::INT AS s FROM t0),
t AS (SELECT n, license, c, s, {runs.format("w")} AS wanted FROM t1),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT DISTINCT c, s FROM t),
v0 AS (SELECT doc_id, c, s, w, unnest(range(0, len(w), c)) AS a FROM d, k),
v1 AS (SELECT doc_id, c, s, w[a + 1:a + 2 * c - 1] AS w FROM v0),
v AS (SELECT doc_id, c, s, {runs.format("w")} AS have FROM v1 WHERE len(w) >= s),
j AS (SELECT doc_id, license, len(list_intersect(wanted, have)) / len(wanted) AS share FROM v JOIN t USING (c, s)),
r AS (SELECT doc_id, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, round(max(share), 6) AS containment FROM j WHERE share >= {CONTAINMENT} GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(containment, 0)::DOUBLE AS containment FROM d LEFT JOIN r USING (doc_id)
"""


OP7_SQL = _sql()
