import math
import random

import pytest
from llm_helpers import words8
from pyspark.sql import functions as F
from support import SF, same_rows

from tesselar.llm import licenses


def brute(text, texts):
    w, found = words8(text), {}
    for name, t in texts:
        tw = words8(t)
        if not tw:
            continue
        c, s = min(16, len(tw)), min(5, len(tw))
        while c < len(tw):
            c = math.ceil(c * 1.25)
        grams = lambda x, s=s: {tuple(x[i : i + s]) for i in range(len(x) - s + 1)}
        wanted = grams(tw)
        for a in range(0, len(w), c):
            share = len(wanted & grams(w[a : a + 2 * c - 1])) / len(wanted)
            if share >= licenses.CONTAINMENT:
                found[name] = max(found.get(name, 0), share)
    return len(found), ",".join(sorted(found)), round(max(found.values(), default=0.0), 6)


LONG = licenses.TEMPLATES[1][1]
TEXTS = [
    "text all rights reserved", "pad " * 37 + LONG + " pad" * 90, " ".join(LONG.split()[:-9]), " ".join(LONG.split()[: len(LONG.split()) // 2]), "x " * 3 + "Released under the MIT License." + " y" * 5, "released UNDER the mit", None, "",
    "Licensed under the Apache License, Version 2.0 and Licensed under CC BY-NC 4.0.", LONG.replace("ANY KIND", "SOME SORT"), "reserved rights all", "w " * 4000 + "All rights reserved.",
]


def test_brute_force(spark):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_licenses"], r["licenses"], r["containment"]) for r in rows} == {i: brute(t, licenses.TEMPLATES) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("texts", [[], [("empty", "!!!")], [("a", "x"), ("b", "x"), ("c", "one two three four five six seven eight nine")]])
def test_templates(spark, texts):
    docs = ["x", "nothing", "zero one two three four five six seven eight nine ten", None]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), texts).collect()
    assert {r["doc_id"]: (r["n_licenses"], r["licenses"], r["containment"]) for r in rows} == {i: brute(t, texts) for i, t in enumerate(docs)}


def test_no_verbatim_notice_is_missed(spark):
    """Every template at every place of a text, among other words each time: the bands must find them all."""
    rng = random.Random(11)
    rows = []
    for i, (name, t) in enumerate(licenses.TEMPLATES):
        for k in range(1000):
            other = [f"w{rng.randrange(10**6)}" for _ in range(120 + k % 37)]
            at = k % 120
            rows.append((i * 1000 + k, name, " ".join([*other[:at], t, *other[at:]])))
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string").repartition(16)
    missed = licenses.scan(docs).join(docs.select("doc_id", "name"), "doc_id").where("not array_contains(split(licenses, ','), name) or containment < 1")
    assert missed.count() == 0


def test_least_similarity():
    """What the docstring says of the bands: no whole template is under 1/5 of its window."""
    least = min((n - min(5, n) + 1) / (2 * licenses.size_class(n) - min(5, n)) for n in range(1, 20000))
    assert least >= 1 / 5 and (1 - least) ** licenses.BANDS < 1e-6


def test_query(spark, duck):
    ours, theirs = same_rows(licenses.op7_licenses(spark, SF), duck, licenses.OP7_SQL)
    assert ours == theirs


def test_hard_rows(nasty, empty):
    assert licenses.scan(nasty.withColumn("v", F.lit(1)).withColumn("licenses", F.lit(1))).count() == nasty.count()
    assert licenses.scan(empty).count() == 0
