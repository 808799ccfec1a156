import hashlib

import pytest
from support import SF, same_rows
from pyspark.sql import functions as F

from tesselar.llm import decontaminate
from llm_helpers import words8


def brute(docs, items, min_items=2):
    grams = {}
    for item, text in items:
        w = words8(text)
        for i in range(max(1, len(w) - 7)) if w else []:
            grams.setdefault(tuple(w[i : i + 8]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, met = words8(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    met |= {str(x) for x in grams[g] if x is not None}
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(met) >= min_items))
    return out


PASSAGE = "one Two three, four five six seven eight nine ten"
DOCS = [(0, f"x {PASSAGE} y"), (1, PASSAGE.upper() + " " + PASSAGE), (2, "two three four five six seven eight nine É1 short item"), (3, None), (4, ""), (5, "É1 SHORT item"), (6, "é1 short item"), (7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, PASSAGE), (8, "a " * 5000 + PASSAGE)]
ITEMS = [(10, PASSAGE), (2, "three four five six seven eight nine ten eleven"), (3, "É1 short item"), (4, None), (5, "!!!"), (None, "x one"), (10, "again one item"), (9, "a a a a a a a a")]


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("limit", [200_000, 0])
def test_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", limit)
    docs, items = tables(spark)
    rows = decontaminate.scan(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, brute(DOCS, ITEMS)))


def test_query(spark, duck):
    ours, theirs = same_rows(decontaminate.op10_decontaminate(spark, SF), duck, decontaminate.OP10_SQL)
    assert ours == theirs


def test_removal(spark):
    docs, items = tables(spark)
    wide = docs.withColumn("key", F.lit("k")).withColumn("spans", F.lit(1))
    left = decontaminate.remove_documents(wide, items, min_items=1)
    clean = [r for r, b in zip(DOCS, brute(DOCS, ITEMS, 1), strict=True) if not b[5]]
    assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in left.collect()])) == sorted(map(repr, clean)) and left.columns == wide.columns
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[0] == "y" and cut[2] == ""
    assert cut[6] == "é1 short item" and cut[3] is None


def test_hard_rows(spark, nasty, empty):
    _, items = tables(spark)
    none = items.limit(0)
    assert decontaminate.scan(nasty, items).count() == nasty.count() and decontaminate.scan(nasty, none).where("n_items > 0").count() == 0
    assert decontaminate.scan(empty, items).count() == 0 and decontaminate.remove_documents(empty, items).count() == 0
    assert decontaminate.remove_documents(nasty, none).count() == nasty.count()
