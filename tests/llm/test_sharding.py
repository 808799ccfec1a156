import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import SF

from tesselar.llm import sharding


@pytest.mark.parametrize("rows", [[5, 0, 7, 1], [100] * 9, [3], [1, 1, 1], [0]])
def test_matrix_sums(rows):
    m = sharding.matrix(rows, 4, 1)
    assert m.sum(axis=1).tolist() == rows and (m >= 0).all()
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_matrix_is_uniform():
    """The counts of one cell follow the hypergeometric law."""
    draws = Counter(int(sharding.matrix([4, 4], 2, seed)[0, 0]) for seed in range(4000))
    want = {0: 1 / 70, 1: 16 / 70, 2: 36 / 70, 3: 16 / 70, 4: 1 / 70}
    assert all(abs(draws[k] / 4000 - p) < 0.03 for k, p in want.items())


def test_large_draws(monkeypatch):
    rng = np.random.default_rng(0)
    a = [sharding.hypergeometric(rng, 3_000_000_000, 5_000_000_000, 1_000_000) for _ in range(200)]
    assert abs(np.mean(a) - 375_000) < 200 and 300 < np.std(a) < 700
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    small = Counter(sharding.hypergeometric(rng, 4, 4, 4) for _ in range(4000))
    assert abs(small[2] / 4000 - 36 / 70) < 0.03
    assert [sharding.hypergeometric(rng, g, b, n) for g, b, n in [(0, 5, 3), (5, 0, 3), (2, 3, 5), (2, 3, 0)]] == [0, 3, 2, 0]


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_query(spark, duck):
    rows = sharding.op3_shards(spark, SF).collect()
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items()}
    check(rows, 8)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_uniform_over_shards(spark):
    """Neighbours don't stay together, and both halves of the input reach all shards alike."""
    rows = sharding.shuffle(spark.range(0, 4000, 1, 5), 4, seed=3).collect()
    check(rows, 4)
    low = Counter(r["shard"] for r in rows if r["id"] < 2000)
    assert all(abs(n - 500) < 90 for n in low.values())
    slots = [r["slot"] for r in sorted(rows, key=lambda r: r["id"])]
    assert abs(np.corrcoef(slots, np.arange(4000))[0, 1]) < 0.06
    again = sharding.shuffle(spark.range(0, 4000, 1, 5), 4, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_hard_rows(nasty, empty):
    rows = sharding.shuffle(nasty.withColumn("SLOT", F.lit("x")), 3).collect()
    assert len(rows) == nasty.count()
    check(rows, 3)
    assert sharding.shuffle(empty, 8).count() == 0
    check(sharding.shuffle(nasty, 100).collect(), 100)


def test_internal_names_of_the_operator(spark):
    """Columns of the input keep their values, whatever they are called."""
    names = ["_place", "_cell", "_random", "_nth", "_first", "row", "rid"]
    df = spark.createDataFrame([(i, *[i * 10 + k for k in range(len(names))], "z") for i in range(40)], ["doc_id", *names, "SLOT"]).repartition(3)
    out = sharding.shuffle(df)
    assert out.columns == ["doc_id", *names, "shard", "slot"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(40)) and all(r[n] == r["doc_id"] * 10 + k for r in rows for k, n in enumerate(names))
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(8) for k in range(5)]
