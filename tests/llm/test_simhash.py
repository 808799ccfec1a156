import re

import numpy as np
import pytest
import xxhash
from support import SF
from pyspark.sql import functions as F

from tesselar.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """Component ids of (id, fingerprint) by all pairs."""
    n = len(rows)
    label = list(range(n))
    fps = np.array([f for _, f in rows], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(n)]
        if new == label:
            break
        label = new
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids[label[i]] = min((x for x in (ids.get(label[i]), d) if x is not None), default=None)
    return [ids[x] for x in label]


def test_fingerprints(duck, nasty):
    for (t,) in duck.execute("SELECT text FROM documents LIMIT 60").fetchall() + [(r["text"],) for r in nasty.collect()]:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_bit_slices(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base[rng.integers(0, 40, 700)] ^ (np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)) ^ np.where(rng.random(700) < 0.5, np.uint64(7 << 20), np.uint64(0)), base])
    groups = np.sort(rng.integers(0, 9, len(fps)))
    a, b = (np.concatenate(x) for x in zip(*simhash.close(fps, groups), strict=True))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if groups[i] == groups[j] and int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


@pytest.mark.parametrize("n", [1, 1000, 10**7, 10**10])
def test_scheme_misses_no_link(n):
    blocks, choose = simhash.scheme(n)
    assert blocks - choose == simhash.RADIUS  # so many blocks can differ at most


def clusters(seed=5, n=500):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(12):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(n // 12):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):  # chains that drift
                x ^= 1 << int(b)
    return out + [0, 1, 3, (1 << 64) - 1]


@pytest.mark.parametrize("hot", [2048, 8])
def test_links_connect_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PART", max(2, hot // 2))
    fps = list(dict.fromkeys(clusters()))
    df = spark.createDataFrame([(int(np.array(f, dtype=np.uint64).view(np.int64)),) for f in fps], "fp long")
    links = simhash.linked(df).collect()
    want = brute_components(list(enumerate(fps)))
    index = {int(np.array(f, dtype=np.uint64).view(np.int64)): i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        moved = False
        for r in links:
            i, j = index[r["u"]], index[r["v"]]
            m = min(label[i], label[j])
            moved |= label[i] != m or label[j] != m
            label[i] = label[j] = m
        if not moved:
            break
    assert label == want


def test_query(spark, duck):
    rows = simhash.op8_simhash(spark, SF).collect()
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    pairs = [(d, brute_fingerprint(docs[d])) for d in sorted(docs)]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(pairs, brute_components(pairs), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


def test_hard_rows(nasty, empty):
    rows = simhash.near_duplicates(nasty).collect()
    assert len(rows) == nasty.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}
    kept = simhash.keep_first(nasty.withColumn("fp", F.lit("x")).withColumn("component_id", F.lit("y")))
    assert kept.count() == len({r["component_id"] for r in rows}) and "component_id" in kept.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0
