import corpus_pipeline
import numpy as np
import pytest

from tesselar.llm import nearcopies, simhash

DOCS = "doc_id long, text string"


def brute_sets(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_keep(docs):
    """The least id of each component of pairs with a Jaccard similarity of 4/5 or more."""
    sets = {d: brute_sets(t) for d, t in docs.items()}
    root = {d: d for d in docs}
    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def planted(n=12, copies=4, words=300):
    """Texts, and copies of each with 2 per cent of the words replaced."""
    rng = np.random.default_rng(7)
    docs = {}
    for i in range(n):
        own = [f"w{x}" for x in rng.integers(0, 5000, words)]
        docs[i * 100] = " ".join(own)
        for k in range(1, copies):
            new = list(own)
            for at in rng.choice(words, words // 50, replace=False):
                new[at] = f"new{rng.integers(0, 10**9)}"
            docs[i * 100 + k] = " ".join(new)
    return docs


def test_planted_edits(spark):
    docs = planted()
    far = [bin(simhash.fingerprint(docs[d]) ^ simhash.fingerprint(docs[d - d % 100])).count("1") for d in docs if d % 100]
    assert max(far) > simhash.RADIUS  # op8's radius can't see them all
    want = brute_keep(docs)
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(list(docs.items()), DOCS), "")
    assert {r["doc_id"] for r in got.collect()} == want and len(want) < len(docs) // 2


@pytest.mark.parametrize("hot", [2048, 3])
def test_chains(spark, monkeypatch, hot):
    """Texts that move on a few words at a time: most are linked through others only, some not at all."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "PART", max(2, hot // 2))
    words = [f"c{k}" for k in range(400)]
    docs = {i: " ".join(words[i * 6 : i * 6 + 60]) for i in range(8)} | {50 + i: " ".join(words[i * 12 + 150 : i * 12 + 210]) for i in range(6)}
    docs |= {90: "", 91: "  ", 92: "Few words", 93: "few  WORDS", 94: "few words more"}
    got = nearcopies.keep_first(spark.createDataFrame(list(docs.items()), DOCS))
    assert {r["doc_id"] for r in got.collect()} == brute_keep(docs) | {90}


def test_group_around_a_middle(spark, monkeypatch):
    """Copies that are alike to one text in their middle, and hardly to each other; and some that are alike to none."""
    rng = np.random.default_rng(3)
    base = [f"b{x}" for x in rng.integers(0, 9000, 200)]
    docs = {500: " ".join(base)}
    for k in range(60):
        new = list(base)
        for at in rng.choice(200, 4 if k % 3 else 9, replace=False):
            new[at] = f"n{k}x{at}"
        docs[k] = " ".join(new)
    monkeypatch.setattr(nearcopies, "COMPARE_ROWS", 16)
    want = brute_keep(docs)
    got = nearcopies.keep_first(spark.createDataFrame(list(docs.items()), DOCS))
    assert {r["doc_id"] for r in got.collect()} == want and 1 < len(want) < 30


def test_ties_and_repeats(spark):
    """One id and text with different other columns: one row stays, the same one in any order of the rows; and of equal rows one."""
    rows = [(1, "a b c d e f g", x) for x in ("p", "q", "q", "r")] + [(None, "a b c d e f g", "s"), (2, "x", None), (2, "x", None)]
    kept = {tuple(sorted(map(repr, nearcopies.keep_first(spark.createDataFrame(r, "doc_id long, text string, row string")).collect()))) for r in (rows, rows[::-1])}
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_hard_rows(spark, nasty, empty):
    assert nearcopies.near_copies(nasty).count() == nasty.count()
    assert nearcopies.keep_first(nasty).columns == nasty.columns and nearcopies.keep_first(empty).count() == 0
