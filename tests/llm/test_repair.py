import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from support import SF
from tokenizers import Tokenizer

from tesselar.llm import repair

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder(library):
    with open(PATH, encoding="utf-8") as f:
        e = repair.Encoder(f.read())
    rng = random.Random(2)
    alphabet = "ab Zé'strevlmd  \n\t\r　12٣!?.,'\x00中😀\x1c\x85́Åǅ;-_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext| >"] + [f"left {t} right" for t in e.added]
    texts += ["", "word. word, word's <|endoftext|> don't it's.", " lead", "trail ", "x" * 500 + " " + "y" * 500 + "..."]
    for text, raw in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return repair.Encoder(f.read())


def test_parts_go_to_the_library_once(encoder, library):
    """Whatever stands between two words, the library gets each at most once after a space and once after a line feed."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", ". ", ".\n", ",", "...\n\n"]) for _ in range(300)) + "x" for _ in range(40)]
    sent = []

    class Listening:
        def encode_batch_fast(self, parts, **more):
            sent.extend(parts)
            return library.encode_batch_fast(parts, **more)

    encoder.tokenizer = Listening()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == want
    assert sum(map(len, sent)) < 4 * sum(len(w) + 1 for w in words)
    sent.clear()
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == want
    assert not any(sent)


def test_line_feeds_marks_and_small_caches(encoder, library, monkeypatch):
    monkeypatch.setattr(repair, "CACHE_PARTS", 50)
    monkeypatch.setattr(repair, "CACHED_BYTES", 6)
    monkeypatch.setattr(repair, "JOINED", 3)
    rng = random.Random(6)
    texts = ["", "\n", "\n\n", "\n\n\na", "a\n\n\n", "a\n\n\n\n.b", "é.", "×.", "÷.", "x's.", "x.'s", "a" * 50]
    texts += ["".join(rng.choice("abé×\n\n.,'s 1") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for k in range(0, len(texts), 40):
        for text, raw in zip(texts[k : k + 40], encoder.encode(texts[k : k + 40]), strict=True):
            assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder.older) > 50 and max(map(len, encoder.older)) <= 6


@pytest.mark.parametrize("n,high", [(0, 5), (1, 5), (2, 1), (5000, 3), (50_000, 40), (3000, 50_000)])
def test_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    if n == 50_000:
        ids[10_000:30_000] = np.tile(ids[:100], 200)
    seq, rules, lengths = repair.compress(ids, 50_257)
    assert np.array_equal(repair.expand(seq, rules, lengths, 50_257), ids)
    for _ in range(30):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(repair.expand(seq, rules, lengths, 50_257, a, b), ids[a:b])
    if n == 50_000:
        assert len(seq) + 3 * len(rules) < 0.75 * n


@pytest.mark.parametrize("bits", [4, 18])
def test_no_frequent_pair_stays(monkeypatch, bits):
    """Also where pairs hide behind others of their hash."""
    monkeypatch.setattr(repair, "HASH_BITS", bits)
    monkeypatch.setattr(repair, "MOST_RULES", 5)
    rng = np.random.default_rng(bits)
    ids = np.concatenate([np.tile(rng.integers(0, 9, 30), 40), rng.integers(0, 12, 3000), np.zeros(700)]).astype(np.uint32)
    seq, rules, lengths = repair.compress(ids, 100)
    _, counts = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
    assert counts.max() < repair.LEAST_COUNT and len(rules) > 5
    assert np.array_equal(repair.expand(seq, rules, lengths, 100), ids)


def test_later_rounds_look_at_what_changed(monkeypatch):
    rng = np.random.default_rng(4)
    ids = (rng.zipf(1.3, 200_000) % 5000).astype(np.uint32)
    looked, find = [], repair._frequent
    monkeypatch.setattr(repair, "_frequent", lambda a, *more: (looked.append(len(a)), find(a, *more))[1])
    seq, rules, lengths = repair.compress(ids, 5000)
    assert len(looked) > 3 and sum(looked) < 2 * len(ids)
    assert np.array_equal(repair.expand(seq, rules, lengths, 5000), ids)


def test_query(spark, duck, library, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_IDS", 5000)
    docs = duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.op5_token_files(spark, SF).collect()}
    start = 0
    for d, t in docs:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, repair.END], dtype="<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_special_strings_and_equal_ids(spark, library):
    """Added tokens' strings as the library has them; many rows without an id, in any number of parts."""
    texts = ["x <|endoftext|> y", None, "plain text"] + [f"nameless {i}" for i in range(300)]
    df = spark.createDataFrame([(5, texts[0]), (1, texts[1]), (5, texts[2])] + [(None, t) for t in texts[3:]], "doc_id long, text string").repartition(7)
    rows = sorted(repair.read(repair.write(df, PATH)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 300 + [1, 5, 5]
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts)
    assert sorted(np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows) == want
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_hard_rows(nasty, empty, library):
    rows = repair.read(repair.write(nasty, PATH)).collect()
    assert len(rows) == nasty.count()
    want = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in nasty.collect())
    assert sorted(np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows) == want
    ends = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0
    assert repair.read(repair.write(empty, PATH)).count() == 0
