import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from support import SF

from tesselar.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), bpe.code_point_classes())


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


def test_random_texts(codec, reference):
    rng = random.Random(1)
    alphabet = "ab Zé'strevlmdLS  \n\t\r　 12٣!?.,'\x00中😀\x1c\x85́ÅǅĿ؅"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        assert ids(raw) == reference.encode_ordinary(text), repr(text)
        assert codec.decode(raw, codec.offsets(raw)) == text.encode()


def test_long_pieces(codec, reference):
    for text in ("a" * 5000, "abc" * 3000 + " " * 300 + "é" * 999, "\n" * 1000, "!'" * 700):
        raw = codec.encode([text])[0]
        assert ids(raw) == reference.encode_ordinary(text) and codec.decode(raw, codec.offsets(raw)) == text.encode()


def test_scan_is_the_automaton():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, bpe.NOTHING, 5000).astype(np.uint8)
    state, want = bpe.START, []
    for s in symbols:
        want.append(state)
        state, _ = bpe.step(state, int(s))
    assert bpe.states_before(symbols).tolist() == want


def test_cache_limit_changes_nothing(codec, monkeypatch):
    texts = ["one two three four five", "", "six'll seven\n\n eight"]
    want = codec.encode(texts)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 3)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 10)
    with open(PATH, "rb") as f:
        assert bpe.Codec(f.read(), bpe.code_point_classes()).encode(texts) == want


@pytest.mark.parametrize("chars", [1, 2, 3, 7])
def test_texts_longer_than_a_chunk(codec, reference, monkeypatch, chars):
    """The state, the piece that goes on and what is read ahead are carried over."""
    monkeypatch.setattr(bpe, "CHUNK_CHARS", chars)
    rng = random.Random(2)
    alphabet = "ab Zé'strevlmd  \n\t　 12!中😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(chars, 60))) for _ in range(1500)]
    texts += ["we'll they're 'tis x's", "a" * 50, " " * 9 + "x", "it've  \n 's'"]
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        assert ids(raw) == reference.encode_ordinary(text), repr(text)
        assert codec.decode(raw, codec.offsets(raw)) == text.encode()


def test_fused_decoding_is_decoding(nasty):
    apart = bpe.decode(bpe.encode(nasty, PATH, drop=True), PATH)
    fused = bpe.encode(nasty, PATH, decoded=True, drop=True)
    assert sorted(map(repr, fused.collect())) == sorted(map(repr, apart.collect())) and fused.columns == apart.columns


def test_query(spark, duck, reference):
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = bpe.op1_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = reference.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_hard_rows(nasty, empty, reference):
    from pyspark.sql import functions as F

    out = bpe.decode(bpe.encode(nasty.withColumn("IDS", F.lit(1)).withColumn("n_tokens", F.lit("x")), PATH), PATH)
    rows = out.collect()
    assert len(rows) == nasty.count()
    for r in rows:
        assert ids(r["ids"]) == reference.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0
