import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_helpers import words8
from pyspark.sql import functions as F
from support import SF
from test_nearcopies import brute_keep
from test_secrets import brute_spans

from tesselar.llm import bpe, common, decontaminate, quality, secrets, simhash


def brute(docs, items):
    """Every stage by hand: id to (redacted text, ids)."""
    docs = {d: t for d, t in docs.items() if quality.verdict(quality.measure(t or ""))[1]}
    kept = brute_keep(docs)
    docs = {d: docs[d] for d in sorted(kept)}
    grams = {tuple(w[i : i + 8]) for t in items for w in [words8(t)] for i in range(max(1, len(w) - 7)) if w}
    sizes = {len(g) for g in grams}
    docs = {d: t for d, t in docs.items() if not any(tuple(w[i : i + n]) in grams for w in [words8(t)] for n in sizes for i in range(len(w) - n + 1))}
    for d, t in docs.items():
        out, at = "", 0
        for a, _, b, _ in brute_spans(t):
            if a >= at:
                out += t[at:a] + secrets.PLACEHOLDER
            at = max(at, b)
        docs[d] = out + t[at:]
    return docs


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), bpe.code_point_classes())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_run(spark, duck, encoding):
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    want = brute(docs, [t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()])
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == set(want) and 0 < len(want) < len(docs)
    for d, text in want.items():
        assert bytes(rows[d]["decoded"]).decode() == text
        assert np.frombuffer(rows[d]["ids"], dtype="<u4").tolist() == encoding.encode_ordinary(text)
        assert rows[d]["n_tokens"] == len(rows[d]["ids"]) // 4
    assert not any(re.search(r"AKIA[A-Z0-9]{12}", t) for t in want.values())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_hard_rows(spark, nasty, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    wide = nasty.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["fp", "KEPT", "ids_", "key", "spans", "offsets", "component_id", "_key", "row", "rid", "tie", "first", "kinds", "fresh", "_spans", "_kept", "node", "n_tokens", "decoded", "words", "t", "k"])])
    out = stage(spark, wide, SF)
    assert out.count() <= wide.count()
    if k < 4:
        assert out.columns == wide.columns
    assert stage(spark, empty, SF).count() == 0


def test_one_half_of_the_key_is_not_the_row(spark, monkeypatch):
    """Rows whose first 64 bits of hash are equal by chance stay apart."""
    whole = common.row_key
    monkeypatch.setattr(common, "row_key", lambda *cols: F.struct(F.lit(0).cast("long").alias("a"), whole(*cols)["b"].alias("b")))
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "nothing of it"), (None, "nothing of it"), (None, None), (2, 'token="abcdefgh12345678"')], "doc_id long, text string")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    assert sorted(r["text"] or "" for r in decontaminate.remove_documents(docs, items, min_items=1).collect()) == sorted(["nothing of it", "nothing of it", "", 'token="abcdefgh12345678"'])
    assert sorted(r["text"] or "" for r in decontaminate.remove_spans(docs, items).collect()) == sorted(["x y", "nothing of it", "nothing of it", "", 'token="abcdefgh12345678"'])
    assert sorted(r["text"] or "" for r in secrets.redact(docs).collect()) == sorted([f"x {item} y", "nothing of it", "nothing of it", "", secrets.PLACEHOLDER + '"'])
    assert simhash.keep_first(docs).count() == 4


def test_scratch_is_shared_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("conf", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("sc", (), {"_jsc": type("jsc", (), {"isLocal": staticmethod(lambda: False)})})

    with pytest.raises(ValueError):
        common.scratch(Cluster)
