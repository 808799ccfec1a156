import hashlib
import re

import pytest
from support import SF, same_rows
from pyspark.sql import functions as F

from tesselar.llm import secrets

BASE = {"assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}
TEXTS = [
    'Password: "hunter2hunter2" and api_key=AAAAbbbb1234 APIKEY = x.y-z+/=12345 token=short', "token=token: abcdefghij", "tokentoken==abcdefgh=", "é😀 secret='äbc' secret:abcdefgh", "AKIAABCDEFGHIJKL AKIAAKIAABCDEFGH AKIAx", "0" * 31 + " " + "a1" * 16 + "g" + "f" * 40,
    "passwd = 'deadbeefdeadbeefdeadbeefdeadbeef'", "-----BEGIN RSA PRIVATE KEY----- x", "ghp_" + "a1B2" * 9, "xoxb-123456789012-abc", "AIza" + "x" * 35, "sk_live_" + "a" * 20, "eyJhbGciOiJ.eyJzdWIiOiIx.SflKxwRJSM", "İ token = abcdefgh12 K",
]


def base_spans(text):
    out, counts = [], []
    for k, (kind, (rx, group, least)) in enumerate(BASE.items()):
        found = [(m.start(), k, m.end(), kind) for m in rx.finditer(text or "") if len(m.group(group)) >= least]
        out += found
        counts.append(len(found))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)), counts


def brute_spans(text):
    out = []
    for k, rule in enumerate(secrets.RULES):
        out += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def check(rows, docs):
    for r in rows:
        said, counts = base_spans(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in brute_spans(docs[r["doc_id"]]))


def test_texts(spark):
    check(secrets.scan(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect(), dict(enumerate(TEXTS)))


def test_query(spark, duck):
    rows = secrets.op9_secrets(spark, SF).collect()
    docs = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == len(docs)
    check(rows, docs)
    ours, theirs = same_rows(secrets.op9_secrets(spark, SF), duck, secrets.OP9_SQL)
    assert ours == theirs


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_index_finds_all(rule):
    clauses = secrets.trigram_query(rule.pattern)
    for text in TEXTS:
        if re.search(rule.pattern, text):
            assert any(all(t in text.lower() for t in c) for c in clauses)
    assert (frozenset() in clauses) == (rule.kind == "hex")


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abc") == [frozenset({"abc"})] and q("ab") == [frozenset()] and q("(abc|x)d*") == [frozenset()]
    assert q("abcd|wxyz") == [frozenset({"abc", "bcd"}), frozenset({"wxy", "xyz"})]
    assert q("(?i:Key)[0-9]+Val") == [frozenset({"key", "val"})]
    assert q("(abc)+") == [frozenset({"abc"})] and q("(abc)*") == [frozenset()]


def test_redact(spark, nasty, empty):
    docs = spark.createDataFrame([(i, t, len(t), "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_chars long, _spans string")
    for r in secrets.redact(docs.drop("_spans"), length="n_chars").collect():
        text, out, at = TEXTS[r["doc_id"]], "", 0
        for a, _, b, _ in brute_spans(text):
            if a >= at:
                out += text[at:a] + secrets.PLACEHOLDER
            at = max(at, b)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
    got = secrets.redact(nasty, length="n_chars")
    assert got.columns == nasty.columns and got.count() == nasty.count()
    assert secrets.scan(nasty.withColumn("spans", F.lit(1))).count() == nasty.count()
    assert secrets.redact(empty).count() == 0 and secrets.scan(empty).count() == 0


BODY = ["MIIEowIBAAKCAQEA" + "aB3+/x9Z" * 6, "Qx7" + "kL0pT4mN" * 7 + "abcde", "zZ81kfQ+/abc9w=="]
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,5F0A\n\n"


def key(name="RSA PRIVATE KEY", end=True, sep="\n", headers=""):
    return f"-----BEGIN {name}-----{sep}{headers}" + sep.join(BODY) + (f"{sep}-----END {name}-----" if end else "")


@pytest.mark.parametrize(
    "block",
    [key(), key("PRIVATE KEY", sep="\r\n"), key("PGP PRIVATE KEY BLOCK", headers="Version: x-1.0\n\n"), key(headers=HEADERS), key(sep="\\n"), key(sep="\n    "), key(sep=" ")]
    + [key(end=False), key("PGP PRIVATE KEY BLOCK", end=False), key(end=False, headers=HEADERS), key(end=False, sep="\\n"), key(end=False, sep="\n    "), key(end=False) + "\n" + "\n".join(["Ab3/" * 16] * 3000)],
)
def test_no_line_of_a_private_key_stays(spark, block):
    docs = [(0, f"before {block}\nafter it, more"), (1, f"one {key(end=False)}\nkept between, x\n{block}\nthe end.")]
    for r in secrets.redact(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert not any(b in r["text"] for b in BODY) and "Ab3/" not in r["text"] and "BEGIN" not in r["text"]
        assert r["text"].startswith("before " if r["doc_id"] == 0 else "one ") and r["text"].endswith("after it, more" if r["doc_id"] == 0 else "the end.")
        assert r["doc_id"] == 0 or "kept between, x" in r["text"]
