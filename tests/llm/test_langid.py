import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.llm import common, langid

HELD = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(common.documents(spark, HELD).where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, model):
    rest = common.documents(spark, HELD).where("doc_id % 2 = 1")
    rows = langid.with_likelihood(langid.documents_rows(rest), model)
    got = langid.fuse(rows, model[0]).join(rest.select("doc_id", F.col("lang").alias("truth")), "doc_id").agg(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert got >= 0.97


def test_query(spark):
    df = langid.op6_language(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    pages = [r for r in rows if r["page_id"] is not None]
    assert len(pages) == 50 and len(rows) == 250 and all(0 < r["confidence"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["declared"] for r in pages]) > 0.95


def fused(spark, model, rows):
    df = spark.createDataFrame(rows, "id long, declared string, host string, domain string, suffix string, ll array<double>")
    return {r["id"]: r for r in langid.fuse(df, model).collect()}


def test_evidence_is_bayesian(spark):
    """The posterior by hand, for a table of one host."""
    rows = [(i, "", "h", "d", "s", [2.0, 0.0] if i < 6 else [0.0, 2.0]) for i in range(8)]
    got = fused(spark, ["x", "y"], rows)
    counts, root = np.array([6.0, 2.0]), np.array([6.5, 2.5]) / 9
    own = np.array([1.0, 0.0])
    domain = (counts - own + langid.DOMAIN_WEIGHT * root) / (7 + langid.DOMAIN_WEIGHT)
    host = (counts - own + langid.HOST_WEIGHT * domain) / (7 + langid.HOST_WEIGHT)
    share = 8 / 9
    suffix = (counts + langid.SMOOTH * share) / (counts + 1 + langid.SMOOTH)
    p = np.exp([2.0, 0.0]) * host * suffix
    assert got[0]["lang"] == "x" and got[0]["confidence"] == pytest.approx(p[0] / p.sum(), abs=1e-5)


def brute_fuse(rows, k):
    """The posterior of every row from the docstring's words, in plain Python."""
    best = [int(np.argmax(r[5])) if max(r[5]) > min(r[5]) else None for r in rows]
    seen = [(r, b) for r, b in zip(rows, best, strict=True) if b is not None]
    count = lambda keep: np.array([sum(1.0 for r, b in seen if b == i and keep(r)) for i in range(k)])
    root = count(lambda r: True)
    prior = (root + langid.SMOOTH) / (root.sum() + langid.SMOOTH * k)
    out = {}
    for r, b in zip(rows, best, strict=True):
        log = np.array(r[5])
        for at in (1, 4):
            value = r[at]
            if value and (n := count(lambda x, at=at, value=value: x[at] == value)).sum():
                share = max(n.sum() / (root.sum() + 1), 1e-9)
                log = log + np.log((n + langid.SMOOTH * share) / (root + 1 + langid.SMOOTH))
        own = np.array([float(b == i) for i in range(k)])
        named = bool(r[2])
        d = count(lambda x, r=r: bool(x[2]) and x[3] == r[3]) if named else np.zeros(k)
        h = count(lambda x, r=r: x[2] == r[2] and x[3] == r[3]) if named else np.zeros(k)
        if not h.sum():
            d = np.zeros(k)  # a host of which no text says anything has no counts
        d, h = np.maximum(d - own, 0), np.maximum(h - own, 0)
        pd = (d + langid.DOMAIN_WEIGHT * prior) / (d.sum() + langid.DOMAIN_WEIGHT)
        log = log + np.log((h + langid.HOST_WEIGHT * pd) / (h.sum() + langid.HOST_WEIGHT))
        out[r[0]] = (int(np.argmax(log)), 1 / np.exp(log - log.max()).sum())
    return out


def test_every_row_once_and_as_by_brute_force(spark):
    """Pages and documents together, with a source that is named like a page's host."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        page = i % 2
        host = str(rng.choice(["a.example.com", "b.example.com", "example.com", "x.org", ""]))
        domain = ".".join(host.split(".")[-2:]) if page else ""
        suffix = host.split(".")[-1] if page else ""
        ll = [0.0] * 3 if i % 17 == 0 else rng.normal(0, 2, 3).round(3).tolist()
        rows.append((i, str(rng.choice(["xx", "yy", ""])) if page else "", host, domain, suffix, ll))
    rows += [(300, None, None, None, None, [0.0, 0.0, 1.0]), (301, "", "example.com", "example.com", "com", [0.0, 0.0, 0.0]), (302, "", "example.com", "", "", [0.0, 0.0, 0.0])]
    got, want = fused(spark, ["x", "y", "z"], rows), brute_fuse(rows, 3)
    df = spark.createDataFrame(rows, "id long, declared string, host string, domain string, suffix string, ll array<double>")
    assert langid.fuse(df, ["x", "y", "z"]).count() == len(rows) == len(got)
    for i, (best, confidence) in want.items():
        assert got[i]["lang"] == "xyz"[best] and got[i]["confidence"] == pytest.approx(confidence, abs=2e-6)


def test_declared_and_host_decide_weak_texts(spark):
    rows = [(i, "yy", f"h{i}", "d", "s", [0.0, 5.0]) for i in range(20)] + [(i, "xx", f"g{i}", "e", "t", [5.0, 0.0]) for i in range(20, 40)]
    rows += [(100, "yy", "new", "", "", [0.0, 0.0]), (101, "xx", None, None, None, [0.01, 0.0]), (102, None, "h1", "d", "s", [0.0, 0.0])]
    got = fused(spark, ["x", "y"], rows)
    assert got[100]["lang"] == "y" and got[101]["lang"] == "x" and got[102]["lang"] == "y" and got[100]["text_lang"] is None


def test_markup():
    assert langid.visible("<p>a<script>b</script><!-- c --><style>d</style>e</p>").split() == ["a", "e"]
    assert len(langid.buckets("")) == 0 and len(langid.buckets("a")) == 1


def test_hard_rows(spark, model, nasty, empty):
    rows = langid.with_likelihood(langid.documents_rows(nasty), model)
    assert langid.fuse(rows, model[0]).count() == nasty.count()
    assert langid.fuse(langid.with_likelihood(langid.documents_rows(empty), model), model[0]).count() == 0
    languages, log = langid.fit(empty)
    assert languages == ["und"] and langid.fuse(langid.with_likelihood(langid.documents_rows(nasty), (languages, log)), languages).count() == nasty.count()
    pages = spark.createDataFrame([(1, None, None), (None, "nothing", "<html lang='DE-at'>"), (2, "http://u@h.co.uk:80/x", "<html lang=fr><p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.pages_rows(pages).collect()}
    assert got[None]["declared"] == "de" and got[2]["declared"] == "fr" and (got[2]["host"], got[2]["domain"], got[2]["suffix"]) == ("h.co.uk", "co.uk", "uk") and got[1]["host"] == ""


def test_no_label_is_lost(spark):
    """Seventy labels, and one of 0.1 per cent of the rows, in a table of more rows than the sample has."""
    word = lambda i: "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(6)) + chr(97 + i % 26) + chr(97 + i // 26)
    rows = [(n, f"{word(n % 70)} {word(n % 70)}", f"l{n % 70:02}") for n in range(7000)] + [(7000 + n, "цвет дом река", "zz") for n in range(7)]
    languages, log = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == [f"l{i:02}" for i in range(70)] + ["zz"] and log.shape == (71, langid.BUCKETS)
    assert int(log[:, langid.buckets("река дом цвет")].sum(axis=1).argmax()) == 70
    assert [int(log[:, langid.buckets(word(i))].sum(axis=1).argmax()) for i in range(70)] == list(range(70))


def test_too_many_labels_fail(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        langid.fit(spark.createDataFrame([(n, "ab", f"l{n}") for n in range(3)], "doc_id long, text string, lang string"))
