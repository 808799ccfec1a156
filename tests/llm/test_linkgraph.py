import numpy as np
import pytest
from support import SF

from tesselar.llm import linkgraph as lg

URLS = [
    ("http://A.Example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("x://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
    ("ftp://u.net/de/#f", "u.net", "/de/", "net/de/", "allow"), ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"), ("http://o.org/es/a://b", "o.org", "/es/a://b", "org/es/", "block"),
    ("http://o.org?x/es/", "o.org", "", None, None), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("http://ÉÄ.com/en/", "ÉÄ.com", "/en/", "com/en/", "block"), ("http://com/en/", "com", "/en/", "com/en/", "block"),
]


def test_rules(spark):
    rows = {r["page_id"]: r for r in lg.judge(spark.createDataFrame([(i, u[0], None) for i, u in enumerate(URLS)], "page_id long, url string, html string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict


def brute(hosts, edges, allowed, blocked):
    n = len(hosts)
    w = np.zeros((n, n))
    for a, b, k in edges:
        w[hosts.index(a), hosts.index(b)] = k
    out = []
    for m, seed in ((w, allowed), (w.T, blocked)):
        sums = m.sum(axis=1, keepdims=True)
        flow = np.divide(m, sums, out=np.zeros_like(m), where=sums > 0)
        s = (1 - lg.DAMPING) * np.array(seed)
        x = s.copy()
        for _ in range(500):
            x = s + lg.DAMPING * flow.T @ x
        out.append(x)
    return out


def test_a_long_cycle_with_the_shipped_parameters(spark):
    """Trust goes around a cycle until it doesn't move; the result is that of the linear system."""
    hosts = [f"h{i:02}" for i in range(12)]
    edges = [(hosts[i], hosts[(i + 1) % 12], 1) for i in range(12)] + [("h03", "h07", 2), ("h11", "h05", 1)]
    allowed, blocked = [1.0] + [0.0] * 11, [0.0] * 6 + [1.0] + [0.0] * 5
    w = np.zeros((12, 12))
    for a, b, k in edges:
        w[hosts.index(a), hosts.index(b)] = k
    want = []
    for seed in (None, np.ones(12)):
        for m, own in ((w, allowed), (w.T, blocked)):
            flow = m / m.sum(axis=1, keepdims=True)
            want.append(np.linalg.solve(np.eye(12) - lg.DAMPING * flow.T, (1 - lg.DAMPING) * (np.array(own) if seed is None else seed)))
    seeds = spark.createDataFrame(list(zip(hosts, allowed, blocked, strict=True)), "host string, allowed double, blocked double")
    rows = {r["host"]: r for r in lg.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    for name, values in zip(("trust", "distrust", "most_trust", "most_distrust"), want, strict=True):
        assert [rows[h][name] for h in hosts] == pytest.approx(values.tolist(), abs=1e-5)


def test_propagation(spark, monkeypatch):
    monkeypatch.setattr(lg, "DAMPING", 0.4)  # few rounds
    monkeypatch.setattr(lg, "TOLERANCE", 1e-4)
    hosts = list("abcdefg")
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "e", 1), ("e", "f", 5), ("d", "f", 1), ("f", "g", 1), ("g", "d", 2)]
    allowed, blocked = [1, 0, 0, 0.5, 0, 0, 0], [0, 0, 0, 0, 0, 1, 0]
    trust, distrust = brute(hosts, edges, allowed, blocked)
    seeds = spark.createDataFrame([(h, float(a), float(b)) for h, a, b in zip(hosts, allowed, blocked, strict=True)], "host string, allowed double, blocked double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in lg.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    for h, t, d in zip(hosts, trust, distrust, strict=True):
        assert got.get(h, (0, 0)) == pytest.approx((t, d), abs=1e-3)


def test_links_and_verdicts(spark):
    html = lambda *hosts: "".join(f'<a class=x href="//{h}/p">x</a><A HREF=\'http://{h.upper()}:80/\'>y</A><a href="/rel">z</a>' for h in hosts)
    pages = [(1, "http://bad.com/en/1", None), (2, "http://friend.net/x", html("bad.com")), (3, "http://friend.net/y", html("bad.com", "friend.net")), (4, "http://fine.net/x", html("other.net")), (5, "http://bad.com/fr/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, lg.host_edges(df).collect())) == [("fine.net", "other.net", 1), ("friend.net", "bad.com", 2)]
    got = {r["page_id"]: r["verdict"] for r in lg.judge(df).collect()}
    # bad.com: half of its pages are blocked, so it isn't itself; neither is friend.net, which links to nothing else.
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    worse = lg.judge(df.where("page_id <> 5"))
    assert {r["page_id"]: r["verdict"] for r in worse.collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_isolated_hosts(spark, duck):
    """Without links between hosts a host's score is its own share."""
    rows = lg.op4_url_filter(spark, SF).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM pages").fetchall()[0][0]
    shares = {}
    for r in rows:
        ruled = r["verdict"] if r["rule"] else None
        shares.setdefault(r["host"], []).append((ruled == "block") - (ruled == "allow"))
    for r in rows:
        if not r["rule"]:
            assert r["verdict"] == ("block" if np.mean(shares[r["host"]]) > lg.MARGIN else "allow")


def test_hard_rows(spark):
    schema = "page_id long, url string, html string, host int, VERDICT string"
    assert lg.judge(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, 1, "x"), (1, "a://b", "<a href=//>" * 3, 1, "x"), (1, "a://b", "<a href=//>" * 3, 1, "x"), (2, "http://x/" + "y" * 50000, "<a href='//z.com'>" * 5000, None, None)]
    assert lg.judge(spark.createDataFrame(rows, schema)).count() == 4


@pytest.mark.parametrize("linkers", [1, 2, 40])
def test_blocked_through_links_only(spark, linkers):
    """Hosts that mostly link to a wholly blocked host are blocked, however many they are; those that hardly do, or that allowed hosts link to, aren't."""
    html = lambda *hosts: "".join(f"<a href='//{h}/'>x</a>" for h in hosts)
    pages = [(0, "http://bad.com/en/1", None), (1, "http://good.net/de/1", html("praised.net"))]
    pages += [(10 + i, f"http://farm{i}.net/x", html("bad.com")) for i in range(linkers)]
    pages += [(100, "http://mixed.net/x", html("bad.com", "a.net", "b.net", "c.net")), (101, "http://praised.net/x", html("bad.com")), (102, "http://quiet.net/x", html("a.net"))]
    pages += [(200 + i, "http://busy.net/x", html("bad.com", "obscure.net") if i == 0 else html("bad.com")) for i in range(4)]
    got = {r["page_id"]: r["verdict"] for r in lg.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, *range(10, 10 + linkers), *range(200, 204)}
