"""Schema, patterns, graph algorithms and scores on small vectors."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselar import schema
from tesselar.functions import text
from tesselar.graph import PropertyGraph, checked
from tesselar.operators import changes, cluster, components, evals, flows, search, semdiff, sets
from tesselar.plans.cypher import CypherError, compile_query, escape, is_read_only


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_registry():
    assert len(schema.LABELS) == 17 and len(schema.REL_TABLES) == 76
    assert schema.REL_TABLES["Contains_Dir_File"] == ("Contains", "Directory", "File")


@pytest.mark.parametrize("query", ["MATCH (n) DELETE n", "create (n)", "MATCH (n) SET n.a = 1", "CALL x()", "MERGE (n)", "LOAD x", "DROP x", "REMOVE x"])
def test_writes_are_refused(query):
    assert not is_read_only(query)


@pytest.mark.parametrize("query", ["MATCH (n) RETURN n.created_at", "MATCH (n) WHERE n.setting = 1 RETURN n", "OPTIONAL MATCH (n) RETURN n"])
def test_reads_are_allowed(query):
    assert is_read_only(query)


def test_escape():
    assert escape("foo'bar") == "foo\\'bar" and escape("a\\b") == "a\\\\b" and escape("x\\'y") == "x\\\\\\'y"


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "F", "a", "m::a"), ("b", "F", "b", "m::b"), ("c", "G", "c", "n::c")], "id string, label string, name string, qualified_name string")
    edges = spark.createDataFrame([("C_F_F", "C", "F", "a", "F", "b"), ("C_F_G", "C", "F", "b", "G", "c"), ("C_G_F", "C", "G", "c", "F", "a")], "rel string, kind string, from_label string, from_id string, to_label string, to_id string")
    return PropertyGraph(nodes, edges)


def test_patterns(small):
    run = lambda q, **p: sorted(map(tuple, compile_query(small, q, p).collect()))
    assert run("MATCH (x:F)-[:C]->(y) RETURN x.name, y.id") == [("a", "b"), ("b", "c")]
    assert run("MATCH (x)-[r:C]->(y)-[:C]->(z) WHERE x.name = $n RETURN z.name AS z, type(r) AS t", n="a") == [("c", "C_F_F")]
    assert run("MATCH (y)<-[:C_F_F]-(x) RETURN x.name") == [("a",)]
    assert run("MATCH (x:F) OPTIONAL MATCH (x)-[:C_F_G]->(g:G) RETURN x.name, g.id") == [("a", None), ("b", "c")]
    assert run("MATCH (x:F), (y:G) WHERE x.name = 'a' AND y.name = 'c' RETURN x.id, y.id") == [("a", "c")]
    assert run("UNWIND [1, 2] AS n RETURN n * 2 AS m") == [(2,), (4,)]
    assert run("MATCH (x {name: 'b'}) RETURN x.qualified_name") == [("m::b",)]
    assert run("MATCH (x) WHERE NOT x.name IN ['a', 'b'] RETURN count(*) AS n") == [(1,)]
    assert run("MATCH (x:F) RETURN DISTINCT x.label AS l ORDER BY l LIMIT 5") == [("F",)]


@pytest.mark.parametrize("query", ["MATCH (x RETURN x", "MATCH (x) RETURN x.nothing", "MATCH (x)", "RETURN y", "MATCH (x) RETURN x.id ORDER BY x.name"])
def test_bad_patterns(small, query):
    with pytest.raises(CypherError):
        compile_query(small, query)


def test_insert_checks_ends(spark, small):
    new = small.edges.limit(0).unionByName(spark.createDataFrame([("C_F_F", "C", "F", "a", "F", "zz"), ("C_F_F", "C", "F", "b", "F", "a")], small.edges.schema))
    assert [r["from_id"] for r in checked(new, small.nodes).collect()] == ["b"]


def test_tokens(spark):
    for name, words in [("handle_tool_call", "handle tool call"), ("GraphStore", "graph store"), ("src/main.rs::handle_tool_call", "src main rs handle tool call"), ("HTTPServer", "h t t p server"), ("", "")]:
        assert one(spark, text.symbol_text(F.lit(name))) == words
        assert " ".join(search.tokenise(name)) == words


def test_scalars(spark):
    assert one(spark, text.strip_first_folder(F.lit("src/foo/bar.rs::baz"))) == "foo/bar.rs::baz"
    assert one(spark, text.strip_first_folder(F.lit("main.rs::foo"))) is None
    assert one(spark, text.type_identifiers(F.lit("Option<Result<Foo, Bar>>"))) == ["Foo", "Bar"]
    assert one(spark, text.type_identifiers(F.lit("HashMap<String, Value>"))) == ["Value"]
    for header, start in [("@@ -10,5 +20,7 @@ fn foo", 20), ("@@ -1 +1,3 @@", 1), ("@@ -0,0 +1 @@", 1), ("@@ x", None)]:
        assert one(spark, text.hunk_start(F.lit(header))) == start
    assert one(spark, text.safe_id(F.lit("a-b_1.x"))) and not one(spark, text.safe_id(F.lit("../x")))
    assert one(spark, text.community_number(F.lit("community::louvain::1::7"))) == 7
    assert one(spark, text.file_of_id(F.lit("a/b.go::f::call@1:2"))) == "a/b.go"
    assert one(spark, text.visibility("python", F.lit("__init__"))) == "" and one(spark, text.visibility("python", F.lit("_x"))) == "private"
    assert one(spark, text.is_constant_name(F.lit("HTTP_200"))) and not one(spark, text.is_constant_name(F.lit("_")))


def test_term_score(spark):
    score = lambda t, n, q: one(spark, search.term_score(F.lit(t), F.lit(n), F.lit(q)))
    assert score("main", "main", "x::main") == 1.0 and 0.7 < score("main", "domain", "q") < 1 and 0.5 < score("m", "x", "m::x") < 1 and score("z", "x", "y") == 0.0


def test_fusion(spark):
    lists = [spark.createDataFrame(r, "key string, rank int") for r in ([("a", 1), ("b", 2)], [("b", 1), ("a", 2)])]
    assert {round(r["score"], 6) for r in search.fuse(lists).collect()} == {round(1 / 61 + 1 / 62, 6)}


def cliques():
    return [(a, b) for g in ("abc", "def") for a, b in itertools.combinations(g, 2)] + [("c", "d")]


def test_louvain_two_cliques(spark):
    pairs = cliques()
    pdf = pd.DataFrame([(a, b, 3.0) for a, b in pairs] + [(b, a, 3.0) for a, b in pairs], columns=["src", "dst", "w"])
    got = cluster.local_moves(pdf).groupby("community").id.agg("".join)
    assert sorted(got) == ["abc", "def"]
    adjacent = spark.createDataFrame(pdf)
    nodes = spark.createDataFrame([(c,) for c in "abcdefz"], "id string")
    for method in ("sequential", "rounds"):
        parts = {r["id"]: r["community"] for r in cluster.louvain(nodes, adjacent, method=method).collect()}
        assert set(parts) == set("abcdefz") and parts["a"] == parts["b"] == parts["c"] and parts["z"] == "z"
    q = cluster.modularity(cluster.louvain(nodes, adjacent), adjacent).first()
    assert 0 < q["modularity"] <= 1


def test_repair(spark):
    parts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, community string")
    adjacent = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    assert sorted(map(tuple, cluster.repaired(parts, adjacent).select("id", "community").collect())) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_strong_components(spark):
    e = spark.createDataFrame([(0, 0), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (7, 1)], "a long, b long")
    assert sorted(map(tuple, components.strong(e).collect())) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert components.strong(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 0


def test_reach_depths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "a string, b string")
    got = {(r["id"], r["depth"]) for r in components.reach(spark.createDataFrame([("a",)], "id string"), e).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1)}


def test_entry_points(spark):
    rows = [("1", "main", "x.py::main", ""), ("2", "test_a", "m::test_a", ""), ("3", "do_x", "m::do_x", "pub"), ("4", "lib", "l.rs::lib", "pub"), ("5", "lib", "l.rs::m::lib", "pub"), ("6", "p", "l.rs::p", "")]
    got = {r["id"]: (r["kind"], r["confidence"]) for r in flows.entry_points(spark.createDataFrame(rows, "id string, name string, qualified_name string, visibility string")).collect()}
    assert got == {"1": ("main", 1.0), "2": ("test", 1.0), "3": ("handler", 0.8), "4": ("lib_entry", 0.6)}


def test_verdicts(spark):
    s = lambda d, c, u: one(spark, semdiff.score(F.lit(d), F.lit(c), F.lit(u)))
    assert s(3, 0, 0) == 3.0 and s(100, 100, 0) == 10.0 and s(0, 0, 1000) == 5.0
    for x, v in [(0.999, "clean"), (1.0, "concerning"), (4.999, "concerning"), (5.0, "regression")]:
        assert one(spark, semdiff.verdict(F.lit(x))) == v


def test_new_cycle(spark, small):
    before = PropertyGraph(small.nodes, small.edges.where("rel <> 'C_G_F'"))
    parts = semdiff.run(before, small)
    row = parts["summary"].first()
    assert row["new_cycles"] == 1 and row["edges_added"] == 1 and row["verdict"] == "clean"
    assert parts["new_cycles"].first()["cycle"] == "m::a,m::b,n::c"
    same = semdiff.run(small, small)["summary"].first()
    assert same["dangling"] == same["new_cycles"] == 0 and same["verdict"] == "clean"


DIFF = """diff --git a/x.rs b/x.rs
--- a/x.rs
+++ b/x.rs
@@ -10,3 +20,3 @@ fn foo
 kept
-gone
+new
+more
diff --git a/n.rs b/n.rs
--- /dev/null
+++ b/n.rs
@@ -0,0 +1 @@
+a
diff --git a/d.rs b/d.rs
--- a/d.rs
+++ /dev/null
@@ -1 +0,0 @@
-a
"""


def test_diff(spark):
    rows = changes.parse_diff(spark.createDataFrame([("d", DIFF)], "diff_id string, text string")).collect()
    assert sorted((r["path"], r["line"]) for r in rows if r["path"] == "x.rs") == [("x.rs", 21), ("x.rs", 21), ("x.rs", 22)]
    assert [r["is_new"] for r in rows if r["path"] == "n.rs"] == [True] and [r["is_deleted"] for r in rows if r["path"] == "d.rs"] == [True]


def test_bad_refs(spark):
    for ref in ("-x", "a\nb", ""):
        with pytest.raises(ValueError):
            changes.git_diff(spark, "/tmp", ref)


def test_scores(spark):
    f1 = lambda e, a: one(spark, evals.f1(F.lit(e) if e else F.array().cast("array<string>"), F.lit(a) if a else F.array().cast("array<string>")))
    assert f1(["a", "b"], ["a", "c"]) == 0.5 and f1([], []) == 1.0 and f1(["a"], []) == 0.0
    assert one(spark, evals.exact(F.lit(" A "), F.lit("a"))) == 1.0
    pairs = spark.createDataFrame([(1, 5), (1, 5), (2, 7), (2, 7)], "a int, b int")
    assert evals.adjusted_rand(pairs, "a", "b").first()["score"] == 1.0
    assert one(spark, evals.precision_recall_mean(F.lit(["a", "b"]), F.lit(["a"]))) == 0.75
    scores = spark.createDataFrame([("c", q, 1.0) for q in evals.WEIGHTS if q != "q7"], "corpus string, query_id string, score double")
    assert evals.weighted(scores, ["corpus"]).first()["score"] == round(1 - 0.15 / sum(evals.WEIGHTS.values()), 6)


def test_renumber(spark):
    rows = spark.createDataFrame([(0, i, c) for i, c in enumerate([5, 5, 3, 3, 5, 10])], "p int, i int, c int")
    assert [r["number"] for r in sets.dense_numbers(rows, "c", "i", ["p"]).orderBy("i").collect()] == [0, 0, 1, 1, 0, 2]


def test_louvain_by_component_is_the_same(spark, monkeypatch):
    """Over the edges of one task, components are dealt out: the partition must not change."""
    rng = random.Random(3)
    pairs = {(f"n{g}-{a}", f"n{g}-{b}", rng.choice([0.5, 1.0, 3.0])) for g in range(12) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.4}
    adjacent = spark.createDataFrame([*pairs, *((b, a, w) for a, b, w in pairs)], "src string, dst string, w double")
    nodes = spark.createDataFrame([(f"n{g}-{i}",) for g in range(12) for i in range(9)] + [("z",)], "id string")
    parts = lambda: sorted(map(tuple, cluster.louvain(nodes, adjacent).collect()))
    whole = parts()
    monkeypatch.setattr(cluster, "LOCAL_EDGES", 50)
    assert parts() == whole and len(whole) == 109


@pytest.mark.parametrize("seed", range(3))
def test_components_against_a_loop(spark, seed):
    """Sparse random graphs, a path downwards and a star with the greatest node in its middle."""
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 - i, 199 - i) for i in range(40)] + [(400, 300 + i) for i in range(20)]
    ids = [*range(80), *range(160, 201), *range(300, 320), 400]
    least = {i: i for i in ids}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components.connected(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == least and got.count() == len(ids)


def test_lines_are_dealt_out(spark, monkeypatch):
    """More lines than the session's partitions should group: more partitions, the same edges."""
    from support import SF

    from tesselar import tables

    lines = tables.table(spark, SF, "lineitem")
    edges = lambda: tables.graph(spark, SF).of_kind("Calls", "Uses").groupBy("kind").agg(F.count("*"), F.sum("weight"), F.sum(F.xxhash64("from_id", "to_id", "weight") % 1000)).orderBy("kind").collect()
    whole = edges()
    monkeypatch.setattr(tables, "LINES_PER_PART", 500)
    assert tables._spread(lines, "l_orderkey", "l_partkey").rdd.getNumPartitions() == -(-lines.count() // 500) > 4
    assert edges() == whole
