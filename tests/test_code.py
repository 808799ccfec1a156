"""Extractors, indexing, resolution and tools on small source trees."""

import json
import os
from collections import Counter

import pytest

from tesselar import tools
from tesselar.operators import index, resolve
from tesselar.parsing import parse
from tesselar.sources import documents, files

RUST = {
    "src/main.rs": """use crate::models::{Config, helper as h};
use std::collections::HashMap;
fn main() { helper(); let c = Config::new(); println!("x {}", r#"fn no() {}"#); do_run(); }
pub fn do_run() { helper() } // fn comment() {}
mod inner { pub async fn deep() {} }
""",
    "src/models.rs": """#[derive(Debug, Clone)]
pub struct Config { pub name: String, child: Inner, m: Option<Inner> }
pub struct Inner {}
impl<T: Into<Vec<u8>>> Config { pub fn new() -> Self { helper(); Config{} } }
pub trait Processor: Send { fn process(&self); fn reset(&mut self) {} }
impl Processor for Config { fn process(&self) {} }
pub enum Status { Active, Inactive(u8), Error { code: i32 } }
pub fn helper() {}
pub type Alias = Vec<Inner>;
const MAX: u32 = 3;
""",
}


def labels(source, path, language):
    nodes, refs = parse(source, path, language)
    return Counter(n.label for n in nodes), {n.qualified_name: n for n in nodes}, refs


def test_rust():
    count, by, refs = labels(RUST["src/models.rs"], "m.rs", "rust")
    assert count["Struct"] == 2 and count["Field"] == 3 and count["Variant"] == 3 and count["Method"] == 4 and count["TypeAlias"] == count["Constant"] == count["Enum"] == count["Trait"] == 1
    assert {r.to_qualified_name for r in refs if r.kind == "DeriveImplements"} == {"Debug", "Clone"}
    assert ("m.rs::Processor", "Send") in {(r.from_qualified_name, r.to_qualified_name) for r in refs if r.kind == "Extends"}
    assert by["m.rs::Config"].visibility == "pub" and by["m.rs::Config::m"].properties["type_annotation"] == "Option<Inner>"
    count, by, _ = labels(RUST["src/main.rs"], "a.rs", "rust")
    assert count["Function"] == 3 and count["Import"] == 3 and count["Module"] == 1
    assert {n.properties["callee_name"] for n in by.values() if n.label == "CallSite"} == {"helper", "Config::new", "println!", "do_run"}
    assert by["a.rs::inner::deep"].properties["is_async"] == "true"


def test_python():
    count, by, refs = labels("import os.path\nfrom .a import b as c\nfrom x.y import *\nMAX_SIZE: int = 3\nclass A(B, c.D):\n    async def go(self): return helper(1)\n    def go(self): pass\ndef f():\n    g()\n    x.h()\n", "a.py", "python")
    assert count == {"Import": 3, "Constant": 1, "Struct": 1, "Method": 2, "Function": 1, "CallSite": 2}
    assert "a.py::A::go@7" in by and {n.properties["path"] for n in by.values() if n.label == "Import"} == {"os::path", "::a::b", "x::y::*"}
    assert {r.to_qualified_name for r in refs if r.kind == "Extends"} == {"B", "c::D"}


def test_typescript():
    source = "import d, { A, B as C } from './x/y';\nimport * as ns from 'z';\nexport class K<T> extends A<T> implements I, J { private readonly n: number = 1; constructor(x: string) { super(x); helper(); } async go(): Promise<void> { new Foo(); } }\nexport interface I { m(a: number): void; p?: string }\nenum E { A = 1, B }\nexport type U = string | number;\nexport const LIMIT = 3;\nexport const f = async (x: number) => { g(x); };\nfunction h() { return `a${b}`; }\n"
    count, by, refs = labels(source, "a.ts", "typescript")
    assert count["Import"] == 4 and count["Function"] == 2 and count["Method"] == 3 and count["Trait"] == count["Enum"] == count["TypeAlias"] == count["Struct"] == count["Constant"] == 1 and count["Variant"] == 2
    assert by["a.ts::f"].visibility == "pub" and {r.to_qualified_name for r in refs if r.kind == "Implements"} == {"I", "J"}
    assert "Foo" not in {n.properties["callee_name"] for n in by.values() if n.label == "CallSite"}


@pytest.mark.parametrize(
    "language,path,source,expected,names",
    [
        ("java", "A.java", "import java.util.List;\n@F(1) public class A<T> extends B<T> implements C { private final int x = 3; public A(int y) { run(y); } @Override public List<String> go(int a) throws E { return helper(new T(a)); } enum K { ONE, TWO(2); } interface I { void m(); } }\nrecord P(int a) {}", {"Struct": 2, "Enum": 1, "Trait": 1, "Method": 3, "Import": 1, "Constant": 3}, {"run", "helper", "T"}),
        ("kotlin", "A.kt", "import a.b.C\ndata class A(val x: Int) : B(x), I {\n  private val y = 3\n  fun go(a: Int): String { return helper(a) }\n}\nenum class E { ONE, TWO }\nfun String.ext(): Int = size()\ninterface I { fun m() }\n", {"Struct": 1, "Enum": 1, "Trait": 1, "Method": 2, "Function": 1, "Import": 1, "Constant": 3}, {"helper", "size"}),
        ("swift", "A.swift", "import Foundation\npublic class A: B { let x: Int = 3\n func go(_ a: Int) -> String { return helper(a) }\n}\nenum E { case one, two }\nprotocol P { func m() }\nextension A { func more() { go(1) } }\n", {"Struct": 2, "Enum": 1, "Trait": 1, "Method": 3, "Import": 1, "Constant": 3}, {"helper", "go"}),
        ("go", "a.go", 'package m\nimport ( "fmt"\n m "math/big" )\ntype A struct { x int }\ntype I interface { M() }\ntype Id = int\nconst ( X = 1\n y = 2 )\nfunc (a *A) Go(b int) string { return fmt.Sprint(helper(b)) }\nfunc helper(b int) int { return b }\n', {"Struct": 1, "Trait": 1, "TypeAlias": 1, "Method": 1, "Function": 1, "Import": 2, "Constant": 2}, {"Sprint", "helper"}),
        ("c", "a.c", '#include <stdio.h>\n#define X(a) foo(a)\ntypedef struct node { int v; } node_t;\nenum color { RED, GREEN = 2 };\nstatic int add(int a, int b) { return helper(a) + b; }\nint proto(void);\n', {"Struct": 1, "Enum": 1, "Function": 2, "Import": 1, "Constant": 3}, {"helper"}),
        ("cpp", "a.cpp", "using namespace std;\nnamespace ns { class A : public B { public: A(int x); int go() const { return helper(x_); } private: int x_; };\ntemplate <typename T> T id(T a) { return a; } }\n", {"Struct": 2, "Function": 1, "Method": 2, "Import": 1, "Constant": 1}, {"helper"}),
        ("objc", "a.m", "#import <F/F.h>\n@interface A : NSObject\n- (void)doIt:(int)a with:(NSString *)b;\n@end\n@implementation A\n- (void)doIt:(int)a with:(NSString *)b { [self other:a]; helper(a); }\n@end\nint f(int a) { return g(a); }\n", {"Struct": 2, "Method": 2, "Function": 1, "Import": 1}, {"other", "helper", "g"}),
    ],
)
def test_languages(language, path, source, expected, names):
    count, by, _ = labels(source, path, language)
    assert {k: v for k, v in count.items() if k != "CallSite"} == expected
    assert {n.properties["callee_name"] for n in by.values() if n.label == "CallSite"} == names


@pytest.mark.parametrize("language", ["rust", "typescript", "java", "kotlin", "swift", "go", "c", "cpp", "objc"])
@pytest.mark.parametrize("source", ["", "{", "}}}", "fn (", "class", '"open', "/* open", "import", "type X", "enum E { A,", "((((", "@", "é = 1", "struct", "<<<>>>"])
def test_broken_sources(language, source):
    parse(source, "x", language)


def test_index_and_resolve(spark):
    graph, parsed = index.run(files.inline(spark, RUST | {"bad.py": "def ("}))
    assert {r["label"]: r["n"] for r in graph.node_count().collect()}["Function"] == 4
    assert parsed.where("record = 'error'").count() == 1
    refs = parsed.where("record = 'ref'").select("kind", "from_qualified_name", "to_qualified_name")
    done, stats, missing = resolve.run(graph, "rust", refs)
    got = {(r["rel"], r["from_id"], r["to_id"]) for r in done.edges.where("confidence is not null").collect()}
    assert ("Uses_Field_Struct", "src/models.rs::Config::child", "src/models.rs::Inner") in got
    assert ("Calls_Function_StdlibSymbol", "src/main.rs::main", "stdlib::rust::std::io::_print") in got
    assert ("Imports_File_Struct", "src/main.rs", "src/models.rs::Config") in got
    assert ("Implements_Struct_Trait", "src/models.rs::Config", "src/models.rs::Processor") in got
    assert ("Implements_Struct_StdlibSymbol", "src/models.rs::Config", "stdlib::rust::derive::Debug") in got
    again, _, _ = resolve.run(done, "rust", refs)
    assert again.edges.count() == done.edges.count()
    assert {r["reason"] for r in missing.collect()} == {"external crate"}


def test_read_tree(spark, tmp_path):
    for path in ("a.rs", "sub/b.py", ".git/c.rs", "target/d.rs", "e.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    rows = {r["path"]: r["content"] for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.rs", "sub/b.py", "bad.rs"} and rows["bad.rs"] is None
    assert [p for p, _ in files.list_tree(str(tmp_path), "python")] == ["sub/b.py"]
    assert files.dominant_language(files.read_tree(spark, str(tmp_path))) == "rust"


def test_findings(tmp_path):
    good = {"id": "a", "title": "t", "relevance_category": "c"}
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"findings": [good]}))
    assert documents.load_finding(str(path)) == good
    for bad, reason in [({}, "missing_id"), (good | {"title": " "}, "missing_title"), ("x.md", "unsupported_format"), ("x.json", "unsafe_path"), ({"findings": []}, "ambiguous_finding")]:
        with pytest.raises(documents.FindingError) as e:
            documents.load_finding(bad)
        assert e.value.reason == reason


def test_session_tools(tmp_path):
    ids = {"run_id": "r", "finding_id": "f", "output_dir": str(tmp_path)}
    call = lambda name, **a: tools.call(None, name, a)
    reason = lambda r: r.get("reason", r["status"])
    assert reason(call("start_verification", **ids)) == "refined_artifact_missing"
    assert call("extract_finding", finding={"id": "f", "title": "t", "relevance_category": "c"}, output_dir=str(tmp_path), run_id="r")["status"] == "ok"
    assert reason(call("refine_finding", **ids, refined_prompt=" x", refinement={"a": 1})) == "ok"
    assert call("start_verification", **ids)["state"] == "open"
    assert reason(call("start_verification", **ids)) == "illegal_transition"
    assert reason(call("finalize_verification", **ids)) == "no_clarification_round"
    assert reason(call("append_clarification", **ids, kind="user_answer", content="x")) == "alternation_violation"
    assert call("append_clarification", **ids, kind="agent_question", content="q")["state"] == "waiting_for_user"
    assert reason(call("finalize_verification", **ids)) == "unanswered_question"
    assert call("append_clarification", **ids, kind="user_answer", content="a", meta={"k": 1})["state"] == "waiting_for_agent"
    assert call("finalize_verification", **ids)["verified"] is True
    assert reason(call("abort_verification", **ids)) == "already_finalized"
    entry = json.loads((tmp_path / "runs/r/index.json").read_text())["findings"]["f"]
    assert entry["verified"] is True and entry["refined_at"]
    assert reason(call("abort_verification", run_id="../x", finding_id="f", output_dir=str(tmp_path))) == "unsafe_id"
    assert reason(call("nothing")) == "unknown_tool" and reason(call("query_graph")) == "missing_argument"
    assert reason(call("query_graph", graph_path="rel", query="x")) == "unsafe_path"
    assert len(tools.TOOLS) == 23


def test_graph_tools(spark, tmp_path):
    for path, source in RUST.items():
        (tmp_path / "code" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "code" / path).write_text(source)
    call = lambda name, **a: tools.call(spark, name, a)
    made = call("analyze_codebase", path=str(tmp_path / "code"), output_dir=str(tmp_path / "out"))
    assert made["status"] == "ok" and made["index"]["files_indexed"] == 2
    at = made["index"]["graph_path"]
    assert call("query_graph", graph_path=at, query="MATCH (f:Function)-[:Calls]->(g:Function) RETURN f.name, count(g) ORDER BY f.name")["rows"] == [["do_run", "1"], ["main", "2"]]
    assert call("query_graph", graph_path=at, query="MATCH (n) DELETE n")["reason"] == "read_only_query_required"
    assert call("search_codebase", graph_path=at, query="do run")["results"][0]["name"] == "do_run"
    context = call("get_context", graph_path=at, qualified_name="src/models.rs::helper")
    assert {"name": "main", "qualified_name": "src/main.rs::main", "kind": "Function"} in context["relationships"]["called_by"]
    assert len(context["relationships"]) == 8 and context["relationship_counts"]["called_by"] == len(context["relationships"]["called_by"])
    assert context["symbol"]["kind"] == "Function" and context["symbol"]["file_path"] == "src/models.rs" and context["community"]["member_count"] > 1
    assert call("get_symbol", graph_path=at, qualified_name="x.rs::helper")["did_you_mean"] == ["src/models.rs::helper"]
    assert call("get_impact", graph_path=at, qualified_name="src/main.rs::main")["processes"] == ["process::src/main.rs::main"]
    prd = tmp_path / "p.md"
    prd.write_text("change `helper` and `nope_x`")
    report = call("validate_prd_against_graph", prd_path=str(prd), graph_path=at)
    assert report["extraction_mode"] == "regex_fallback" and report["summary"]["critical"] == 0
    (tmp_path / "p.affected_symbols.json").write_text(json.dumps({"affected_symbols": [{"qualified_name": "nope", "change_kind": "modify"}]}))
    assert call("validate_prd_against_graph", prd_path=str(prd), graph_path=at)["validation_status"] == "fail"
    gates = call("check_security_gates", graph_path=at, changed_symbols=["src/models.rs::helper"])
    assert gates["gates_passed"] and gates["summary"]["info"] == 1
    assert os.path.isdir(f"{at}/search/norms")
    (tmp_path / "other" / "graph").mkdir(parents=True)
    assert call("index_codebase", path=str(tmp_path / "code"), output_dir=str(tmp_path / "other"))["reason"] == "not_a_graph"
    assert call("cluster_graph", graph_path=at, method="guess")["reason"] == "invalid_method"


def test_counts_are_not_limited(spark, tmp_path, monkeypatch):
    """Only listings are cut off."""
    monkeypatch.setattr(tools._rows, "__defaults__", (2,))
    (tmp_path / "code" / "src").mkdir(parents=True)
    (tmp_path / "code" / "src" / "a.rs").write_text("".join(f"pub fn f{i}() {{}}\n" for i in range(7)))
    call = lambda name, **a: tools.call(spark, name, a)
    at = call("index_codebase", path=str(tmp_path / "code"), output_dir=str(tmp_path / "out"))["graph_path"]
    call("cluster_graph", graph_path=at)
    diff = "diff --git a/src/a.rs b/src/a.rs\n--- /dev/null\n+++ b/src/a.rs\n@@ -0,0 +1,7 @@\n" + "+x\n" * 7
    got = call("detect_changes", graph_path=at, diff_text=diff)
    assert got["symbols_affected_count"] == 7 and len(got["symbols_affected"]) == 2 and got["processes_affected_count"] == 7
    gates = call("check_security_gates", graph_path=at, changed_symbols=[f"nope{i}" for i in range(5)])
    assert gates["summary"]["info"] == 5 and len(gates["report"]["flags"]) == 2


def test_louvain_is_chosen_by_name(spark, monkeypatch):
    from tesselar.operators import cluster

    edges = [(a, b, 1.0) for g in ("a", "b") for x in range(4) for y in range(4) if x != y for a, b in [(f"{g}{x}", f"{g}{y}")]] + [("a0", "b0", 0.5), ("b0", "a0", 0.5)]
    adjacent = spark.createDataFrame(edges, "src string, dst string, w double")
    nodes = adjacent.select(adjacent.src.alias("id")).distinct()
    want = {f"{g}{x}": f"{g}0" for g in ("a", "b") for x in range(4)}
    for method in ("sequential", "rounds"):
        assert {r["id"]: r["community"] for r in cluster.louvain(nodes, adjacent, method=method).collect()} == want
    monkeypatch.setattr(cluster, "LOCAL_EDGES", 3)
    with pytest.raises(ValueError):
        cluster.louvain(nodes, adjacent)


def test_lines_of_requests(capsys):
    import io

    from tesselar import server

    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "health_check"}}, {"id": 4, "method": "tools/call", "params": {"name": "x"}}, {"id": 5, "method": "x"}]
    sink = io.StringIO()
    server.serve(None, io.StringIO("not json\n[1]\n" + "\n".join(map(json.dumps, lines))), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5] and len(got[1]["result"]["tools"]) == 23
    assert not got[2]["result"]["isError"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601


def test_corpora(spark, tmp_path):
    from tesselar.sources import corpora

    (tmp_path / "corpus.toml").write_text('[corpus]\nid = "c"\nlanguage = "rust"\n')
    truth = {"corpus": "c", "version": 1, "labels": [{"query_id": "q1", "input": {"a": 1}, "expected": {"b": []}}]}
    (tmp_path / "ground_truth.json").write_text(json.dumps(truth))
    assert corpora.labels(spark, [corpora.load(str(tmp_path))]).first()["query_id"] == "q1"
    for bad in (truth | {"corpus": "d"}, truth | {"labels": [{"query_id": "q99"}]}):
        (tmp_path / "ground_truth.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            corpora.load(str(tmp_path))


def test_schemas():
    known = {t["name"]: t["inputSchema"]["properties"] for t in tools.describe()}
    assert known["search_codebase"]["limit"] == {"type": "integer"} and known["search_codebase"]["label_filter"] == {"type": "string"}
    assert known["check_security_gates"]["changed_symbols"] == {"type": "array", "items": {"type": "string"}}
    assert known["cluster_graph"]["method"]["enum"] == ["sequential", "rounds"] and known["cluster_graph"]["resolution_param"] == {"type": "number"}
    assert known["query_graph"]["graph_path"] == {"type": "string", "pattern": "^/"} and "pattern" in known["extract_finding"]["run_id"]
    assert known["extract_finding"]["finding"] == {"type": ["object", "string"]}
    assert {a for tool in known.values() for a, p in tool.items() if not p} == {"meta"}  # which can be anything


def written(language, n):
    """The queries' item for n parts."""
    import re

    from tesselar.queries.code import ITEMS

    extra = {"python": "MAX_# = 1\n@deco\ndef part_#(a):\n    return call_%(a.method('def x(): pass'))\nif X:\n    A_# = '''\ndef no(): pass\n'''\nelse:\n    import m#\nclass K#(B):\n    def go(self): g#()\n", "rust": "#[derive(Debug)]\n#[cfg(x)]\npub struct P# { pub size: u32, next: Option<P#> }\nimpl P# { fn f#(&self) { helper::g%(); println!(\"fn {}\", 1); } }\nuse a::{b#, c as d#};\nmod m# { fn x() { y#(); } }"}
    item = extra.get(language) or "#include <a#.h>\n" * (language in ("c", "cpp", "objc")) + ITEMS[language][1]
    return "\n".join(re.sub(r"#(?=\W|$|\d)", str(i), item.replace("#include", "\0").replace("#define", "\1").replace("#[", "\2")).replace("%", str(i % 7)).replace("\0", "#include").replace("\1", "#define").replace("\2", "#[") for i in range(n))


@pytest.mark.parametrize("language", ["python", "rust", "typescript", "java", "kotlin", "swift", "objc", "c", "cpp", "go"])
def test_long_files_are_read_in_windows(monkeypatch, language):
    """A window of a few tokens, in which no item has room, gives what the whole file gives."""
    from tesselar.parsing import base, python

    source = written(language, 40)
    whole = parse(source, "x", language)
    assert len(whole[0]) >= 120
    for size in (8, 100, 333):
        monkeypatch.setattr(base, "WINDOW", size)
        monkeypatch.setattr(python, "PIECE", size)
        assert parse(source, "x", language) == whole


def test_no_file_is_too_long(spark):
    """Over a megabyte, all is found; a file that can't be read fails a strict job, and is a row else."""
    from tesselar.parsing import parse_files

    long = "".join(f"pub struct P{i} {{ pub size: u32 }} // {'-' * 100}\n" for i in range(10_000))
    broken = "x = 1\n" * 50_000 + "def ("
    made = spark.createDataFrame([("a.rs", "rust", long), ("b.py", "python", broken)], "path string, language string, content string")
    rows = parse_files(made)
    assert len(long) > 1 << 20 and rows.where("label = 'Struct'").count() == 10_000
    assert [r["record"] for r in rows.where("file = 'b.py'").collect()] == ["error"]
    with pytest.raises(Exception, match="SyntaxError|was never closed"):
        parse_files(made, strict=True).count()
