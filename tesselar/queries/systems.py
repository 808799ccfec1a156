"""Scalar functions on made-up names, resolution of code that calls itself, and the named tools on a small source tree."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import tools
from tesselar.functions import text
from tesselar.operators import index, joins, resolve, storage
from tesselar.queries.code import PATH, _files, _key
from tesselar.queries.registry import query
from tesselar.tables import table


@query(
    r"""
WITH p AS (SELECT p_partkey, p_size, p_name, p_brand, CASE p_size % 4 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'kts' ELSE 'txt' END AS ext FROM part)
SELECT p_partkey, CASE WHEN ext = 'txt' THEN 'a/b.txt::f' || p_partkey || '::call@' || p_size || ':3#1-2' ELSE 'a/b.' || ext END AS file, 'a/b.' || ext || '::f' || p_partkey AS caller, 'Calls' AS kind, p_partkey::BIGINT AS community, -1::BIGINT AS no_community,
  CASE ext WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'kts' THEN 'kotlin' END AS language, lower(regexp_replace(p_brand || ':' || p_name, '[^A-Za-z0-9_:]', '', 'g')) AS token,
  p_size % 4 <> 3 AS is_safe_id, p_size % 2 = 0 AS is_safe_path, strftime(make_timestamp(p_partkey * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(make_timestamp(p_partkey * 86400000000), '%Y%m%dT%H%M%SZ') AS compact,
  'a%20b/Brand%23' || p_brand[7:] AS encoded, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'package' END AS go_visibility, CASE WHEN p_size % 2 = 0 THEN 'private' ELSE '' END AS python_visibility, p_size % 2 = 0 AS is_constant,
  'b.' || ext || '::f' || p_partkey AS stripped, p_partkey::BIGINT AS hunk
FROM p"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions on ids, paths, names and times, one by one."""
    key, size, even = _key(), F.col("p_size"), F.col("p_size") % 2 == 0
    ext = F.when(size % 4 == 0, "rs").when(size % 4 == 1, "py").when(size % 4 == 2, "kts").otherwise("txt")
    path = F.concat(F.lit("a/b."), ext)
    i = F.concat(path, F.lit("::f"), key, F.lit("::call@"), size.cast("string"), F.lit(":3#1-2"))
    seconds = F.col("p_partkey") * 86400
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.file_of_id(i).alias("file"), text.caller_of_site(i).alias("caller"), text.rel_kind(F.concat(F.lit("Calls_"), ext)).alias("kind"),
        text.community_number(F.concat(F.lit("community::louvain::1::"), key)).alias("community"), text.community_number(F.col("p_brand")).alias("no_community"), text.language(path).alias("language"),
        text.claim_token(F.concat("p_brand", F.lit(":"), "p_name")).alias("token"), text.safe_id(F.concat(F.when(size % 4 == 3, "../").otherwise(""), key)).alias("is_safe_id"), text.safe_path(F.concat(F.lit("/a/"), F.when(even, "x").otherwise("../x"))).alias("is_safe_path"),
        text.iso_time(seconds).alias("iso"), text.compact_time(seconds).alias("compact"), text.percent_encoded(F.concat(F.lit("a b/"), "p_brand")).alias("encoded"),
        text.visibility("go", F.when(even, "Up").otherwise("low")).alias("go_visibility"), text.visibility("python", F.when(even, "_x").otherwise("__init__")).alias("python_visibility"), text.is_constant_name(F.when(even, "MAX_1").otherwise("Max")).alias("is_constant"),
        text.strip_first_folder(F.concat(path, F.lit("::f"), key)).alias("stripped"), text.hunk_start(F.concat(F.lit("@@ -1,2 +"), key, F.lit(",3 @@ x"))).alias("hunk"),
    )


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library file and a user file for each brand, that resolve against each other."""
    joined = lambda *parts: F.concat(*[_key() if p == "#" else F.col("p_size").cast("string") if p == "%" else F.lit(p) for p in parts])
    library = joined("pub struct S", "#", " {}\npub trait T", "#", " { fn m", "#", "(&self); }\nimpl S", "#", " { pub fn m", "#", "(&self) { g", "#", "(); } }\npub fn g", "#", "() {}\npub struct Q", "%", " {}")
    user = joined("use crate::S", "#", ";\nuse crate::Q", "%", ";\nfn u", "#", "() { S", "#", "::m", "#", "(); none", "#", "(); }")
    there = _files(spark, sf_dir, "rust", ".rs", library)
    return there.unionByName(_files(spark, sf_dir, "rust", "_user.rs", user))


LIB, USER = PATH.format("rs"), "'src/' || replace(p_brand, '#', '_') || '_user.rs'"
FOUND = f"""
SELECT 'Calls_Method_Function' AS rel, {LIB} || '::S' || p_partkey || '::m' || p_partkey AS from_id, {LIB} || '::g' || p_partkey AS to_id, 0.9::DOUBLE AS confidence FROM part
UNION ALL SELECT 'Calls_Function_Method', {USER} || '::u' || p_partkey, {LIB} || '::S' || p_partkey || '::m' || p_partkey, 1.0 FROM part
UNION ALL SELECT 'Implements_Struct_Trait', {LIB} || '::S' || p_partkey, {LIB} || '::T' || p_partkey, 0.7 FROM part
UNION ALL SELECT 'Imports_File_Struct', {USER}, {LIB} || '::S' || p_partkey, 1.0 FROM part"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    graph, parsed = index.run(_code(spark, sf_dir), strict=True)
    refs = parsed.where("record = 'ref'").select("kind", "from_qualified_name", "to_qualified_name")
    done, stats, missing = resolve.run(graph, "rust", refs)
    return done.edges.where("confidence is not null"), stats, missing


@query(FOUND)
def resolve_calls_and_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in a file, by a qualified name and by import; methods that a trait shares; imports of one candidate."""
    return _resolved(spark, sf_dir)[0].where("not contains(to_id, '::Q')").select("rel", "from_id", "to_id", "confidence")


@query(f"SELECT {USER} AS file, 'Q' || p_size AS name, CASE WHEN n = 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT DISTINCT p_brand, p_size FROM part) JOIN (SELECT p_size, count(DISTINCT p_brand) AS n FROM part GROUP BY p_size) USING (p_size)")
def import_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of names that several files have are less certain."""
    found = resolve.imports(index.run(_code(spark, sf_dir), strict=True)[0])[0].where("contains(to_id, '::Q')")
    return found.select(F.col("from_id").alias("file"), text.leaf(F.col("to_id")).alias("name"), "confidence").distinct()


@query("SELECT kind, (CASE kind WHEN 'Calls' THEN 2 * n WHEN 'Imports' THEN n + q ELSE n END)::BIGINT AS resolved, (CASE kind WHEN 'Calls' THEN 2 * n WHEN 'Imports' THEN n + q ELSE n END)::BIGINT AS edges FROM (SELECT count(*) AS n, count(DISTINCT (p_brand, p_size)) AS q FROM part), (SELECT unnest(['Calls', 'Imports', 'Implements']) AS kind)")
def resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[1].select("kind", "resolved", "edges")


@query(f"SELECT {USER} || '::u' || p_partkey AS caller, 'no candidate' AS reason FROM part")
def unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)[2].select(text.caller_of_site(F.col("id")).alias("caller"), "reason")


@query("SELECT l.p_partkey AS a, r.p_partkey AS b FROM part l JOIN part r ON l.p_brand = r.p_brand AND l.p_name = r.p_name")
def label_by_qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join by name on names made of brand and name, both ways."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("::", "p_brand", "p_name").alias("name"))
    return joins.by_name(part.select(F.col("p_partkey").alias("a"), "name"), "name", part.select(F.col("p_partkey").alias("b"), "name")).select("a", "b")


# The tools, on a tree of two files that is written for them.

MAIN = "fn main() { helper(); }\npub fn do_run() { helper(); }\n"
MODELS = "pub struct Config { pub child: Inner }\npub struct Inner {}\npub fn helper() {}\n"
DIFF = "diff --git a/src/models.rs b/src/models.rs\n--- a/src/models.rs\n+++ b/src/models.rs\n@@ -3,1 +3,1 @@\n-pub fn helper() {}\n+pub fn helper() { }\n"
EXPECTED = [
    ("health_check", "tools_count", 23), ("extract_finding", "status", "ok"), ("refine_finding", "status", "ok"), ("start_verification", "state", "open"), ("append_clarification", "state", "waiting_for_user"), ("append_clarification", "state", "waiting_for_agent"),
    ("finalize_verification", "verified", True), ("start_verification", "state", "open"), ("abort_verification", "state", "aborted"), ("abort_verification", "reason", "already_aborted"),
    ("index_codebase", "files_indexed", 2), ("lsp_resolve", "resolved_count", 1), ("resolve_graph", "calls_resolved", 2), ("resolve_graph", "uses_resolved", 1), ("resolve_graph", "unresolved_count", 0), ("cluster_graph", "process_count", 3),
    ("query_graph", "rows", [["do_run"], ["main"]]), ("query_graph", "reason", "read_only_query_required"), ("get_symbol", "status", "ok"), ("get_processes", "process_count", 3), ("get_impact", "processes_affected", 3), ("search_codebase", "first", "src/main.rs::do_run"),
    ("get_context", "calls_in", ["src/main.rs::do_run", "src/main.rs::main"]), ("detect_changes", "symbols_affected_count", 1), ("detect_changes", "processes_affected_count", 3), ("prepare_prd_input", "matched_symbol_count", 1),
    ("validate_prd_against_graph", "validation_status", "fail"), ("check_security_gates", "gates_passed", True), ("verify_semantic_diff", "regression_score", 0.0), ("analyze_codebase", "status", "ok"),
]


def _said(value: Any) -> str:
    return json.dumps(value, sort_keys=True)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{tool}', '{field}', '{_said(value)}')" for i, (tool, field, value) in enumerate(EXPECTED)) + ") v(step, tool, field, value)")
def tools_on_a_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tool once, in the order of a session's work; the value of one field of each answer. Needs a folder that the driver can write to."""
    base = f"{storage.scratch(spark).removeprefix('file://')}/tesselar-tools-{uuid.uuid4().hex}"
    os.makedirs(f"{base}/code/src")
    for name, content in (("code/src/main.rs", MAIN), ("code/src/models.rs", MODELS)):
        with open(f"{base}/{name}", "w", encoding="utf-8") as f:
            f.write(content)
    with open(f"{base}/prd.md", "w", encoding="utf-8") as f:
        f.write("change `helper`")
    with open(f"{base}/prd.affected_symbols.json", "w", encoding="utf-8") as f:
        json.dump({"affected_symbols": [{"qualified_name": "nope", "change_kind": "modify"}]}, f)
    spark.createDataFrame([("src/main.rs", 1, col, "src/models.rs", 3) for col in (12, 13)], "file string, line long, col long, target_file string, target_line long").write.parquet(f"{base}/definitions")
    out, graph = f"{base}/out", f"{base}/out/graph"
    one, two = ({"run_id": "r", "finding_id": i, "output_dir": out} for i in ("f", "g"))
    asked: list[dict] = [{}, {"finding": {"id": "f", "title": "helper", "relevance_category": "c"}, "output_dir": out, "run_id": "r"}, one | {"refined_prompt": "x", "refinement": {"a": 1}}, one, one | {"kind": "agent_question", "content": "q"}, one | {"kind": "user_answer", "content": "a"}, one]
    asked += [two, two, two, {"path": f"{base}/code", "output_dir": out}, {"graph_path": graph, "codebase_path": f"{base}/code", "definitions_path": f"{base}/definitions"}, *[{"graph_path": graph}] * 4, {"graph_path": graph, "query": "MATCH (f:Function)-[:Calls]->(g:Function) RETURN f.name ORDER BY f.name"}, {"graph_path": graph, "query": "MATCH (n) DELETE n"}]
    helper = {"graph_path": graph, "qualified_name": "src/models.rs::helper"}
    asked += [helper, {"graph_path": graph}, helper, {"graph_path": graph, "query": "do run"}, helper, *[{"graph_path": graph, "diff_text": DIFF}] * 2, one | {"graph_path": graph}]
    asked += [{"prd_path": f"{base}/prd.md", "graph_path": graph}, {"graph_path": graph, "changed_symbols": ["src/models.rs::helper"]}, {"before_graph_path": graph, "after_graph_path": graph}, {"path": f"{base}/code", "output_dir": f"{base}/again"}]
    told, last = [], (None, None, {})
    for step, ((tool, field, _), arguments) in enumerate(zip(EXPECTED, asked, strict=True)):
        if step == 7:
            tools.call(spark, "extract_finding", {"finding": {"id": "g", "title": "t", "relevance_category": "c"}, "output_dir": out, "run_id": "r"})
            tools.call(spark, "refine_finding", two | {"refined_prompt": "x", "refinement": {"a": 1}})
        answer = last[2] if (tool, arguments) == last[:2] and tool in ("resolve_graph", "detect_changes") else tools.call(spark, tool, arguments)
        last = (tool, arguments, answer)
        if field == "first":
            value = answer["results"][0]["qualified_name"]
        elif field == "calls_in":
            value = sorted(r["qualified_name"] for r in answer["relationships"]["called_by"])
        else:
            value = answer.get(field)
        told.append((step, tool, field, _said(value)))
    return spark.createDataFrame(told, "step int, tool string, field string, value string")
