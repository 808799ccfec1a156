"""The named tools: arguments checked against a contract, a dictionary back."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from hashlib import sha256
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import schema
from tesselar.functions import text
from tesselar.graph import PropertyGraph, _rank
from tesselar.operators import changes, cluster, flows, index, resolve, search, semdiff, sessions, validate
from tesselar.operators.storage import cut
from tesselar.plans.cypher import CypherError, compile_query
from tesselar.sources import documents, files

VERSION = "0.1.0"
RESULT_ROWS = 10_000  # the most rows that a tool returns; more are counted
SAFE_ID = re.compile(r"(?!\.)(?!.*\.\.)[A-Za-z0-9._-]{1,128}\Z")


class ToolError(Exception):
    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


@dataclass(frozen=True)
class Tool:
    run: Callable[..., dict]
    stage: str
    required: tuple[str, ...]
    optional: tuple[str, ...]


TOOLS: dict[str, Tool] = {}


def tool(stage: str, required: str = "", optional: str = "") -> Callable:
    def add(f: Callable) -> Callable:
        TOOLS[f.__name__] = Tool(f, stage, tuple(required.split()), tuple(optional.split()))
        return f

    return add


def call(spark: SparkSession, name: str, arguments: dict[str, Any] | None = None) -> dict[str, Any]:
    """Runs a tool. Errors come back with a reason and a message."""
    arguments = arguments or {}
    if name not in TOOLS:
        return {"status": "error", "stage": "dispatch", "reason": "unknown_tool", "message": f"there is no tool {name}"}
    t = TOOLS[name]
    try:
        for a in t.required:
            if arguments.get(a) in (None, ""):
                raise ToolError("missing_argument", f"{name} needs {a}")
        for a in arguments:
            if a not in t.required + t.optional:
                raise ToolError("unknown_argument", f"{name} has no argument {a}")
        for a in ("run_id", "finding_id"):
            if arguments.get(a) is not None and not SAFE_ID.match(str(arguments[a])):
                raise ToolError("unsafe_id", f"{a} holds more than letters, digits and . _ -")
        for a in ("path", "output_dir", "graph_path", "before_graph_path", "after_graph_path", "prd_path", "codebase_path", "report_path"):
            p = arguments.get(a)
            if p is not None and (not os.path.isabs(p) or ".." in p.split("/")):
                raise ToolError("unsafe_path", f"{a} must be absolute, without ..")
        return {"status": "ok", "stage": t.stage} | t.run(spark, **arguments)
    except (ToolError, CypherError, documents.FindingError) as e:
        near = {"did_you_mean": e.near} if isinstance(e, _NotFound) else {}
        return {"status": "error", "stage": t.stage, "reason": e.reason, "message": str(e)} | near
    except files.LimitError as e:
        return {"status": "error", "stage": t.stage, "reason": "limit_exceeded", "message": str(e)}


KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}
IDS = {"type": "string", "pattern": "^" + SAFE_ID.pattern.removesuffix(r"\Z") + "$"}
CHOICES = {"method": ["sequential", "rounds"], "kind": ["agent_question", "user_answer"]}


def _schema(name: str, hint: Any) -> dict[str, Any]:
    """The JSON schema of one argument, from its type."""
    if name in ("run_id", "finding_id"):
        return IDS
    parts = [x for x in (get_args(hint) or (hint,)) if x is not type(None)] if get_origin(hint) is not list else [hint]
    kinds = [KINDS[get_origin(x) or x] for x in parts if (get_origin(x) or x) in KINDS]
    out: dict[str, Any] = {"type": kinds[0] if len(kinds) == 1 else kinds} if kinds else {}
    if get_origin(hint) is list:
        out["items"] = {"type": KINDS[get_args(hint)[0]]}
    if name in CHOICES:
        out["enum"] = CHOICES[name]
    if name.endswith("path") and out.get("type") == "string":
        out["pattern"] = "^/"
    return out


def describe() -> list[dict[str, Any]]:
    """Each tool's name and the JSON schema of its arguments."""
    out = []
    for n, t in TOOLS.items():
        hints = get_type_hints(t.run)
        out.append({"name": n, "inputSchema": {"type": "object", "properties": {a: _schema(a, hints.get(a)) for a in t.required + t.optional}, "required": list(t.required), "additionalProperties": False}})
    return out


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _rows(df: DataFrame, n: int = RESULT_ROWS) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


def _listed(names: DataFrame) -> tuple[list[str], int]:
    """The first of the different names, and how many there are in all."""
    known = cut(names.where("name is not null").distinct())
    return [r["name"] for r in _rows(known.orderBy("name"))], known.count()


def _tally(df: DataFrame) -> dict[str, int]:
    """Rows by severity, of all rows; only listings are limited."""
    return {r["severity"]: r["n"] for r in df.groupBy("severity").agg(F.count("*").alias("n")).collect()}


def _added(*tallies: dict[str, int]) -> dict[str, int]:
    return {s: sum(t.get(s, 0) for t in tallies) for s in validate.SEVERITIES}


def _graph(spark: SparkSession, path: str) -> PropertyGraph:
    if not os.path.isdir(f"{path}/nodes"):
        raise ToolError("graph_not_found", f"there is no graph at {path}")
    return PropertyGraph.read(spark, path)


def _run_dir(output_dir: str, run_id: str, finding_id: str) -> str:
    return os.path.join(output_dir, "runs", run_id, "findings", finding_id)


# Findings and sessions: one small document each, on the driver.


@tool("health")
def health_check(spark: SparkSession) -> dict:
    return {"server": "tesselar", "version": VERSION, "stages_registered": sorted({t.stage for t in TOOLS.values()}), "tools_count": len(TOOLS)}


def _upsert(output_dir: str, run_id: str, finding_id: str, entry: dict, mode: str) -> None:
    path = os.path.join(output_dir, "runs", run_id, "index.json")
    now = _now()
    whole = documents.read_json(path) or {"run_id": run_id, "started_at": now, "findings": {}}
    old = whole["findings"].get(finding_id)
    new = dict.fromkeys(sessions.INDEX_COLUMNS) | entry
    if old:
        kept = list(sessions.KEPT[mode])
        if mode == "preserve_downstream" and old.get("refined_at"):
            kept.append("artifact_path")
        new |= {c: old.get(c) for c in kept}
    whole["findings"][finding_id], whole["last_updated_at"] = new, now
    documents.write_json(path, whole)


@tool("stage-1a", "finding output_dir", "run_id")
def extract_finding(spark: SparkSession, finding: dict | str, output_dir: str, run_id: str | None = None) -> dict:
    found = documents.load_finding(finding)
    if not SAFE_ID.match(str(found["id"])):
        raise ToolError("unsafe_id", "the finding's id holds more than letters, digits and . _ -")
    if run_id is None:
        run_id = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{sha256(os.urandom(16)).hexdigest()[:6]}"
    path = os.path.join(_run_dir(output_dir, run_id, found["id"]), "stage-1.extracted.json")
    size = documents.write_json(path, found | {"extracted_at": _now(), "extractor_version": VERSION})
    _upsert(output_dir, run_id, found["id"], {"artifact_path": path, "extractor_version": VERSION}, "preserve_downstream")
    return {"finding_id": found["id"], "artifact_path": path, "run_id": run_id, "bytes_written": size, "extractor_version": VERSION}


@tool("stage-1b", "run_id finding_id output_dir refined_prompt refinement")
def refine_finding(spark: SparkSession, run_id: str, finding_id: str, output_dir: str, refined_prompt: str, refinement: dict) -> dict:
    base = _run_dir(output_dir, run_id, finding_id)
    source = documents.read_json(os.path.join(base, "stage-1.extracted.json"))
    if source is None:
        raise ToolError("extracted_artifact_missing", "extract the finding first")
    if not refined_prompt.strip():
        raise ToolError("empty_refined_prompt", "the refined prompt is empty")
    path, now = os.path.join(base, "stage-1.refined.json"), _now()
    size = documents.write_json(path, source | {"refined_prompt": refined_prompt, "refinement": refinement, "refined_at": now})
    _upsert(output_dir, run_id, finding_id, {"artifact_path": path, "extractor_version": source.get("extractor_version"), "orchestrator_version": VERSION, "refined_at": now}, "preserve_stage2")
    return {"finding_id": finding_id, "artifact_path": path, "run_id": run_id, "bytes_written": size, "orchestrator_version": VERSION, "orchestrator_contract_version": VERSION}


def _session(output_dir: str, run_id: str, finding_id: str) -> tuple[str, dict | None]:
    path = os.path.join(_run_dir(output_dir, run_id, finding_id), "stage-2.session.json")
    return path, documents.read_json(path)


def _move(session: dict | None, event: str) -> str:
    if session is None and event != "start":
        raise ToolError("session_missing", "start the verification first")
    state, why = sessions.next_state(session["state"] if session else sessions.NONE, event)
    if why:
        raise ToolError(why, f"{event} is refused in this state")
    return state


@tool("stage-2", "run_id finding_id output_dir")
def start_verification(spark: SparkSession, run_id: str, finding_id: str, output_dir: str) -> dict:
    if not os.path.exists(os.path.join(_run_dir(output_dir, run_id, finding_id), "stage-1.refined.json")):
        raise ToolError("refined_artifact_missing", "refine the finding first")
    path, old = _session(output_dir, run_id, finding_id)
    state, now = _move(old, "start"), _now()
    documents.write_json(path, {"run_id": run_id, "finding_id": finding_id, "state": state, "turn_count": 0, "started_at": now, "updated_at": now, "transcript": []})
    return {"state": state, "started_at": now, "session_path": path}


@tool("stage-2", "run_id finding_id output_dir kind content", "meta")
def append_clarification(spark: SparkSession, run_id: str, finding_id: str, output_dir: str, kind: str, content: str, meta: Any = None) -> dict:
    if kind not in sessions.TURNS:
        raise ToolError("invalid_kind", f"kind is one of {', '.join(sessions.TURNS)}")
    path, s = _session(output_dir, run_id, finding_id)
    s = (s or {}) | {"state": _move(s, kind)}
    seq = len(s["transcript"]) + 1
    s["transcript"].append({"seq": seq, "kind": kind, "timestamp": _now(), "content": content} | ({"meta": meta} if meta is not None else {}))
    s |= {"turn_count": seq, "updated_at": _now()}
    documents.write_json(path, s)
    return {"state": s["state"], "seq": seq, "turn_count": seq}


@tool("stage-2", "run_id finding_id output_dir")
def finalize_verification(spark: SparkSession, run_id: str, finding_id: str, output_dir: str) -> dict:
    path, s = _session(output_dir, run_id, finding_id)
    state, now = _move(s, "finalize"), _now()
    raw = json.dumps(s["transcript"], separators=(",", ":"), ensure_ascii=False).encode()
    kinds = {t["kind"] for t in s["transcript"]}
    checklist = {"at_least_one_agent_question": sessions.TURNS[0] in kinds, "at_least_one_user_answer": sessions.TURNS[1] in kinds}
    kind = {"schema_ok": True, "completeness_ok": all(checklist.values()), "user_acknowledged": True}
    verified = os.path.join(os.path.dirname(path), "stage-2.verified.json")
    receipt = {"verified": all(kind.values()), "verified_kind": kind, "finalized_at": now, "session_path": path, "transcript_digest": sha256(raw).hexdigest(), "digest_algorithm": "sha256", "transcript_bytes_at_finalize": len(raw), "turn_count": s["turn_count"], "verifier_version": VERSION, "completeness_checklist": checklist}
    documents.write_json(path, s | {"state": state, "updated_at": now})
    documents.write_json(verified, receipt)
    _upsert(output_dir, run_id, finding_id, {"verified_at": now, "verified": receipt["verified"], "stage2_path": verified}, "preserve_refined_only")
    return {k: receipt[k] for k in ("verified", "verified_kind", "transcript_digest", "turn_count")} | {"verified_path": verified}


@tool("stage-2", "run_id finding_id output_dir", "reason")
def abort_verification(spark: SparkSession, run_id: str, finding_id: str, output_dir: str, reason: str = "") -> dict:
    path, s = _session(output_dir, run_id, finding_id)
    state, now = _move(s, "abort"), _now()
    documents.write_json(path, s | {"state": state, "aborted_at": now, "abort_reason": reason, "updated_at": now})
    return {"state": state, "aborted_at": now, "turn_count": s["turn_count"]}


# The graph.


@tool("stage-3a", "path output_dir", "language")
def index_codebase(spark: SparkSession, path: str, output_dir: str, language: str = "auto") -> dict:
    began = time.monotonic()
    target = os.path.join(output_dir, "graph")
    if os.path.exists(target) and not os.path.isdir(f"{target}/nodes"):
        raise ToolError("not_a_graph", f"{target} exists and is no graph; it isn't replaced")
    tree = files.read_tree(spark, path, language)
    graph, parsed = index.run(tree)
    shutil.rmtree(f"{target}/search", ignore_errors=True)  # of the graph before
    graph.write(target)
    parsed.write.mode("overwrite").parquet(f"{target}/parsed")
    kept = _graph(spark, target)
    return {"graph_path": target, "node_count": kept.nodes.count(), "edge_count": kept.edges.count(), "files_indexed": kept.scan("File").count(), "elapsed_ms": int(1000 * (time.monotonic() - began))}


@tool("stage-3a", "graph_path query")
def query_graph(spark: SparkSession, graph_path: str, query: str) -> dict:
    began = time.monotonic()
    df = compile_query(_graph(spark, graph_path), query)
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(RESULT_ROWS).collect()]
    return {"columns": df.columns, "rows": rows, "result": "\n".join(" | ".join(r) for r in rows), "elapsed_ms": int(1000 * (time.monotonic() - began))}


def _resolved(graph: PropertyGraph, name: str) -> dict:
    found = _rows(search.resolve_name(graph.scan(*schema.LABELS), name, _rank("label", schema.SEARCHABLE)))
    if not found or found[0]["how"] == "suggestion":
        raise _NotFound([r["qualified_name"] or r["id"] for r in found])
    return found[0]


class _NotFound(ToolError):
    def __init__(self, near: list[str]):
        super().__init__("symbol_not_found", f"no such symbol; did you mean {', '.join(near)}?" if near else "no such symbol")
        self.near = near


@tool("stage-3a", "graph_path qualified_name")
def get_symbol(spark: SparkSession, graph_path: str, qualified_name: str) -> dict:
    g = _graph(spark, graph_path)
    hit = _resolved(g, qualified_name)
    node = _rows(g.nodes.where(F.col("id") == hit["id"]), 1)[0]
    out = _rows(g.edges.where(F.col("from_id") == hit["id"]).select("rel", F.col("to_id").alias("target")).orderBy("rel", "target"))
    into = _rows(g.edges.where(F.col("to_id") == hit["id"]).select("rel", F.col("from_id").alias("source")).orderBy("rel", "source"))
    return {"node": {"label": node["label"], "data": {k: v for k, v in node.items() if v is not None}}, "edges_out": out, "edges_in": into}


def _save(spark: SparkSession, graph: PropertyGraph, path: str) -> None:
    """Writes a graph that is read from the same place: first beside it, then in its stead."""
    graph.write(f"{path}.next")
    for part in ("nodes", "edges"):
        old, new = f"{path}/{part}", f"{path}.next/{part}"
        os.replace(old, f"{path}.old-{part}")
        os.replace(new, old)
        shutil.rmtree(f"{path}.old-{part}")
    shutil.rmtree(f"{path}.next", ignore_errors=True)
    spark.catalog.refreshByPath(path)


def _language(g: PropertyGraph) -> str:
    """The language of most of the graph's files; of as many, the first by name."""
    most = g.scan("File").where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").first()  # ten languages at most
    return most["language"] if most else "rust"


@tool("stage-3b", "graph_path", "language")
def resolve_graph(spark: SparkSession, graph_path: str, language: str = "auto") -> dict:
    g = _graph(spark, graph_path)
    if language == "auto":
        language = _language(g)
    refs = spark.read.parquet(f"{graph_path}/parsed").where("record = 'ref'").select("kind", "from_qualified_name", "to_qualified_name")
    done, stats, missing = resolve.run(g, language, refs)
    counts = {r["kind"].lower(): r["resolved"] for r in stats.collect()}  # a row for each kind
    asked, unresolved = g.nodes.where(F.col("label").isin("Import", "CallSite", "Field")).count(), missing.count()
    _save(spark, done, graph_path)
    total = sum(counts.values())
    named = {"imports": "imports", "calls": "calls", "implements": "implements", "extends": "extends", "uses": "uses"}
    return {f"{v}_resolved": counts.get(k, 0) for k, v in named.items()} | {"total_edges": total, "total_refs": asked, "resolution_rate": f"{total / max(asked, 1):.2f}", "unresolved_count": unresolved}


@tool("stage-3b", "graph_path codebase_path", "language lsp_command timeout_ms definitions_path")
def lsp_resolve(spark: SparkSession, graph_path: str, codebase_path: str, language: str = "rust", lsp_command: str = "", timeout_ms: int = 30_000, definitions_path: str = "") -> dict:
    """Definitions come as a table (file, line, col, target_file, target_line) that a language server has filled."""
    if lsp_command and os.path.basename(lsp_command) not in ("rust-analyzer", "pyright-langserver", "typescript-language-server", "gopls"):
        raise ToolError("lsp_command_not_allowed", f"{lsp_command} isn't a known language server")
    if not definitions_path:
        raise ToolError("lsp_not_found", "no language server runs here; give definitions_path")
    g = _graph(spark, graph_path)
    fresh = resolve.first_phase(resolve.from_definitions(g, spark.read.parquet(definitions_path)), g.edges).drop("phase")
    n = fresh.count()
    sites = g.scan("CallSite").count()
    _save(spark, g.add_edges(fresh), graph_path)
    return {"resolved_count": n, "failed_count": 0, "skipped_count": sites - n}


def _calls(g: PropertyGraph) -> DataFrame:
    return g.of_kind("Calls").where(F.col("to_label").isin("Function", "Method")).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))


@tool("stage-3c", "graph_path", "resolution_param method")
def cluster_graph(spark: SparkSession, graph_path: str, resolution_param: float = 1.0, method: str = "sequential") -> dict:
    if method not in ("sequential", "rounds"):
        raise ToolError("invalid_method", f"{method} is neither sequential nor rounds")
    g = _graph(spark, graph_path)
    g = PropertyGraph(g.nodes.where(~F.col("label").isin("Community", "Process")), g.edges.where(~F.col("kind").isin("MemberOf", "EntryPointOf", "ParticipatesIn")))
    nodes = g.scan(*schema.SEARCHABLE).select("label", "id")
    adjacent = cluster.projection(nodes, g.edges)
    parts = cluster.repaired(cluster.louvain(nodes, adjacent, resolution_param, method), adjacent)
    q = cluster.modularity(parts, adjacent, resolution_param).first()
    rows, member = cluster.communities(parts, resolution_param)
    labels = nodes.select("id", F.col("label").alias("l"))
    member_edges = member.join(labels, "id").select(F.concat(F.lit("MemberOf_"), "l", F.lit("_Community")).alias("rel"), F.lit("MemberOf").alias("kind"), F.col("l").alias("from_label"), F.col("id").alias("from_id"), F.lit("Community").alias("to_label"), F.col("community_id").alias("to_id"))
    entries = flows.entry_points(g.scan("Function").select("id", "name", "qualified_name", "visibility"))
    processes, takes = flows.processes(entries, _calls(g))
    starts = entries.select(F.lit("EntryPointOf_Function_Process").alias("rel"), F.lit("EntryPointOf").alias("kind"), F.lit("Function").alias("from_label"), F.col("id").alias("from_id"), F.lit("Process").alias("to_label"), F.concat(F.lit("process::"), "qualified_name").alias("to_id"), "confidence")
    parts_of = takes.join(labels, "id").select(F.concat(F.lit("ParticipatesIn_"), "l", F.lit("_Process")).alias("rel"), F.lit("ParticipatesIn").alias("kind"), F.col("l").alias("from_label"), F.col("id").alias("from_id"), F.lit("Process").alias("to_label"), F.col("process").alias("to_id"), "depth")
    out = g.add_nodes(rows.withColumn("label", F.lit("Community")).withColumn("modularity_contribution", F.lit(q["modularity_adjacent"]))).add_nodes(processes.withColumn("label", F.lit("Process")).withColumn("name", F.col("id")))
    for e in (member_edges, starts, parts_of):
        out = PropertyGraph(out.nodes, out.edges.unionByName(e, allowMissingColumns=True))
    _save(spark, out, graph_path)
    kept = _graph(spark, graph_path)
    listing = kept.of_kind("MemberOf").select(F.col("from_id").alias("qn"), F.col("to_id").alias("community_id"), text.community_number(F.col("to_id")).alias("cluster_id")).orderBy("qn", "community_id")
    total = listing.count()
    return {"community_count": kept.scan("Community").count(), "modularity": q["modularity"], "modularity_adjacent": q["modularity_adjacent"], "process_count": kept.scan("Process").count(), "clusters": _rows(listing), "total_memberships": total, "clusters_truncated_at": RESULT_ROWS if total > RESULT_ROWS else None}


@tool("stage-3c", "graph_path")
def get_processes(spark: SparkSession, graph_path: str) -> dict:
    p = _graph(spark, graph_path).scan("Process").select("name", "entry_point_id", "entry_kind", "entry_confidence", "depth", "symbol_count").orderBy("name")
    return {"process_count": p.count(), "processes": _rows(p)}


def _memberships(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    return g.of_kind("MemberOf").select(F.col("from_id").alias("id"), F.col("to_id").alias("community_id")), g.of_kind("ParticipatesIn").select(F.col("from_id").alias("id"), F.col("to_id").alias("process"))


@tool("stage-3c", "graph_path qualified_name")
def get_impact(spark: SparkSession, graph_path: str, qualified_name: str) -> dict:
    g = _graph(spark, graph_path)
    rows = _rows(flows.impact(_resolved(g, qualified_name)["id"], *_memberships(g)).orderBy("what", "name"))
    communities, processes = [r["name"] for r in rows if r["what"] == "community"], [r["name"] for r in rows if r["what"] == "process"]
    return {"communities": communities, "communities_affected": len(communities), "processes": processes, "processes_affected": len(processes)}


def _boosts(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    member, takes = _memberships(g)
    sizes = member.groupBy("community_id").agg(F.count("*").alias("size"))
    return member.join(sizes, "community_id").select(F.col("id").alias("key"), F.col("community_id").alias("community"), "size"), takes.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("processes"))


def _search_index(spark: SparkSession, docs: DataFrame, graph_path: str) -> search.SearchIndex:
    """The graph's index, which the first search builds and writes; later ones only read it."""
    path = f"{graph_path}/search"
    if not os.path.isdir(f"{path}/norms"):
        search.SearchIndex.build(docs, "id").write(path)
    return search.SearchIndex.read(spark, path)


@tool("stage-3d", "graph_path query", "limit label_filter")
def search_codebase(spark: SparkSession, graph_path: str, query: str, limit: int = 20, label_filter: str | None = None) -> dict:
    g = _graph(spark, graph_path)
    docs = g.scan(*schema.SEARCHABLE).select("id", "label", "name", "qualified_name", "file", "start_line", "end_line")
    hits = search.hybrid(docs, query, limit, *_boosts(g), min_score=0.01, key="id", label=label_filter, built=_search_index(spark, docs, graph_path))
    rows = _rows(hits.join(docs.withColumnRenamed("id", "key"), "key").orderBy(F.desc("score"), "key"), limit)
    return {"results": [r | {"score": f"{r['score']:.4f}"} for r in rows], "result_count": len(rows)}


# What the ends of these kinds of edges are to each other, from the start and from the end.
RELATIONS = {"Calls": ("calls", "called_by"), "Imports": ("imports", "imported_by"), "Implements": ("implements", "implemented_by"), "Uses": ("uses", "used_by")}


def _neighbours(g: PropertyGraph, i: str) -> DataFrame:
    """relation, name, qualified_name, kind: the other ends of a node's edges of RELATIONS, but not the library's symbols."""
    edges = g.of_kind(*RELATIONS).where((F.col("from_id") == i) | (F.col("to_id") == i))
    named = lambda way: F.coalesce(*[F.when(F.col("kind") == k, pair[way]) for k, pair in RELATIONS.items()])
    out = edges.where(F.col("from_id") == i).select(named(0).alias("relation"), F.col("to_id").alias("id"))
    into = edges.where(F.col("to_id") == i).select(named(1).alias("relation"), F.col("from_id").alias("id"))
    nodes = g.nodes.where(F.col("label") != "StdlibSymbol").select("id", "name", F.coalesce("qualified_name", "id").alias("qualified_name"), F.col("label").alias("kind"))
    return out.unionByName(into).distinct().join(nodes, "id").drop("id")


@tool("stage-3d", "graph_path qualified_name")
def get_context(spark: SparkSession, graph_path: str, qualified_name: str) -> dict:
    g = _graph(spark, graph_path)
    hit = _resolved(g, qualified_name)
    node = _rows(g.nodes.where(F.col("id") == hit["id"]), 1)[0]
    near = cut(_neighbours(g, hit["id"]))
    counts = {r["relation"]: r["n"] for r in near.groupBy("relation").agg(F.count("*").alias("n")).collect()}  # eight rows at most
    related: dict[str, list] = {r: [] for pair in RELATIONS.values() for r in pair}
    for r in _rows(near.orderBy("relation", "qualified_name")):
        related[r.pop("relation")].append(r)
    member, takes = _memberships(g)
    impact = _rows(flows.impact(hit["id"], member, takes))
    communities = _rows(member.where(F.col("id") == hit["id"]).select("community_id").join(member.withColumnRenamed("id", "m"), "community_id").groupBy("community_id").agg(F.count("*").alias("member_count")).orderBy("community_id"), 1)
    community = next(({"id": c["community_id"], "name": c["community_id"], "member_count": c["member_count"]} for c in communities), None)
    starts = {r["to_id"] for r in _rows(g.of_kind("EntryPointOf").where(F.col("from_id") == hit["id"]).select("to_id"))}
    processes = [{"name": r["name"], "role": "entry_point" if r["name"] in starts else "participant"} for r in impact if r["what"] == "process"]
    symbol = {"qualified_name": hit["id"], "name": node["name"], "kind": node["label"], "file_path": node["file"]} | {c: node.get(c) for c in ("start_line", "end_line", "visibility")}
    return {"symbol": symbol, "relationships": related, "relationship_counts": counts, "community": community, "processes": sorted(processes, key=lambda p: p["name"])}


@tool("analyze", "path output_dir", "language resolution_param lsp")
def analyze_codebase(spark: SparkSession, path: str, output_dir: str, language: str = "auto", resolution_param: float = 1.0, lsp: bool = False) -> dict:
    began = time.monotonic()
    first = index_codebase(spark, path, output_dir, language)
    graph_path = first["graph_path"]
    second, third = resolve_graph(spark, graph_path), cluster_graph(spark, graph_path, resolution_param)
    docs = _graph(spark, graph_path).scan(*schema.SEARCHABLE).select("id", "label", "name", "qualified_name")
    _search_index(spark, docs, graph_path)
    return {"index": first, "resolve": second, "cluster": {k: v for k, v in third.items() if k != "clusters"}, "search_index": {"documents": docs.count()}, "lsp_resolve": None, "total_elapsed_ms": int(1000 * (time.monotonic() - began))}


# Changes and checks.


@tool("stage-5", "graph_path", "diff_text codebase_path base_ref head_ref")
def detect_changes(spark: SparkSession, graph_path: str, diff_text: str | None = None, codebase_path: str | None = None, base_ref: str = "HEAD~1", head_ref: str = "HEAD") -> dict:
    if diff_text is None and codebase_path is None:
        raise ToolError("missing_argument", "detect_changes needs diff_text or codebase_path")
    try:
        diffs = spark.createDataFrame([("given", diff_text)], "diff_id string, text string") if diff_text is not None else changes.git_diff(spark, codebase_path, base_ref, head_ref)
    except ValueError as e:
        raise ToolError("unsafe_ref", str(e)) from e
    g = _graph(spark, graph_path)
    parsed = changes.parse_diff(diffs)
    hit = changes.touched(parsed, changes.symbols_of(g))
    member, takes = _memberships(g)
    per = takes.groupBy("id").agg(F.count("*").alias("processes"), F.collect_set("process").alias("names"))
    joined = hit.withColumnRenamed("key", "id").join(member, "id", "left").join(per, "id", "left").select("id", "lines", F.col("community_id").alias("community"), F.coalesce("processes", F.lit(0)).alias("processes"), "names")
    joined = cut(joined)
    rows = _rows(joined.select("id", "lines").distinct().orderBy("id"))
    n_symbols = joined.select("id").distinct().count()
    communities, n_communities = _listed(joined.select(F.col("community").alias("name")))
    processes, n_processes = _listed(joined.select(F.explode("names").alias("name")))
    risk = changes.risk(joined.withColumnRenamed("id", "key"), g.scan("Community").count()).first()[0]
    paths, _ = _listed(parsed.select(F.col("path").alias("name")))
    return {"files_changed": paths, "symbols_affected": [{"qualified_name": r["id"], "lines": r["lines"]} for r in rows], "symbols_affected_count": n_symbols, "communities_affected": communities, "communities_affected_count": n_communities, "processes_affected": processes, "processes_affected_count": n_processes, "risk_score": f"{risk or 0:.4f}"}


@tool("stage-4", "run_id finding_id output_dir graph_path")
def prepare_prd_input(spark: SparkSession, run_id: str, finding_id: str, output_dir: str, graph_path: str) -> dict:
    base = _run_dir(output_dir, run_id, finding_id)
    receipt, refined = documents.read_json(os.path.join(base, "stage-2.verified.json")), documents.read_json(os.path.join(base, "stage-1.refined.json"))
    if not receipt or not receipt.get("verified"):
        raise ToolError("not_verified", "finalize the verification first")
    words = [re.sub(r"[^A-Za-z0-9_:]", "", w).lower() for w in f"{refined.get('title', '')} {refined['refined_prompt']}".split()]
    words = list(dict.fromkeys(w for w in words if len(w) >= 3))[:32]
    g = _graph(spark, graph_path)
    docs = g.scan(*schema.SEARCHABLE).select("id", F.lower("name").alias("n"), F.lower("qualified_name").alias("q"))
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, token string")  # 32 rows at most
    scored = docs.crossJoin(F.broadcast(tokens)).withColumn("score", search.term_score(F.col("token"), F.col("n"), F.col("q"))).where("score > 0")
    from tesselar.operators.sets import top_per

    best = top_per(scored, ["token"], 3, F.desc("score"), F.col("id")).groupBy("id").agg(F.min("pos").alias("pos"), F.max("score").alias("score")).orderBy("pos", "id")
    matched = _rows(best.select("id", F.round("score", 6).alias("score")))
    ids = [m["id"] for m in matched]
    member, takes = _memberships(g)
    communities = sorted(r[0] for r in member.where(F.col("id").isin(ids)).select("community_id").distinct().collect())
    processes = sorted(r[0] for r in takes.where(F.col("id").isin(ids)).select("process").distinct().collect())
    stats = {r["label"]: r["n"] for r in g.node_count().collect()}  # a row for each label
    path = os.path.join(base, "stage-4.prd_input.json")
    documents.write_json(path, {"finding": refined, "matched_symbols": matched, "impacted_communities": communities, "impacted_processes": processes, "graph_stats": stats, "created_at": _now()})
    return {"artifact_path": path, "matched_symbol_count": len(matched), "impacted_communities_count": len(communities), "impacted_processes_count": len(processes)}


def _known(g: PropertyGraph) -> DataFrame:
    n = g.scan(*schema.SEARCHABLE)
    return n.select(F.explode(F.array_distinct(F.array("id", "qualified_name", "name", text.strip_first_folder(F.col("qualified_name"))))).alias("token"), "id").where("token is not null").distinct()


@tool("stage-6", "prd_path graph_path", "affected_symbols_path run_id finding_id output_dir")
def validate_prd_against_graph(spark: SparkSession, prd_path: str, graph_path: str, affected_symbols_path: str | None = None, run_id: str | None = None, finding_id: str | None = None, output_dir: str | None = None) -> dict:
    g = _graph(spark, graph_path)
    if not os.path.exists(prd_path):
        raise ToolError("prd_not_found", f"there is no file {prd_path}")
    contract_path = affected_symbols_path or re.sub(r"\.md$", ".affected_symbols.json", prd_path)
    contract = documents.read_json(contract_path) if contract_path != prd_path else None
    fallback, excluded = contract is None, []
    if fallback:
        with open(prd_path, encoding="utf-8") as f:
            one = spark.createDataFrame([(f.read(),)], "t string").select(F.explode(validate.claims(F.col("t"))).alias("token"))
        claimed = one.withColumn("change_kind", F.lit("unknown"))
    else:
        claimed = spark.createDataFrame([(a["qualified_name"], a.get("change_kind") or "unknown") for a in contract.get("affected_symbols", [])], "token string, change_kind string")
        excluded = [p for c in contract.get("scope_claims", []) if c.get("kind") == "process_exclusion" for p in c.get("processes", [])]
    known = _known(g)
    unknown = cut(validate.hallucinations(claimed, known, fallback).withColumn("axis", F.lit("symbol_hallucination")))
    found, tallies = _rows(unknown), [_tally(unknown)]
    resolved = claimed.join(known, "token").select("token", "id").distinct()
    member, takes = _memberships(g)
    spread = resolved.join(member, "id").agg(F.count_distinct("community_id").alias("n")).first()["n"]
    if spread >= 2:
        found.append({"token": None, "severity": "critical" if spread >= 3 else "warning", "axis": "community_consistency"})
        tallies.append({found[-1]["severity"]: 1})
    hit = spark.createDataFrame([(p,) for p in excluded], "process string")
    impacted = cut(validate.process_axis(hit, resolved.join(takes, "id").select(F.col("id").alias("symbol"), "process")))
    found += [{"token": r["symbol"], "severity": r["severity"], "axis": "process_impact", "process": r["process"]} for r in _rows(impacted)]
    counts = _added(*tallies, _tally(impacted))
    status = "fail" if counts["critical"] else "warning" if counts["warning"] else "ok"
    summary = counts | {"symbols_resolved": resolved.select("token").distinct().count(), "communities": spread, "processes_impacted": resolved.join(takes, "id").select("process").distinct().count()}
    report = {"validation_status": status, "extraction_mode": "regex_fallback" if fallback else "structured", "contract_missing": fallback, "summary": summary, "report": {"findings": found}}
    if output_dir and run_id and finding_id:
        documents.write_json(os.path.join(_run_dir(output_dir, run_id, finding_id), "stage-6.validation.json"), report)
    return report


@tool("stage-8", "graph_path changed_symbols", "run_id finding_id output_dir")
def check_security_gates(spark: SparkSession, graph_path: str, changed_symbols: list[str], run_id: str | None = None, finding_id: str | None = None, output_dir: str | None = None) -> dict:
    g = _graph(spark, graph_path)
    asked = spark.createDataFrame([(s,) for s in changed_symbols], "token string")
    hits = asked.join(_known(g), "token")
    changed = hits.select(F.col("id").alias("symbol")).distinct()
    unknown = cut(asked.join(hits.select("token"), "token", "left_anti").select(F.col("token").alias("symbol"), F.lit("resolve").alias("gate"), F.lit("info").alias("severity")))
    flags = _rows(unknown)
    member, takes = _memberships(g)
    membership, participation = member.select(F.col("id").alias("symbol"), F.col("community_id").alias("community")), takes.withColumnRenamed("id", "symbol")
    names = g.scan(*schema.SEARCHABLE).select(F.col("id").alias("symbol"), "name")
    symbols = g.nodes.select(F.col("id").alias("symbol"), "visibility")
    by_file = g.of_kind("Defines").where("from_label = 'File'").select(F.col("to_id").alias("symbol"))
    tests = g.scan("Process").where("entry_kind = 'test'").select(F.col("id").alias("process"))
    gates = validate.gate_auth(changed, membership, names).unionByName(validate.gate_unsafe(changed)).unionByName(validate.gate_public(changed, symbols, by_file)).unionByName(validate.gate_tests(changed, participation, tests))
    gates = cut(gates)
    flags += _rows(gates.orderBy("gate", "symbol"))
    imported = g.scan("Import").select("file", "path")
    external = text.is_external(F.col("path"))
    done = g.of_kind("Imports").select(F.col("from_id").alias("file"), text.leaf(F.col("to_id")).alias("leaf")).distinct()
    missing = imported.where(~external).withColumn("leaf", text.leaf(F.col("path"))).where("leaf <> '*'").join(done, ["file", "leaf"], "left_anti")
    touched = changed.join(g.nodes.select(F.col("id").alias("symbol"), "file"), "symbol").select("file").distinct()
    imports = cut(validate.gate_imports(missing.join(touched, "file", "left_semi")))
    flags += [{"symbol": r["file"], "gate": r["gate"], "severity": r["severity"]} for r in _rows(imports)]
    counts = _added(_tally(unknown), _tally(gates), _tally(imports))
    report = {"gates_passed": counts["critical"] == 0, "summary": counts, "report": {"flags": flags}}
    if output_dir and run_id and finding_id:
        documents.write_json(os.path.join(_run_dir(output_dir, run_id, finding_id), "stage-8.security.json"), report)
    return report


@tool("stage-9", "before_graph_path after_graph_path", "report_path")
def verify_semantic_diff(spark: SparkSession, before_graph_path: str, after_graph_path: str, report_path: str | None = None) -> dict:
    parts = semdiff.run(_graph(spark, before_graph_path), _graph(spark, after_graph_path))
    summary = _rows(parts["summary"], 1)[0]
    report = {"summary": summary, "regression_score": summary["regression_score"], "verdict": summary["verdict"], "report": {k: _rows(v, semdiff.MOST_DETAILS) for k, v in parts.items() if k != "summary"}}
    if report_path:
        documents.write_json(report_path, report)
    return report
