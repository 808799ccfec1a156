import json

import pytest

from tesselar import harness
from tesselar.operators.evals import WEIGHTS
from tesselar.sources import corpora

SOURCE = {
    "a.rs": "use std::fmt;\npub struct Widget { pub size: u32, pub name: String }\npub trait Shape { fn area(&self); }\npub fn helper() {}\npub fn main() { helper(); }\n",
    "b.rs": "use crate::helper;\npub fn other() { helper(); }\n",
}
LABELS = [
    ("q1", {"query": "Widget", "label_filter": "Struct"}, {"qualified_name": "a.rs::Widget"}),
    ("q2", {"query": "Shape", "label_filter": "Trait"}, {"qualified_name": "a.rs::Shape"}),
    ("q3", {"query": "helper", "label_filter": "Function"}, {"qualified_name": "a.rs::helper"}),
    ("q4", {"qualified_name": "a.rs::helper"}, {"callers": ["a.rs::main", "b.rs::other"]}),
    ("q5", {"qualified_name": "b.rs::other"}, {"callees": ["a.rs::helper"]}),
    ("q6", {"qualified_name": "a.rs::Shape"}, {"implementors": []}),
    ("q6", {"qualified_name": "a.rs::NotThere"}, {"implementors": []}),
    ("q7", {"qualified_name": "a.rs::helper"}, {"affected": []}),
    ("q8", {"query": "MATCH (f:File)-[:Defines_File_Function]->(n:Function) WHERE f.path = 'a.rs' RETURN n.qualified_name"}, {"symbols": ["a.rs::helper", "a.rs::main"]}),
    ("q9", {"query": "MATCH (f:File)-[:Defines_File_Import]->(n:Import) WHERE f.path = 'a.rs' RETURN n.path"}, {"imports": ["std::fmt"]}),
    ("q10", {"qualified_name": "a.rs::main"}, {"qualified_name": "a.rs::main"}),
    ("q11", {"query": "MATCH (s:Struct)-[:HasField_Struct_Field]->(f:Field) WHERE s.qualified_name = 'a.rs::Widget' RETURN f.name"}, {"fields": ["size", "name"]}),
    ("q12", {}, {"partition": [{"qn": "a.rs::helper", "cluster": 1}, {"qn": "a.rs::main", "cluster": 1}, {"qn": "b.rs::other", "cluster": 1}]}),
    ("q13", {"prd_path": "/nowhere/p.md"}, {"truly_present": ["symbol_hallucination"]}),
    ("q14", {"query": "MATCH (f:File)-[:Defines_File_Import]->(n:Import) WHERE f.path = 'b.rs' RETURN n.path"}, {"unresolved": ["std::io"]}),
]


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "code").mkdir()
    for name, text in SOURCE.items():
        (tmp_path / "code" / name).write_text(text)
    (tmp_path / "prds").mkdir()
    (tmp_path / "prds" / "p.md").write_text("# change")
    (tmp_path / "prds" / "p.affected_symbols.json").write_text(json.dumps({"affected_symbols": [{"qualified_name": "a.rs::nope", "change_kind": "modify"}]}))
    (tmp_path / "corpus.toml").write_text('name = "small"\nlanguage = "rust"\npath = "code"\n')
    labels = [{"query_id": q, "input": i, "expected": e} for q, i, e in LABELS]
    (tmp_path / "ground_truth.json").write_text(json.dumps({"corpus": "small", "language": "rust", "labels": labels}))
    return corpora.load(str(tmp_path))


def test_all_fourteen(spark, corpus, tmp_path):
    answers, partitions = harness.ask(spark, corpus, str(tmp_path / "out"))
    by_query, by_corpus, whole = harness.report(harness.scores(answers, partitions))
    got = {r["query_id"]: (r["score"], r["samples"]) for r in by_query.collect()}
    want = {f"q{i}": (1.0, 1) for i in range(1, 15)} | {"q6": (0.5, 2), "q14": (0.0, 1)}  # an unknown symbol scores 0; b.rs imports nothing from std
    assert got == want
    row = by_corpus.first()
    weight = sum(WEIGHTS.values())
    assert row["samples"] == 15 and row["score"] == round((weight - 0.5 * WEIGHTS["q6"] - WEIGHTS["q14"]) / weight, 6) and row["reaches_target"]
    assert whole.first()["weakest"] == "rust"


def test_items():
    assert harness.expected_items({"exists": True}) == ["true"] and harness.expected_items({"a": ["x", 1, "y"]}) == ["x", "y"] and harness.expected_items({}) == []
    relations = {"calls": [{"qualified_name": "a"}], "called_by": [{"qualified_name": "b"}], "uses": [{"qualified_name": "c"}]}
    assert harness.answered_items("q4", {"relationships": relations}) == ["b"] and harness.answered_items("q4", {"relationships": relations}, flat=True) == ["a", "b", "c"]
    assert harness.answered_items("q1", {"results": []}) == [] and harness.answered_items("q7", {"communities": ["x"]}) == []


def test_sources_that_cannot_be_indexed(spark, corpus, tmp_path):
    refuse = lambda spark, name, arguments: {"status": "error", "message": "no"}
    with pytest.raises(ValueError):
        harness.ask(spark, corpus, str(tmp_path / "out"), call=refuse)
