"""The evaluation: a labelled corpus is indexed, resolved and clustered, each label's question goes to a tool, and the answers are scored."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import tools
from tesselar.operators import evals
from tesselar.sources.corpora import Corpus

# The tool that answers each of the evaluation's queries.
TOOL = {
    "q1": "search_codebase", "q2": "search_codebase", "q3": "search_codebase", "q4": "get_context", "q5": "get_context", "q6": "get_context", "q7": "get_impact",
    "q8": "query_graph", "q9": "query_graph", "q10": "get_symbol", "q11": "query_graph", "q12": "cluster_graph", "q13": "validate_prd_against_graph", "q14": "query_graph",
}
RELATION = {"q4": "called_by", "q5": "calls", "q6": "implemented_by"}  # what each of these asks for
ANSWERS = "corpus string, language string, query_id string, label int, expected array<string>, actual array<string>, failed boolean, seconds double"
PARTITIONS = "corpus string, language string, label int, item string, expected long, actual long"


def expected_items(expected: dict[str, Any]) -> list[str]:
    """A label's expectation as a list: its list of strings, or its one value."""
    lists = [v for v in expected.values() if isinstance(v, list)]
    if lists:
        return [x for x in lists[0] if isinstance(x, str)]
    return [str(v).lower() if isinstance(v, bool) else v for v in expected.values() if isinstance(v, str | bool)][:1]


def answered_items(query_id: str, answer: dict[str, Any], flat: bool = False) -> list[str]:
    """What a tool's answer says on a query, as a list of strings.

    Of a symbol's relations the one that is asked for; flat: all eight. A query's rows stand for their first columns.
    """
    tool = TOOL[query_id]
    if tool == "search_codebase":
        return [r["qualified_name"] for r in answer["results"][:1]]
    if tool == "get_symbol":
        data = answer["node"]["data"]
        return [data.get("qualified_name") or data["id"]]
    if tool == "get_context":
        return [r["qualified_name"] for name, rows in answer["relationships"].items() if flat or name == RELATION[query_id] for r in rows]
    if tool == "query_graph":
        return [r[0] for r in answer["rows"]]
    if tool == "validate_prd_against_graph":
        return sorted({f["axis"] for f in answer["report"]["findings"]})
    return list(answer.get("affected", []))


def _arguments(corpus: Corpus, graph_path: str, given: dict[str, Any] | None) -> dict[str, Any]:
    """A label's input; files that aren't where it says are looked for by their names in the corpus's folder."""
    out = {"graph_path": graph_path}
    for k, v in (given or {}).items():
        if k.endswith("_path") and isinstance(v, str) and not os.path.exists(v):
            v = next((os.path.join(d, os.path.basename(v)) for d, _, names in os.walk(corpus.folder) if os.path.basename(v) in names), v)
        out[k] = v
    return out


def ask(spark: SparkSession, corpus: Corpus, output_dir: str, flat: bool = False, call: Callable[..., dict] = tools.call) -> tuple[DataFrame, DataFrame]:
    """Answers (ANSWERS, a row for each label but q12's) and partitions (PARTITIONS, a row for each item of q12's labels).

    A corpus has some hundred labels, made by hand; each is a call of a tool, whose work is distributed. Equal calls are
    made once. An answer that is an error fails: it scores 0, even where nothing is expected.
    """
    made = call(spark, "index_codebase", {"path": corpus.sources, "output_dir": output_dir})
    if made["status"] != "ok":
        raise ValueError(f"{corpus.name} can't be indexed: {made['message']}")
    at = made["graph_path"]
    for step in ("resolve_graph", "cluster_graph"):
        done = call(spark, step, {"graph_path": at})
        if done["status"] != "ok":
            raise ValueError(f"{step} fails on {corpus.name}: {done['message']}")
    known: dict[str, tuple[dict, float]] = {json.dumps(["cluster_graph", {"graph_path": at}]): (done, 0.0)}
    answers, partitions = [], []
    for i, label in enumerate(corpus.labels):
        q, expected = label["query_id"], label["expected"]
        arguments = _arguments(corpus, at, label.get("input"))
        key = json.dumps([TOOL[q], arguments])
        if key not in known:
            began = time.monotonic()
            answer = call(spark, TOOL[q], arguments)
            known[key] = answer, time.monotonic() - began
        answer, seconds = known[key]
        ok = answer["status"] == "ok"
        if q in evals.SCORED["ari"]:
            cluster = {r["qn"]: r["cluster_id"] for r in answer["clusters"]} if ok else {}
            partitions += [(corpus.name, corpus.language, i, r["qn"], r["cluster"], cluster.get(r["qn"], -1)) for r in expected["partition"]]
        else:
            answers.append((corpus.name, corpus.language, q, i, expected_items(expected), answered_items(q, answer, flat) if ok else [], not ok, seconds))
    return spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(partitions, PARTITIONS)


def scores(answers: DataFrame, partitions: DataFrame) -> DataFrame:
    """corpus, language, query_id, label, score: a row for each label."""
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    kind = lambda name: F.col("query_id").isin(evals.SCORED[name])
    score = F.when(kind("exact"), evals.exact(first("expected"), first("actual"))).when(kind("f1"), evals.f1(F.col("expected"), F.col("actual"))).otherwise(evals.precision_recall_mean(F.col("actual"), F.col("expected")))
    keys = ["corpus", "language", "query_id", "label"]
    out = [answers.select(*keys, F.when(F.col("failed"), 0.0).otherwise(score).alias("score"))]
    for r in partitions.select("corpus", "language", "label").distinct().collect():  # one label for a corpus, as a rule
        one = evals.adjusted_rand(partitions.where((F.col("corpus") == r["corpus"]) & (F.col("label") == r["label"])), "expected", "actual")
        out.append(one.select(F.lit(r["corpus"]).alias("corpus"), F.lit(r["language"]).alias("language"), F.lit(evals.SCORED["ari"][0]).alias("query_id"), F.lit(r["label"]).alias("label"), "score"))
    return reduce(DataFrame.unionByName, out)


def report(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By query (mean, samples), by corpus (weighted score against floor and target), and over all corpora (one row)."""
    by = ["corpus", "language"]
    by_query = scored.groupBy(*by, "query_id").agg(F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("samples"))
    by_corpus = evals.weighted(scored, by).join(scored.groupBy(*by).agg(F.count("*").alias("samples")), by)
    return by_query, by_corpus, evals.overall(by_corpus)
