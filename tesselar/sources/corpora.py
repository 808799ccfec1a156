"""Labelled corpora for evaluation: a manifest and ground truth."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tesselar.operators.evals import WEIGHTS


@dataclass(frozen=True)
class Corpus:
    name: str
    language: str
    version: str
    labels: list[dict]
    folder: str = ""
    sources: str = ""


def load(folder: str) -> Corpus:
    """corpus.toml and ground_truth.json of a folder. They must agree, and labels must be for known queries."""
    with open(os.path.join(folder, "corpus.toml"), "rb") as f:
        manifest = tomllib.load(f)
    manifest = manifest.get("corpus", manifest)
    with open(os.path.join(folder, "ground_truth.json"), encoding="utf-8") as f:
        truth = json.load(f)
    name = manifest.get("id") or manifest.get("name")
    if truth.get("corpus") != name:
        raise ValueError(f"the manifest is of {name}, the labels are of {truth.get('corpus')}")
    for label in truth.get("labels", []):
        if label.get("query_id") not in WEIGHTS:
            raise ValueError(f"there is no query {label.get('query_id')}")
    sources = os.path.normpath(os.path.join(os.path.abspath(folder), manifest.get("path") or "src"))
    return Corpus(name, manifest.get("language") or truth.get("language", ""), str(truth.get("version", "")), truth.get("labels", []), os.path.abspath(folder), sources)


def labels(spark: SparkSession, corpora: list[Corpus]) -> DataFrame:
    """corpus, language, query_id, input, expected (both JSON), a row for each label."""
    rows = [(c.name, c.language, x["query_id"], json.dumps(x.get("input")), json.dumps(x.get("expected"))) for c in corpora for x in c.labels]
    return spark.createDataFrame(rows, "corpus string, language string, query_id string, input string, expected string")
