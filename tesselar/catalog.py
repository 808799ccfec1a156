"""All queries of the library, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselar.queries import basics, code, graphs, reviews, searches, systems
from tesselar.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code", "flagship", "graphs", "reviews", "searches", "systems"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basics.pattern_group_count(spark, sf_dir)
