"""Processes: entry points, what they reach, and the impact of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.operators.components import reach


def entry_points(functions: DataFrame) -> DataFrame:
    """id, kind, confidence of functions that something outside starts. functions: id, name, qualified_name, visibility."""
    name, parts = F.col("name"), F.split("qualified_name", "::")
    library = (F.col("visibility") == "pub") & (F.size(parts) == 2) & F.endswith(parts[0], F.lit(".rs"))
    kind = F.when(name == "main", "main").when(F.startswith(name, F.lit("test_")), "test").when(F.startswith(name, F.lit("do_")), "handler").when(library, "lib_entry")
    found = functions.select("id", "qualified_name", kind.alias("kind")).where("kind is not null")
    return found.withColumn("confidence", F.when(F.col("kind") == "handler", 0.8).when(F.col("kind") == "lib_entry", 0.6).otherwise(1.0))


def processes(entries: DataFrame, calls: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Process rows (id, entry_point_id, entry_kind, entry_confidence, depth, symbol_count) and participation (id, process, depth).

    calls: a, b. depth is the step in which a symbol is first met; a process's depth is the greatest.
    """
    named = entries.withColumn("process", F.concat(F.lit("process::"), F.col("qualified_name")))
    met = reach(entries.select("id"), calls, most)
    size = met.groupBy("start").agg(F.max("depth").cast("long").alias("depth"), F.count("*").alias("symbol_count"))
    rows = named.join(size, named["id"] == size["start"]).select(F.col("process").alias("id"), F.col("id").alias("entry_point_id"), F.col("kind").alias("entry_kind"), F.col("confidence").alias("entry_confidence"), "depth", "symbol_count")
    takes = met.join(named.select(F.col("id").alias("start"), "process"), "start").select("id", "process", F.col("depth").cast("long").alias("depth"))
    return rows, takes


def impact(node_id: str, membership: DataFrame, participation: DataFrame) -> DataFrame:
    """what (community or process), name: all that holds the symbol."""
    c = membership.where(F.col("id") == node_id).select(F.lit("community").alias("what"), F.col("community_id").alias("name"))
    p = participation.where(F.col("id") == node_id).select(F.lit("process").alias("what"), F.col("process").alias("name"))
    return c.unionByName(p).distinct()
