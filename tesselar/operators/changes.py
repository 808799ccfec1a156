"""From diffs to the symbols they touch, and what that risks."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.functions import text
from tesselar.graph import PropertyGraph

MOST_LINES = 4_000_000_000


def git_diff(spark: SparkSession, repository: str, base: str = "HEAD~1", head: str = "HEAD") -> DataFrame:
    """One row (diff_id, text) of a repository's diff, read on the driver. References can't be options."""
    for ref in (base, head):
        if not ref or ref.startswith("-") or re.search(r"[\n\r\0]", ref):
            raise ValueError(f"unsafe reference {ref!r}")
    done = subprocess.run(["git", "-C", repository, "diff", f"{base}..{head}", "--"], capture_output=True, text=True, timeout=120, check=True)
    return spark.createDataFrame([(f"{base}..{head}", done.stdout)], "diff_id string, text string")


def parse_diff(diffs: DataFrame) -> DataFrame:
    """diff_id, path, line, is_new, is_deleted: a row for each changed line of unified diffs (diff_id, text).

    Lines are the new side's; a removed one has the place at which it stood. A file without lines has one row with a
    null line. A line's number is its hunk's start and how many lines of the new side came before: running counts.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "l"))
    l, over = F.col("l"), Window.partitionBy("diff_id").orderBy("n")
    starts = lambda s: F.startswith(l, F.lit(s))
    header = starts("diff --git") | starts("--- a/") | starts("--- /dev/null") | starts("+++ b/") | starts("+++ /dev/null")
    kind = F.when(header, "header").when(starts("@@ "), "hunk").when(starts("+") & ~starts("+++"), "+").when(starts("-") & ~starts("---"), "-").otherwise(" ")
    marked = lines.withColumn("kind", kind).withColumn("file", F.count_if(starts("diff --git")).over(over)).withColumn("hunk", F.count_if(F.col("kind") == "hunk").over(over)).where("file > 0")
    part = Window.partitionBy("diff_id", "hunk").orderBy("n")
    start = F.first(F.when(F.col("kind") == "hunk", text.hunk_start(l)), ignorenulls=True).over(part)
    before = F.count_if(F.col("kind").isin("+", " ")).over(part.rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumn("line", start + before)
    whole = Window.partitionBy("diff_id", "file")
    path = F.coalesce(F.max(F.when(starts("+++ b/"), F.substring(l, 7, 1 << 20))).over(whole), F.max(F.when(starts("--- a/"), F.substring(l, 7, 1 << 20))).over(whole))
    named = placed.withColumn("path", path).withColumn("is_new", F.bool_or(starts("--- /dev/null")).over(whole)).withColumn("is_deleted", F.bool_or(starts("+++ /dev/null")).over(whole)).where("path is not null")
    changed = named.where("kind in ('+', '-')").select("diff_id", "path", "line", "is_new", "is_deleted")
    bare = named.groupBy("diff_id", "file").agg(F.first("path").alias("path"), F.bool_or(F.col("kind").isin("+", "-")).alias("any"), F.first("is_new").alias("is_new"), F.first("is_deleted").alias("is_deleted"))
    return changed.unionByName(bare.where("not any").select("diff_id", "path", F.lit(None).cast("bigint").alias("line"), "is_new", "is_deleted"))


def touched(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, lines: how many changed lines lie in each symbol. changed: path, line, is_new, is_deleted; symbols: key, path, start_line, end_line.

    The path is the join's key and the range its condition; a new or deleted file touches its symbols whole.
    """
    some = changed.where("not is_new and not is_deleted").groupBy("path", "line").agg(F.count("*").alias("times"))
    inside = some.join(symbols, "path").where("line between start_line and end_line").groupBy("key").agg(F.sum("times").alias("lines"))
    whole = changed.where("is_new or is_deleted").select("path").distinct()
    entire = symbols.join(whole, "path", "left_semi").select("key", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("bigint").alias("lines"))
    return inside.unionByName(entire).groupBy("key").agg(F.sum("lines").alias("lines"))


def symbols_of(graph: PropertyGraph) -> DataFrame:
    """key, path, start_line, end_line of what files define, methods of defined types included."""
    labels = ["Function", "Struct", "Enum", "Trait", "Method"]
    return graph.scan(*labels).where("start_line is not null").select(F.col("id").alias("key"), F.coalesce("file", text.file_prefix(F.col("qualified_name"))).alias("path"), "start_line", "end_line")


def risk(symbols: DataFrame, communities: int | Column) -> DataFrame:
    """One row, risk: 0.6 of how near symbols come to the greatest number of processes, and 0.4 of the share of communities. symbols: key, community, processes."""
    top = symbols.agg(F.greatest(F.max("processes"), F.lit(1)).alias("most"), F.avg("processes").alias("mean"), F.count_distinct("community").alias("n"))
    total = F.greatest(F.lit(communities) if isinstance(communities, int) else communities, F.lit(1))
    return top.select(F.round(F.least(F.lit(1.0), 0.6 * F.coalesce(F.col("mean") / F.col("most"), F.lit(0.0)) + 0.4 * F.col("n") / total), 6).alias("risk"))
