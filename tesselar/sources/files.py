"""Source trees as tables of files, with the limits that guard what is read."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions import text

# Folders that hold no source, and how much is read.
SKIPPED = ["target", "node_modules", "__pycache__", "venv", "build", "out", "Pods", "DerivedData", "Carthage", "vendor", "dist", "bin", "obj", "coverage"]
MOST_FILES, MOST_BYTES, MOST_TOTAL, MOST_DEPTH = 100_000, 10 << 20, 2 << 30, 64
MOST_PARSED = 1 << 20
#: Which language wins when two have as many files.
PRECEDENCE = ["rust", "python", "typescript", "java", "kotlin", "swift", "go", "c", "cpp", "objc"]


class LimitError(ValueError):
    pass


def list_tree(root: str, language: str | None = None) -> list[tuple[str, int]]:
    """Relative paths and sizes of source files, sorted; links, hidden and build folders and large files are left out."""
    out: list[tuple[str, int]] = []
    stack = [("", 0)]
    while stack:
        folder, depth = stack.pop()
        if depth > MOST_DEPTH:
            raise LimitError(f"deeper than {MOST_DEPTH} folders")
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                if e.is_symlink() or e.name.startswith(".") or e.name in SKIPPED:
                    continue
                path = posixpath.join(folder, e.name)
                if e.is_dir():
                    stack.append((path, depth + 1))
                    continue
                lang = text.EXTENSIONS.get(e.name.rpartition(".")[2])
                if lang and (language in (None, "auto", lang)) and (size := e.stat().st_size) <= MOST_BYTES:
                    out.append((path, size))
                    if len(out) > MOST_FILES:
                        raise LimitError(f"more than {MOST_FILES} files")
    return sorted(out)


def read_tree(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """path, language, size_bytes, content (null if it isn't UTF-8 or is too large to parse) of the files under a root.

    The binary source lists and reads on the cluster; filters on names and lengths are pushed into its scan. Limits
    are checked by one aggregate before contents are used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.col("path"), f"^[a-z]*:/*{base.lstrip('/')}/", "")
    folders = F.split(path, "/")
    hidden = F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | x.isin(SKIPPED))
    known = files.where(F.col("length") <= MOST_BYTES).select(path.alias("path"), text.language(path).alias("language"), F.col("length").alias("size_bytes"), "content", F.size(folders).alias("depth")).where(~hidden & F.col("language").isNotNull())
    if language not in (None, "auto"):
        known = known.where(F.col("language") == language)
    guard(known)
    readable = F.is_valid_utf8(F.col("content").cast("string")) & (F.col("size_bytes") <= MOST_PARSED)
    return known.select("path", "language", "size_bytes", F.when(readable, F.col("content").cast("string")).alias("content"))


def guard(files: DataFrame) -> None:
    """Refuses more than the limits allow. Contents aren't read for this."""
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first()
    if row["n"] > MOST_FILES:
        raise LimitError(f"{row['n']} files; the limit is {MOST_FILES}")
    if row["total"] > MOST_TOTAL:
        raise LimitError(f"{row['total']} bytes; the limit is {MOST_TOTAL}")
    if row["depth"] > MOST_DEPTH + 1:
        raise LimitError(f"{row['depth']} folders deep; the limit is {MOST_DEPTH}")


def inline(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The same columns, from texts."""
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    return rows.select("path", text.language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), "content")


def dominant_language(files: DataFrame) -> str | None:
    """The language of most files in the top folder."""
    counts = {r["language"]: r["n"] for r in files.where(~F.contains("path", F.lit("/"))).groupBy("language").agg(F.count("*").alias("n")).collect()}  # ten languages at most
    return min(counts, key=lambda x: (-counts[x], PRECEDENCE.index(x)), default=None)
