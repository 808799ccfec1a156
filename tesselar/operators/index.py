"""From parsed files to a graph: folders, files, symbols, and the edges that declarations give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar import parsing, schema
from tesselar.graph import PropertyGraph
from tesselar.operators.storage import cut

STRUCTURE = ["Defines", "HasMethod", "HasField", "HasVariant"]


def _shaped(df: DataFrame) -> DataFrame:
    """df with exactly the columns of nodes; those it lacks are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.NODES.fields])


def folders(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder nodes and Contains edges of every prefix of the paths. The root is no node."""
    parts = F.split("path", "/")
    steps = files.select("path", parts.alias("p")).where("size(p) > 1").select("path", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"))
    at = F.array_join(F.slice("p", 1, F.col("n")), "/")
    nodes = steps.select(at.alias("id"), F.lit("Directory").alias("label"), at.alias("path"), F.element_at("p", F.col("n")).alias("name")).distinct()
    child = F.array_join(F.slice("p", 1, F.col("n") + 1), "/")
    last = F.col("n") + 1 == F.size("p")
    edges = steps.select(F.when(last, "Contains_Dir_File").otherwise("Contains_Dir_Dir").alias("rel"), F.lit("Contains").alias("kind"), F.lit("Directory").alias("from_label"), at.alias("from_id"), F.when(last, "File").otherwise("Directory").alias("to_label"), child.alias("to_id")).distinct()
    return nodes, edges


def file_nodes(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("id"), F.lit("File").alias("label"), "path", name.alias("name"), F.regexp_extract(name, r"\.([^.]+)$", 1).alias("extension"), "size_bytes", F.col("path").alias("file"))


def symbol_nodes(parsed: DataFrame) -> DataFrame:
    """One node for each id in a file, the first to be emitted; a label's own properties only."""
    first = F.row_number().over(Window.partitionBy("file", "qualified_name").orderBy("seq"))
    rows = parsed.where("record = 'node'").withColumn("_nth", first).where("_nth = 1")
    p = lambda key: F.try_element_at("properties", F.lit(key))

    def only(labels: list[str], value: Column) -> Column:
        return F.when(F.col("label").isin(labels), value)

    having = lambda column: [label for label in schema.LABELS if column in schema.columns_of(label)]
    values = {
        "name": F.col("name"), "qualified_name": F.col("qualified_name"), "start_line": F.col("start_line"), "end_line": F.col("end_line"), "visibility": F.col("visibility"), "is_async": p("is_async") == "true",
        "receiver_type": p("receiver_type"), "type_annotation": p("type_annotation"), "target_type": p("target_type"), "path": p("path"), "alias": p("alias"), "is_glob": p("is_glob") == "true", "callee_name": p("callee_name"), "line": F.col("start_line"), "col": p("col").try_cast("bigint"),
    }
    return rows.select(F.col("qualified_name").alias("id"), "label", *[only(having(c), v).alias(c) for c, v in values.items()], "file", "language")


def edges(parsed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of known tables from structural references, and how many references had no table (kind, from_label, to_label, n)."""
    spark = parsed.sparkSession
    ends = nodes.select("id", "label")
    a, b = ends.select(F.col("id").alias("from_qualified_name"), F.col("label").alias("from_label")), ends.select(F.col("id").alias("to_qualified_name"), F.col("label").alias("to_label"))
    refs = parsed.where("record = 'ref'").where(F.col("kind").isin(STRUCTURE)).select("kind", "from_qualified_name", "to_qualified_name").distinct()
    joined = refs.join(a, "from_qualified_name").join(b, "to_qualified_name")
    # A file's modules are contained, not defined.
    module = (F.col("kind") == "Defines") & (F.col("from_label") == "File") & (F.col("to_label") == "Module")
    routed = joined.withColumn("kind", F.when(module, "Contains").otherwise(F.col("kind"))).withColumn("rel", F.concat_ws("_", "kind", "from_label", "to_label"))
    tables = F.broadcast(schema.rel_tables(spark).select("rel"))  # a fixed table
    known = routed.join(tables, "rel", "left_semi").select("rel", "kind", "from_label", F.col("from_qualified_name").alias("from_id"), "to_label", F.col("to_qualified_name").alias("to_id"))
    lost = routed.join(tables, "rel", "left_anti").groupBy("kind", "from_label", "to_label").agg(F.count("*").alias("n"))
    return known, lost


def run(files: DataFrame, strict: bool = False) -> tuple[PropertyGraph, DataFrame]:
    """The graph of files (path, language, size_bytes, content), and what the parsers gave (for references and errors). strict: a file that can't be read fails the job."""
    parsed = cut(parsing.parse_files(files if strict else files.where("content is not null"), strict))
    dirs, contains = folders(files)
    nodes = _shaped(dirs).unionByName(_shaped(file_nodes(files))).unionByName(_shaped(symbol_nodes(parsed)))
    nodes = cut(nodes)
    known, _ = edges(parsed, nodes)
    every = contains.unionByName(known)
    typed = every.select("*", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("resolution_method"), F.lit(None).cast("long").alias("depth"))
    return PropertyGraph(nodes, cut(typed)), parsed
