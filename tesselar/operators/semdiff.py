"""The difference between two graphs: what came and went, what dangles, which cycles are new, and the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.graph import PropertyGraph
from tesselar.operators import components, sets

MOST_DETAILS = 100


def nodes(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    return sets.difference(before.nodes.where("qualified_name is not null"), after.nodes.where("qualified_name is not null"), ["label", "qualified_name"])


def edges(before: PropertyGraph, after: PropertyGraph) -> DataFrame:
    return sets.difference(before.edges, after.edges, ["rel", "from_id", "to_id"])


def dangling(graph: PropertyGraph, removed: DataFrame | None = None) -> DataFrame:
    """Edges of which an end isn't a node, or is one of removed (id)."""
    known = graph.nodes.select("id").distinct()
    if removed is not None:
        known = known.join(removed.select("id"), "id", "left_anti")
    a = graph.edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    b = graph.edges.join(known.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return a.select("rel", "from_id", "to_id").unionByName(b.select("rel", "from_id", "to_id")).distinct()


def cycles(graph: PropertyGraph, key: str = "qualified_name") -> DataFrame:
    """cycle: the sorted names on each cycle, comma-joined."""
    found = components.strong(graph.edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    named = found.join(graph.nodes.select("id", F.coalesce(key, "id").alias("name")), "id")
    return named.groupBy("component").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("cycle")).select("cycle")


def score(dangling: Column, new_cycles: Column, unresolved_delta: Column) -> Column:
    return F.least(F.lit(10.0), 1.0 * dangling + 0.5 * new_cycles + F.least(F.lit(5.0), 0.1 * F.greatest(F.lit(0), unresolved_delta)))


def verdict(score: Column) -> Column:
    return F.when(score < 1.0, "clean").when(score < 5.0, "concerning").otherwise("regression")


def run(before: PropertyGraph, after: PropertyGraph) -> dict[str, DataFrame]:
    """nodes, edges, dangling, new_cycles (MOST_DETAILS of each at most, in order) and summary (one row)."""
    n, e, d = nodes(before, after), edges(before, after), dangling(after)
    fresh = cycles(after).subtract(cycles(before))
    imports = lambda g: g.nodes.where("label = 'Import'").agg(F.count("*").alias("n"))
    count = lambda df, name, where="true": df.where(where).agg(F.count("*").alias(name))
    row = count(n, "nodes_added", "change = 'added'").crossJoin(count(n, "nodes_removed", "change = 'removed'")).crossJoin(count(e, "edges_added", "change = 'added'")).crossJoin(count(e, "edges_removed", "change = 'removed'"))
    row = row.crossJoin(count(d, "dangling")).crossJoin(count(fresh, "new_cycles")).crossJoin(imports(after).withColumnRenamed("n", "i_after")).crossJoin(imports(before).withColumnRenamed("n", "i_before"))  # one row each
    s = score(F.col("dangling"), F.col("new_cycles"), F.col("i_after") - F.col("i_before"))
    summary = row.select("*", F.round(s, 6).alias("regression_score"), verdict(s).alias("verdict"))
    return {"nodes": n.orderBy("label", "qualified_name").limit(MOST_DETAILS), "edges": e.orderBy("rel", "from_id", "to_id").limit(MOST_DETAILS), "dangling": d.orderBy("rel", "from_id", "to_id").limit(MOST_DETAILS), "new_cycles": fresh.orderBy("cycle").limit(MOST_DETAILS), "summary": summary}
