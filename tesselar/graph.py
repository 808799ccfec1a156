"""A typed property graph in two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import schema


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, label and properties; edges: rel, kind, from_label, from_id, to_label, to_id and properties.

    Edges carry their ends' labels and ids, so that a pattern joins nodes only for their other columns.
    """

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> PropertyGraph:
        """From Parquet, nodes partitioned by label and edges by rel: a scan of some labels reads no others."""
        return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    def write(self, path: str, mode: str = "overwrite") -> None:
        self.nodes.write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")

    def scan(self, *labels: str) -> DataFrame:
        return self.nodes.where(F.col("label").isin(*labels))

    def expand(self, *rels: str) -> DataFrame:
        return self.edges.where(F.col("rel").isin(*rels))

    def of_kind(self, *kinds: str) -> DataFrame:
        return self.edges.where(F.col("kind").isin(*kinds))

    def node_count(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("n"))

    def edge_count(self) -> DataFrame:
        return self.edges.groupBy("rel").agg(F.count("*").alias("n"))

    def views(self, prefix: str = "") -> None:
        """A temporary view for each label that the schema knows, with its columns, and for each edge table."""
        for label in schema.LABELS:
            have = set(self.nodes.columns)
            self.scan(label).select(*[c for c in schema.columns_of(label) if c in have]).createOrReplaceTempView(prefix + label)
        for rel in schema.REL_TABLES:
            self.expand(rel).createOrReplaceTempView(prefix + rel)

    def lookup(self, key: str, labels: list[str]) -> DataFrame:
        """The node with this qualified name or id, of the first label that has one."""
        rank = _rank("label", labels)
        return self.scan(*labels).where((F.col("qualified_name") == key) | (F.col("id") == key)).orderBy(rank, "id").limit(1)

    def add_nodes(self, more: DataFrame) -> PropertyGraph:
        return replace(self, nodes=self.nodes.unionByName(more, allowMissingColumns=True))

    def add_edges(self, more: DataFrame, tables: DataFrame | None = None) -> PropertyGraph:
        return replace(self, edges=self.edges.unionByName(checked(more, self.nodes, tables), allowMissingColumns=True))


def _rank(column: str, order: list[str]):
    return reduce(lambda acc, x: F.when(F.col(column) == x[1], x[0]).otherwise(acc), reversed(list(enumerate(order))), F.lit(len(order)))


def checked(edges: DataFrame, nodes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Those of edges of which both ends are nodes and, if tables are given, the table is known; others write nothing.

    Semi-joins on (label, id): neither side is collected, and a hot node is split by adaptive execution.
    """
    ends = nodes.select("label", "id").distinct()
    out = edges.join(F.broadcast(tables.select("rel")), "rel", "left_semi") if tables is not None else edges
    out = out.join(ends.select(F.col("label").alias("from_label"), F.col("id").alias("from_id")), ["from_label", "from_id"], "left_semi")
    return out.join(ends.select(F.col("label").alias("to_label"), F.col("id").alias("to_id")), ["to_label", "to_id"], "left_semi").select(edges.columns)


def quarantined(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges of unknown tables. They are kept apart, not created."""
    return edges.join(F.broadcast(tables.select("rel")), "rel", "left_anti")
