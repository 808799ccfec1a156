"""The relational tables as a property graph, and as the same graph in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(df: DataFrame, kind: str, a: str, from_id: Column, b: str, to_id: Column, weight: Column | None = None) -> DataFrame:
    return df.select(F.lit(f"{kind}_{a}_{b}").alias("rel"), F.lit(kind).alias("kind"), F.lit(a).alias("from_label"), from_id.alias("from_id"), F.lit(b).alias("to_label"), to_id.alias("to_id"), (F.lit(1) if weight is None else weight).cast("long").alias("weight"))


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


LINES_PER_PART = 1_000_000


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, dealt out so that a task groups so many rows at most on average, if the session's shuffle partitions are fewer than that takes. The count reads the files' footers only."""
    n = -(-df.count() // LINES_PER_PART)
    few = n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys).repartition(n, *keys) if few else df


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions contain nations, which define customers and suppliers; customers place orders, which call parts (weight: lines), which use suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    # Regions and nations have a fixed number of rows.
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", F.concat_ws("/", "r_name", "n_name").alias("place"))
    place = F.broadcast(nation.select("n_nationkey", "place"))
    customer = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    node = lambda df, label, i, name, qn: df.select(i.alias("id"), F.lit(label).alias("label"), name.alias("name"), qn.alias("qualified_name"))
    order_name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    nodes = [
        node(t("region"), "Region", _id("r", "r_regionkey"), F.col("r_name"), F.col("r_name")),
        node(nation, "Nation", _id("n", "n_nationkey"), F.col("n_name"), F.col("place")),
        node(customer, "Customer", _id("c", "c_custkey"), F.col("c_name"), F.concat_ws("::", "place", "c_name")),
        node(supplier, "Supplier", _id("s", "s_suppkey"), F.col("s_name"), F.concat_ws("::", "place", "s_name")),
        node(t("orders"), "Order", _id("o", "o_orderkey"), order_name, F.concat_ws("::", F.lit("orders"), order_name)),
        node(t("part"), "Part", _id("p", "p_partkey"), F.col("p_name"), F.concat_ws("::", "p_brand", "p_type", "p_name")),
    ]
    line = t("lineitem")
    calls = _spread(line, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    uses = _spread(line, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    edges = [
        _edges(nation, "Contains", "Region", _id("r", "n_regionkey"), "Nation", _id("n", "n_nationkey")),
        _edges(t("customer"), "Defines", "Nation", _id("n", "c_nationkey"), "Customer", _id("c", "c_custkey")),
        _edges(t("supplier"), "Defines", "Nation", _id("n", "s_nationkey"), "Supplier", _id("s", "s_suppkey")),
        _edges(t("orders"), "Places", "Customer", _id("c", "o_custkey"), "Order", _id("o", "o_orderkey")),
        _edges(calls, "Calls", "Order", _id("o", "l_orderkey"), "Part", _id("p", "l_partkey"), F.col("n")),
        _edges(uses, "Uses", "Part", _id("p", "l_partkey"), "Supplier", _id("s", "l_suppkey"), F.col("n")),
    ]
    first, *rest = nodes
    for x in rest:
        first = first.unionByName(x)
    one, *more = edges
    for x in more:
        one = one.unionByName(x)
    return PropertyGraph(first, one)


#: The same in SQL, to stand after WITH.
SQL = """
places AS (SELECT n_nationkey, n_name, n_regionkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'r:' || r_regionkey AS id, 'Region' AS label, r_name AS name, r_name AS qualified_name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'Nation', n_name, place FROM places
  UNION ALL SELECT 'c:' || c_custkey, 'Customer', c_name, place || '::' || c_name FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT 's:' || s_suppkey, 'Supplier', s_name, place || '::' || s_name FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT 'o:' || o_orderkey, 'Order', 'order_' || o_orderkey, 'orders::order_' || o_orderkey FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'Part', p_name, p_brand || '::' || p_type || '::' || p_name FROM part),
edges AS (
  SELECT 'Contains_Region_Nation' AS rel, 'Contains' AS kind, 'Region' AS from_label, 'r:' || n_regionkey AS from_id, 'Nation' AS to_label, 'n:' || n_nationkey AS to_id, 1::BIGINT AS weight FROM nation
  UNION ALL SELECT 'Defines_Nation_Customer', 'Defines', 'Nation', 'n:' || c_nationkey, 'Customer', 'c:' || c_custkey, 1 FROM customer
  UNION ALL SELECT 'Defines_Nation_Supplier', 'Defines', 'Nation', 'n:' || s_nationkey, 'Supplier', 's:' || s_suppkey, 1 FROM supplier
  UNION ALL SELECT 'Places_Customer_Order', 'Places', 'Customer', 'c:' || o_custkey, 'Order', 'o:' || o_orderkey, 1 FROM orders
  UNION ALL SELECT 'Calls_Order_Part', 'Calls', 'Order', 'o:' || l_orderkey, 'Part', 'p:' || l_partkey, count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'Uses_Part_Supplier', 'Uses', 'Part', 'p:' || l_partkey, 'Supplier', 's:' || l_suppkey, count(*) FROM lineitem GROUP BY l_partkey, l_suppkey)
"""
