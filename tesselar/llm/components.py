"""Connected components of links, by stars, without a driver's or one task's view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm import common


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for each end of a link the least node of its component.

    links: columns a and b of one orderable type. Rounds of two star operations shorten all paths: first each node
    gives its larger neighbours to its least one, then its smaller ones. They end when nothing changes; the number of
    rounds grows with the logarithm of the longest path. A star's centre is no hot key: minima are taken by partial
    aggregation and joins are split when skewed. Nulls and loops are no links.
    """
    edges = common.cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.cut(large)
        common.discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = common.cut(small)
        common.discard(large)
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
