"""Set operations, aggregates, ranks and limits that the other operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with `change`: added or removed. One aggregation, instead of two subtractions."""
    sides = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    counted = sides.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    return counted.select(*keys, F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def ordered_distinct(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """Each key's values in the order in which they come first."""
    firsts = df.groupBy(*keys, value).agg(F.min(position).alias("_at"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("items"))


def tally(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def weighted_mean(weights: DataFrame, scores: DataFrame, key: str, weight: str, score: str) -> DataFrame:
    """The mean of scores by weight; a key without a score counts as zero."""
    joined = weights.join(scores, key, "left")
    return joined.agg((F.sum(F.col(weight) * F.coalesce(F.col(score), F.lit(0.0))) / F.sum(weight)).alias("mean"))


def suffixed_repeats(df: DataFrame, keys: list[str], name: str, line: str, order: str) -> DataFrame:
    """df with `name` made unique: a repeat within the keys gets `@` and its line."""
    nth = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return df.withColumn("_nth", nth).withColumn(name, F.when(F.col("_nth") > 1, F.concat(F.col(name), F.lit("@"), F.col(line).cast("string"))).otherwise(F.col(name))).drop("_nth")


def dense_numbers(df: DataFrame, group: str, position: str, partition: list[str]) -> DataFrame:
    """df with `number`: 0, 1 ... for groups in the order of their first positions, within each partition."""
    first = F.min(position).over(Window.partitionBy(*partition, group))
    return df.withColumn("_first", first).withColumn("number", F.dense_rank().over(Window.partitionBy(*partition).orderBy("_first", group)) - 1).drop("_first")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def truncated(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, and in each `total`: how many there are."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total))
