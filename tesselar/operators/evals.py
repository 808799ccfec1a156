"""Scores of answers against ground truth, and their weighted report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The evaluation's queries, how each is scored, and its weight.
WEIGHTS = {"q1": 0.0833, "q2": 0.0833, "q3": 0.0833, "q4": 0.10, "q5": 0.10, "q6": 0.10, "q7": 0.15, "q8": 0.025, "q9": 0.10, "q10": 0.025, "q11": 0.025, "q12": 0.05, "q13": 0.10, "q14": 0.025}
SCORED = {"exact": ["q1", "q2", "q3", "q10"], "f1": ["q4", "q5", "q6", "q7", "q8", "q9", "q11", "q14"], "ari": ["q12"], "pr_mean": ["q13"]}
TARGET, FLOOR = 0.85, 0.75


def exact(expected: Column, actual: Column) -> Column:
    """1 if equal but for case and outer space."""
    return F.when(F.lower(F.trim(expected)) == F.lower(F.trim(actual)), 1.0).otherwise(0.0)


def _overlap(expected: Column, actual: Column) -> tuple[Column, Column, Column]:
    e, a = F.array_distinct(F.coalesce(expected, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(actual, F.array().cast("array<string>")))
    return F.size(F.array_intersect(e, a)), F.size(e), F.size(a)


def f1(expected: Column, actual: Column) -> Column:
    """Of two sets in arrays; two empty ones agree."""
    both, e, a = _overlap(expected, actual)
    return F.when((e == 0) & (a == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (e + a))


def precision_recall_mean(flagged: Column, truth: Column) -> Column:
    both, t, f = _overlap(truth, flagged)
    return F.when((t == 0) & (f == 0), 1.0).otherwise((F.when(f > 0, both / f).otherwise(0.0) + F.when(t > 0, both / t).otherwise(0.0)) / 2)


def f1_of(expected: DataFrame, actual: DataFrame, by: list[str], item: str) -> DataFrame:
    """The same for sets as rows: by, score."""
    sides = expected.select(*by, item, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*by, item, F.lit(0).alias("e"), F.lit(1).alias("a")))
    items = sides.groupBy(*by, item).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    both = F.sum(F.col("e") * F.col("a"))
    return items.groupBy(*by).agg(F.round(2.0 * both / (F.sum("e") + F.sum("a")), 6).alias("score"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row, score: the adjusted Rand index of two labellings of the same rows. Only the contingency table is shuffled."""
    pick = lambda n: F.col(n).cast("double") * (F.col(n) - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum(pick("n")).alias("cells"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pick("n")).alias("rows"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pick("n")).alias("cols"))
    row = total.crossJoin(rows).crossJoin(cols)  # one row each
    expected, most = F.col("rows") * F.col("cols") / pick("n"), 0.5 * (F.col("rows") + F.col("cols"))
    score = F.when(pick("n") == 0, 0.0).when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("cells") - expected) / (most - expected))
    return row.select(F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


def weighted(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, score, reaches_floor, reaches_target: the weighted mean over all of WEIGHTS; a query without a score counts as 0."""
    spark = scores.sparkSession
    weights = spark.createDataFrame(list(WEIGHTS.items()), "query_id string, weight double")
    asked = scores.select(*by).distinct().crossJoin(F.broadcast(weights))  # a row for each group and query
    means = scores.groupBy(*by, "query_id").agg(F.avg("score").alias("score"))
    joined = asked.join(means, [*by, "query_id"], "left")
    mean = F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))) / F.sum("weight")
    return joined.groupBy(*by).agg(F.round(mean, 6).alias("score"), (mean >= FLOOR).alias("reaches_floor"), (mean >= TARGET).alias("reaches_target"))


def overall(by_corpus: DataFrame, language: str = "language") -> DataFrame:
    """One row: the mean over corpora weighted by samples, and the language of the least mean. by_corpus: corpus, language, score, samples."""
    languages = by_corpus.groupBy(language).agg((F.sum(F.col("score") * F.col("samples")) / F.sum("samples")).alias("mean"))
    whole = by_corpus.agg(F.round(F.sum(F.col("score") * F.col("samples")) / F.sum("samples"), 6).alias("mean"))
    return whole.crossJoin(languages.agg(F.min_by(language, F.struct("mean", language)).alias("weakest"), F.round(F.min("mean"), 6).alias("weakest_mean")))
