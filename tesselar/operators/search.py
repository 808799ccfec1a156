"""Search over symbols: BM25, TF-IDF cosine, rank fusion, hybrid and substring search, name resolution and context.

Indexes are long tables of postings, partitioned by no document: a query filters them by its few terms before
anything is joined. The query's terms are a literal list. Ranks come from TakeOrdered with a total order.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.functions import text
from tesselar.graph import PropertyGraph

K1, B, NAME_BOOST, RRF_K = 1.2, 0.75, 2.0, 60
SMALL_COMMUNITY, UNKNOWN_SIZE, MOST_PROCESSES = 20, 100, 3


def tokenise(query: str) -> list[str]:
    """symbol_text() for the driver's query."""
    out, now = [], ""
    for c in query:
        if c in ":_/." or c.isspace():
            out, now = [*out, now], ""
        else:
            if c.isupper() and now:
                out, now = [*out, now], ""
            now += c
    return [x.lower() for x in [*out, now] if x]


@dataclass(frozen=True)
class Index:
    """postings: key, field, term, tf, length; totals: field, docs, mean_length (one row for each field)."""

    postings: DataFrame
    totals: DataFrame

    def write(self, path: str) -> None:
        """Sorted by term within files, so that a query's terms select row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "field", "key").write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))


def index(docs: DataFrame, key: str, fields: list[str]) -> Index:
    """Of the fields' words. A document counts in a field's totals even if it has no word there."""
    long = docs.select(F.col(key).alias("key"), F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), text.symbol_tokens(F.coalesce(f, F.lit(""))))])).alias("field", "terms"))
    lengths = long.select("key", "field", "terms", F.size("terms").alias("length"))
    postings = lengths.select("key", "field", "length", F.explode("terms").alias("term")).groupBy("key", "field", "term", "length").agg(F.count("*").alias("tf"))
    return Index(postings, lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")))


def bm25(idx: Index, query: str, limit: int | None, boosts: dict[str, float] | None = None) -> DataFrame:
    """key, score: the sum over fields and the query's terms, a repeated term once for each time."""
    times = Counter(tokenise(query))
    boosts = boosts or {"name": NAME_BOOST}
    hit = idx.postings.where(F.col("term").isin(list(times)))
    df = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    joined = hit.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(idx.totals), "field")  # as many rows as fields times terms
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weight = F.coalesce(_choose("field", boosts), F.lit(1.0)) * _choose("term", dict(times))
    scored = joined.groupBy("key").agg(F.round(F.sum(part * weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(limit) if limit else scored


def _choose(column: str, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(float(v))).otherwise(out)
    return out


def tfidf(docs: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights (key, term, w), vocabulary (term, idf) and norms (key, norm); words: an array of a document's words."""
    terms = docs.select(F.col(key).alias("key"), F.explode(words).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    most = F.max("tf").over(Window.partitionBy("key"))
    n = docs.agg(F.count("*").alias("n"))
    vocabulary = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    weights = terms.withColumn("most", most).join(vocabulary, "term").select("key", "term", ((0.5 + 0.5 * F.col("tf") / F.greatest("most", F.lit(1))) * F.col("idf")).alias("w"))
    return weights, vocabulary, weights.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine(weights: DataFrame, vocabulary: DataFrame, norms: DataFrame, query: str, limit: int | None) -> DataFrame:
    """key, score of the documents that share a term with the query. A term that no document has counts for the query's most frequent one, and nothing else."""
    times = Counter(tokenise(query))
    most = max(times.values(), default=1)
    asked = vocabulary.where(F.col("term").isin(list(times))).select("term", ((0.5 + 0.5 * _choose("term", dict(times)) / most) * F.col("idf")).alias("q"))
    norm = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = weights.join(F.broadcast(asked), "term").groupBy("key").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))  # as many rows as terms
    score = F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 6)
    scored = dots.join(norms, "key").crossJoin(F.broadcast(norm)).where("norm > 1e-10 and q_norm > 1e-10").select("key", score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "key").limit(limit) if limit else scored


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """key, rank of the best. The window has `limit` rows."""
    top = scored.orderBy(F.desc("score"), "key").limit(limit)
    return top.select("key", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank"))


def fuse(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """key, score: the sum of reciprocal ranks, moved by RRF_K."""
    first, *rest = [x.select("key", "rank") for x in lists]
    for x in rest:
        first = first.unionByName(x)
    out = first.groupBy("key").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return out.orderBy(F.desc("score"), "key").limit(limit) if limit else out


def boosted(hits: DataFrame, communities: DataFrame, processes: DataFrame, per_community: float, per_process: float) -> DataFrame:
    """hits with the score raised: for a small community, and for up to three processes.

    communities: key, community, size; processes: key, processes (each a row for a key at most).
    """
    joined = hits.join(communities, "key", "left").join(processes, "key", "left")
    small = F.when(F.col("community").isNotNull() & (F.coalesce("size", F.lit(UNKNOWN_SIZE)) < SMALL_COMMUNITY), per_community).otherwise(0.0)
    return joined.withColumn("score", F.col("score") + small + per_process * F.least(F.coalesce("processes", F.lit(0)), F.lit(MOST_PROCESSES)))


@dataclass(frozen=True)
class SearchIndex:
    """What hybrid() reads: the words' postings, and the weights, vocabulary and norms."""

    words: Index
    weights: DataFrame
    vocabulary: DataFrame
    norms: DataFrame

    @staticmethod
    def build(docs: DataFrame, key: str) -> SearchIndex:
        return SearchIndex(index(docs, key, ["name", "qualified_name"]), *tfidf(docs, key, document_words()))

    def write(self, path: str) -> None:
        """Weights and vocabulary are sorted by term within files, norms by key: a query reads few row groups."""
        self.words.write(path)
        for name, df, by in (("weights", self.weights, "term"), ("vocabulary", self.vocabulary, "term"), ("norms", self.norms, "key")):
            df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> SearchIndex:
        return SearchIndex(Index.read(spark, path), *[spark.read.parquet(f"{path}/{name}") for name in ("weights", "vocabulary", "norms")])


def hybrid(docs: DataFrame, query: str, limit: int, communities: DataFrame, processes: DataFrame, min_score: float = 0.0, key: str = "qualified_name", label: str | None = None, legacy_order: bool = False, built: SearchIndex | None = None) -> DataFrame:
    """key, score: both rankings fused, raised, cut off and put in order of the final score (legacy_order: of the fused one). built: the index of docs, else it is made."""
    known = built or SearchIndex.build(docs, key)
    by_words = bm25(known.words, query, limit * 3)
    by_weight = cosine(known.weights, known.vocabulary, known.norms, query, limit * 3)
    fused = fuse([ranked(by_words, limit * 3), ranked(by_weight, limit * 3)], limit * 2).withColumn("fused", F.col("score"))
    if label:
        fused = fused.join(docs.where(F.lower("label") == label.lower()).select(F.col(key).alias("key")), "key", "left_semi")
    out = boosted(fused, communities, processes, 0.002, 0.001).where(F.col("score") >= min_score)
    return out.orderBy(F.desc("fused" if legacy_order else "score"), "key").limit(limit).select("key", F.round("score", 6).alias("score"))


def document_words() -> Column:
    """The words of a symbol's name, label and qualified name."""
    return text.symbol_tokens(F.concat_ws(" ", "name", "label", "qualified_name"))


def term_score(term: Column, name: Column, qn: Column) -> Column:
    """How well a term fits a symbol; lengths are in bytes. All are in lower case."""
    in_name = 0.7 + 0.3 * F.octet_length(term) / F.octet_length(name)
    in_qn = 0.5 * (1 + F.octet_length(term) / F.octet_length(qn))
    return F.when(name == term, 1.0).when((name != "") & F.contains(name, term), in_name).when((qn != "") & F.contains(qn, term), in_qn).otherwise(0.0)


def substring(docs: DataFrame, query: str, limit: int, communities: DataFrame, processes: DataFrame, min_score: float = 0.01, key: str = "qualified_name") -> DataFrame:
    """key, score by the best fitting term; for use without an index."""
    terms = query.lower().split()
    lowered = docs.select(F.col(key).alias("key"), F.lower("name").alias("n"), F.lower("qualified_name").alias("q"))
    best = F.greatest(*[term_score(F.lit(t), F.col("n"), F.col("q")) for t in terms], F.lit(0.0))
    every = F.lit(len(terms) > 1)
    for t in terms:
        every = every & (F.contains("q", F.lit(t)) | F.contains("n", F.lit(t)))
    hits = lowered.select("key", (best + F.when(every, 0.1).otherwise(0.0)).alias("score"), best.alias("best")).where("best > 0")
    out = boosted(hits, communities, processes, 0.1, 0.05)
    return out.select("key", F.round(F.least("score", F.lit(1.0)), 6).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "key").limit(limit)


def resolve_name(nodes: DataFrame, name: str, ranks: Column) -> DataFrame:
    """Rows (how, id, label, qualified_name): the node of that name or id; else that of the name without its first folder; else up to five with the same leaf."""
    shorter = name.split("::")[0].partition("/")[2] + name[len(name.split("::")[0]) :] if "/" in name.split("::")[0] else None
    exact = lambda n: (F.col("qualified_name") == n) | (F.col("id") == n)
    how = F.when(exact(name), 0)
    if shorter:
        how = how.when(exact(shorter), 1)
    how = how.when(text.leaf(F.col("qualified_name")) == name.split("::")[-1], 2)
    found = nodes.select("id", "label", "qualified_name", how.alias("how"), ranks.alias("rank")).where("how is not null")
    # The least way is known from one aggregate; a window over all hits would gather them.
    least = found.agg(F.min("how").alias("least"))
    out = found.crossJoin(F.broadcast(least)).where("how = least").orderBy("rank", "qualified_name", "id").limit(5)
    nth = F.row_number().over(Window.orderBy("rank", "qualified_name", "id"))
    return out.withColumn("nth", nth).where("how = 2 or nth = 1").select(F.when(F.col("how") == 0, "exact").when(F.col("how") == 1, "stripped").otherwise("suggestion").alias("how"), "id", "label", "qualified_name")


def context(graph: PropertyGraph, node_id: str) -> DataFrame:
    """kind, direction, ids: a node's neighbours by kind of edge, sorted."""
    out = graph.edges.where(F.col("from_id") == node_id).select("kind", F.lit("out").alias("direction"), F.col("to_id").alias("id"))
    into = graph.edges.where(F.col("to_id") == node_id).select("kind", F.lit("in").alias("direction"), F.col("from_id").alias("id"))
    return out.unionByName(into).groupBy("kind", "direction").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def dense_top(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """key, score: the nearest by cosine of dense vectors. (The sparse index is the library's own; this serves tables of embeddings.)"""
    dot = F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, query)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = math.sqrt(sum(x * x for x in query))
    return vectors.select(F.col(key).alias("key"), F.round(dot / (norm * own), 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
