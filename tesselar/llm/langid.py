"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language comes from hashed trigrams of code points, of which the probabilities are
fitted on a bounded sample of labelled documents. The language that markup declares and the address's suffix have
likelihoods too, and the host a prior; these are learnt from all rows by grouped aggregation of the languages that the
texts suggest. Documents have no address: their source stands for a host without a domain, apart from any page's host of
that name. A host's prior is smoothed towards its domain's, and that towards the whole table's, so that a host
with one page leans on its parents; a row's own text is left out of its host's counts. The posterior is the product.

Null or empty texts have no likelihood of their own, null urls no host and no suffix, null declarations no evidence:
such rows get what the rest says. Repeated rows each get a row. Ties go to the language that comes first by name. Very
long texts are read whole; a text takes some 30 bytes a code point. Without labels the one language is `und`.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm import common

SAMPLE_ROWS = 1500  # the most labelled documents that the trigrams are fitted on
MOST_LABELS = 512  # beyond so many fit() fails, rather than drop some
BUCKETS = 1 << 15
TEXT_WEIGHT = 60  # a text counts as so many trigrams at most: neighbours aren't independent
SMOOTH, HOST_WEIGHT, DOMAIN_WEIGHT = 0.5, 8.0, 20.0
BROADCAST_ROWS = 100_000
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def buckets(text: str) -> np.ndarray:
    """The buckets of the text's trigrams, lower-cased, with what is not a letter as one space."""
    points = np.frombuffer((" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode("utf-32-le"), dtype=np.uint32)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = points[:-2] * np.uint32(0x9E3779B1) ^ points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64) % BUCKETS


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """The languages, and the log probabilities of buckets by language.

    The languages are all labels of rows whose texts have a letter. The sample is of SAMPLE_ROWS rows at most: all, if
    there are no more, else SAMPLE_ROWS are shared out evenly by label, and what rare labels leave goes to the others. Of
    each label those rows with the least hashes are taken; only rows with a hash under a threshold are ranked.
    """
    known = labelled.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key), F.col(text), F.lit(7)).alias("hash"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("n", "lang").limit(MOST_LABELS + 1).collect()
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages among the labels")
    if not sizes:
        return ["und"], np.zeros((1, BUCKETS))
    left, asked = SAMPLE_ROWS, []
    for i, r in enumerate(sizes):
        quota = min(r["n"], left // (len(sizes) - i))
        left -= quota
        share = 1.0 if quota == r["n"] else min(1.0, (4 * quota + 40) / r["n"])  # four times as many and 40 more, so that enough are under it
        asked.append((r["lang"], quota, int(share * (1 << 40))))
    side = F.broadcast(labelled.sparkSession.createDataFrame(asked, "lang string, quota int, under long"))
    under = known.join(side, "lang").where(F.pmod("hash", F.lit(1 << 40)) < F.col("under"))
    ranked = under.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "hash")))
    sample = ranked.where("nth <= quota").select("text", "lang")

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                where, n = np.unique(buckets(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # of a bounded sample
    place = {name: i for i, name in enumerate(sorted(r["lang"] for r in sizes))}
    if missing := place.keys() - {r["lang"] for r in counts}:  # a label of many equal rows
        raise ValueError(f"no row of {sorted(missing)} in the sample")
    languages = list(place)
    table = np.full((len(languages), BUCKETS), SMOOTH)
    for r in counts:
        table[place[r["lang"]], r["bucket"]] += r["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def visible(html: str) -> str:
    return _TAGS.sub(" ", html)


def with_likelihood(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", markup: bool = False) -> DataFrame:
    """df with ll, an array of the log likelihoods of the text by language, in place of the text."""
    languages, log = model
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(log.T.astype(np.float32)))

    def made(column: pa.Array) -> list[pa.Array]:
        out = []
        for t in common.strings(column):
            at = buckets(visible(t) if markup else t)
            out.append((shared.value[at].mean(axis=0, dtype=np.float64) * min(len(at), TEXT_WEIGHT)).tolist() if len(at) else [0.0] * len(languages))
        return [pa.array(out, pa.list_(pa.float64()))]

    return common.append_arrow(df, text, [T.StructField("ll", T.ArrayType(T.DoubleType()))], made, drop=True)


def _zip_sum(*arrays: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)


def _best(ll: Column) -> Column:
    """The place of the first greatest number."""
    return F.array_position(ll, F.array_max(ll)).cast("int") - 1


def _counts(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The columns by, and n_ of the first of them: an array of rows by the language that the text suggests."""
    return rows.groupBy(*by).agg(*[F.sum((F.col("best") == i).cast("double")).alias(f"n{i}") for i in range(k)]).select(*by, F.array(*[f"n{i}" for i in range(k)]).alias(f"n_{by[0]}"))


def _bounded(df: DataFrame) -> DataFrame:
    df = common.cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """rows (ll, declared, suffix, domain, host and others) with lang, confidence and text_lang, without ll.

    Evidence tables are broadcast under a bound on their rows; beyond it both sides are shuffled.
    """
    k = len(languages)
    rows = rows.withColumn("best", F.when(F.array_max("ll") > F.array_min("ll"), _best(F.col("ll"))))
    seen = rows.where("best is not null")
    root = [float(x or 0) for x in seen.agg(*[F.sum((F.col("best") == i).cast("double")) for i in range(k)]).first()]
    prior = F.array(*[F.lit((n + SMOOTH) / (sum(root) + SMOOTH * k)) for n in root])
    totals = F.array(*[F.lit(n + 1.0) for n in root])
    like = {}
    for by in ("declared", "suffix"):  # log P(value | language), towards P(value)
        n = _counts(seen.where(F.col(by) != ""), [by], k)
        share = F.aggregate(f"n_{by}", F.lit(0.0), lambda a, x: a + x) / F.lit(sum(root) + 1.0)
        like[by] = _bounded(n.select(by, F.zip_with(f"n_{by}", totals, lambda x, t: F.log((x + SMOOTH * F.greatest(share, F.lit(1e-9))) / (t + SMOOTH))).alias(f"l_{by}")))
    # A host is known by its name and domain together: a source that is named like a host has no domain, and stays apart.
    placed = seen.where("host <> ''")
    hosts = _counts(placed, ["host", "domain"], k).join(_counts(placed, ["domain"], k), "domain").select("host", "domain", "n_host", "n_domain")
    joined = rows.join(like["declared"], "declared", "left").join(like["suffix"], "suffix", "left").join(_bounded(hosts), ["host", "domain"], "left")
    zero = F.array(*[F.lit(0.0)] * k)
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(F.col("best") == i, 1.0).otherwise(0.0))
    others = lambda n: F.zip_with(F.coalesce(n, zero), own, lambda x, o: F.greatest(x - o, F.lit(0.0)))
    whole = lambda n: F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("d", others(F.col("n_domain"))).withColumn("h", others(F.col("n_host")))
    joined = joined.withColumn("pd", F.zip_with("d", prior, lambda n, p: (n + DOMAIN_WEIGHT * p) / (whole(F.col("d")) + DOMAIN_WEIGHT)))
    joined = joined.withColumn("ph", F.zip_with("h", "pd", lambda n, p: (n + HOST_WEIGHT * p) / (whole(F.col("h")) + HOST_WEIGHT)))
    log = _zip_sum(F.col("ll"), F.coalesce("l_declared", zero), F.coalesce("l_suffix", zero), F.transform("ph", lambda x: F.log(x)))
    joined = joined.withColumn("log", log)
    named = F.array(*map(F.lit, languages))
    mass = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("log")))
    return joined.select(*[c for c in rows.columns if c not in ("ll", "best")], F.get(named, _best(F.col("log"))).alias("lang"), F.round(1 / mass, 6).alias("confidence"), F.get(named, F.col("best")).alias("text_lang"))


def address(url: Column) -> tuple[Column, Column, Column]:
    """host, domain (its last two labels) and suffix (the last one)."""
    from tesselar.llm.linkgraph import host_path

    host = F.regexp_replace(host_path(url)[0], r"^.*@|:\d*$", "")
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def pages_rows(pages: DataFrame) -> DataFrame:
    host, domain, suffix = address(F.col("url"))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.col("html").alias("text"))


def documents_rows(docs: DataFrame) -> DataFrame:
    """Documents have no address and declare nothing; their source stands for a host."""
    source = F.coalesce("source", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.lit("").alias("declared"), source.alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"), "text")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id or page_id, declared, host, domain, suffix, lang, confidence, text_lang of every page and every document."""
    docs, pages = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = fit(docs)
    rows = with_likelihood(pages_rows(pages), model, markup=True).unionByName(with_likelihood(documents_rows(docs), model))
    return fuse(common.stash(rows, "likelihoods"), model[0])
