"""Benchmark decontamination, by DataFrame functions only.

The benchmark's windows of WINDOW normalised words (of a shorter item, all its words) are a set of n-grams. Its
hashes go to the scan as a Bloom filter of bounded size; a training window of which the hash is in it is a candidate and
takes its words along. Candidates are verified against the n-grams themselves, broadcast if they are few, else joined by
shuffle. Hits give the words covered and the items met; documents or spans are then removed.

Null texts have no words, nor have null items windows. Items with a null id cover words but are not counted as items.
Items that share an id count once. Repeated rows each get a row. Other columns of the input don't matter, whatever
their names. Very long texts are scanned whole; their words are held as one array in memory, as is their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import common

WINDOW, MIN_ITEMS = 8, 2
#: What words are made of before A-Z are lower-cased, and what separates them: ASCII less digits and letters.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_GRAMS = 200_000
BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def run_hash(hashes: Column, at: Column, n: int) -> Column:
    """The hash of n words from a place on, by the words' hashes."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(n)])


def hash_of(words: Column, lengths: list[int]) -> Column:
    """The same of all words of an array that has one of these lengths."""
    hashes = word_hashes(words)
    return F.coalesce(*[F.when(F.size(words) == n, run_hash(hashes, F.lit(0), n)) for n in lengths])


def runs_in(hashes: Column, n: int, bloom: common.Bloom) -> Column:
    """The places of runs of n words of which the hash is in the filter."""
    last = F.size(hashes) - n
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: bloom.has(run_hash(hashes, i, n)))).otherwise(F.array().cast("array<int>"))


def benchmark_grams(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """gram (words, space-joined), len (words in it), items (ids as strings) of every window; computed once."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    grams = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, WINDOW))).alias("g"))
    return common.cut(grams.groupBy(F.array_join("g", " ").alias("gram"), F.size("g").alias("len")).agg(F.sort_array(F.collect_set("item")).alias("items")))


CANDIDATES = "array<struct<pos:int,len:int,gram:string>>"


def _candidates(w: Column, lengths: list[int], bloom: common.Bloom) -> Column:
    """The places, lengths and words of windows of which the hash is in the filter. Words are hashed once, and windows by these hashes."""

    def at(hashes: Column, n: int) -> Column:
        return F.transform(runs_in(hashes, n, bloom), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i + 1, n), " ").alias("gram")))

    return F.transform(F.array(word_hashes(w)), lambda hashes: F.concat(*[at(hashes, n) for n in lengths]))[0]


def scan(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", min_items: int = MIN_ITEMS) -> DataFrame:
    """One row for each of df: doc_id, key (its row's), n_words, n_hit, n_items (long), items (ids as sorted strings), spans (of words hit, end exclusive), contaminated."""
    grams = benchmark_grams(items)
    lengths = sorted(r[0] for r in grams.select("len").distinct().collect())  # 1 to WINDOW
    n_grams = grams.count()
    # The words are bound by a lambda, so that they are found once a text and stay a plain array.
    if lengths:
        bloom = common.Bloom(grams.select(hash_of(F.split("gram", " "), lengths)), n_grams)
        found = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _candidates(w, lengths, bloom).alias("c")))
    else:
        found = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.array().cast(CANDIDATES).alias("c")))
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = slim.select("doc_id", common.row_key("doc_id", "text").alias("key"), found[0].alias("f"))
    rows = common.stash(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "key", "f.n_words", "f.c"), "windows")
    side = F.broadcast(grams) if n_grams <= BROADCAST_GRAMS else grams
    hits = rows.where("size(c) > 0").select("rid", F.explode("c").alias("c")).select("rid", "c.pos", "c.len", "c.gram").join(side, ["gram", "len"])
    hits = hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("at"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["pos"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["pos"] + x["len"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["pos"].alias("start"), (x["pos"] + x["len"]).alias("end"))))),
    )
    hits = hits.select("rid", "items", merged.alias("spans"))
    none = F.array().cast("array<string>")
    out = rows.drop("c").join(hits, "rid", "left").select("doc_id", "key", "n_words", F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    out = out.select("doc_id", "key", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return common.packed(df, key=common.row_key(doc_id, text))


def remove_documents(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", min_items: int = MIN_ITEMS) -> DataFrame:
    """df less the rows in which windows of min_items items or more occur."""
    bad = common.side(scan(df, items, doc_id, text, min_items).where("contaminated").select("key").distinct(), BROADCAST_KEYS)
    return common.unpacked(_keyed(df, doc_id, text).join(bad, "key", "left_anti"))


def remove_spans(df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the words that windows cover taken out of the texts, each with what separates it from the next."""
    found = common.side(scan(df, items, doc_id, text, 1).where("n_hit > 0").groupBy("key").agg(F.first("spans").alias("spans")), BROADCAST_KEYS // 10)
    joined = _keyed(df, doc_id, text).join(found, "key", "left")
    whole = F.col(f"row.`{text}`")
    seps, words = F.split(whole, WORD, -1), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    pairs = F.arrays_zip(words.alias("w"), F.slice(seps, 2, F.size(words)).alias("s"))
    rest = F.transform(pairs, lambda p, i: F.when(F.exists("spans", lambda x: (x["start"] <= i) & (i < x["end"])), F.lit("")).otherwise(F.concat(p["w"], p["s"])))
    cleaned = F.when(F.col("spans").isNull(), whole).otherwise(F.concat(seps[0], F.array_join(rest, "")))
    return joined.select(*[cleaned.alias(c) if c.lower() == text.lower() else F.col(f"row.`{c}`") for c in df.columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = scan(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH lower_d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
lower_b AS (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
dw AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM lower_d),
bw AS (SELECT item_id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM lower_b),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS gram, least(len(w), 8) AS n FROM bi),
sizes AS (SELECT DISTINCT n FROM grams),
di AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM di),
hits AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN grams ON dg.gram = grams.gram AND dg.n = grams.n),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
