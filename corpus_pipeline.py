"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet
and read as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselar.llm import bpe, common, decontaminate, nearcopies, quality, secrets


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null texts have no words and go, as do empty and short ones. Very long texts are measured whole. Repeated rows are
    judged alike, each for itself. An empty table stays empty. Other columns are kept, whatever their names.
    """
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of 0.8 or more.

    The document with the least id stays (null ids come last, ties go by the other columns). Null texts count as empty,
    and all texts without words are one group. Very long texts are compared whole. Repeated rows are copies: one stays.
    An empty table stays empty. Other columns are kept, whatever their names.
    """
    return nearcopies.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.

    Null and empty texts have no windows and stay. Very long texts are scanned whole. Repeated rows go or stay together.
    An empty table, or benchmark, removes nothing. Other columns are kept, whatever their names.
    """
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts, and n_chars set anew where that is a column.

    Null and empty texts stay as they are. Very long texts are scanned whole. Of spans that overlap the first and longest
    cover is replaced once. Repeated rows are redacted alike. An empty table stays empty. Other columns are kept.
    """
    return secrets.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids and offsets, in place of their texts, and the bytes that the ids decode to.

    Null texts are empty: no ids. Very long texts are encoded whole, part by part. Repeated rows each get their ids. An
    empty table stays empty. Columns named like the new ones are replaced, others kept.
    """
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, decoded=True, drop=True)


STAGES = [("quality rules", good), ("SimHash near-dedup", distinct), ("benchmark decontamination", clean), ("secret scans", safe), ("byte-level BPE", tokens)]

#: SQL has no XXH64 with a seed and no byte-pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of documents."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = common.stash(docs, f"stage{k}")
    return docs
