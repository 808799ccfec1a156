"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The rows are written once, which fixes their partitions and places. Row i of the matrix says how many rows partition i
sends to each shard: a multivariate hypergeometric draw from what the shards still lack, so that rows and columns sum
to the partitions' and the shards' sizes. Each partition deals the shards out to its places by a random permutation of
just these counts. The rows are exchanged, and each shard is permuted again: its rows are ordered by a random number,
in cells of rows with close numbers, which are tasks of even size however large a shard is.

Law: `rows`; the shards' counts are at most one apart. All draws follow from the seed. Equal rows are shuffled like
others. Nulls don't matter. Columns of the input named shard or slot are replaced, others are kept, whatever their names.
An empty table gives an empty table. Very long texts go along as they are. The driver holds, and sends to the tasks, a count
for each shard and partition of the table that is read, so as many as tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm import common

SHARDS, SEED = 8, 20_240_229
CELL_ROWS, LEAST_CELLS = 100_000, 64  # a shard's cells have about so many rows, and are at least so many
PLACE_BITS = 33  # of monotonically_increasing_id(): below them a row's place, above them its partition
BROADCAST_CELLS = 500_000
NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` of good + bad are good. Beyond numpy's limit: inversion over all but 1e-20 of the mass."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    if not drawn or not good or not bad or drawn == good + bad:
        return drawn if not bad or drawn == good + bad and not bad else (good if drawn == good + bad else 0)
    total = good + bad
    mean = drawn * good / total
    sd = math.sqrt(mean * bad / total * (total - drawn) / max(1, total - 1))
    low, high = max(0, drawn - bad, int(mean - 10 * sd - 20)), min(good, drawn, int(mean + 10 * sd + 20))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(log - log.max())
    return low + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum()))


def matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts by partition and shard. Each row sums to the partition's, each column to the shard's rows; all such are as likely as in a uniform shuffle."""
    total = sum(rows)
    lack = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng([seed, 0])
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(lack)
        for s in range(shards):
            rest -= lack[s]
            out[i, s] = hypergeometric(rng, lack[s], rest, n)
            n -= int(out[i, s])
        lack = [a - int(b) for a, b in zip(lack, out[i], strict=True)]
    return out


def _deal(rows: DataFrame, parts: dict[int, int], counts: np.ndarray, seed: int) -> DataFrame:
    """rows (with _place) and each one's shard."""
    shared = rows.sparkSession.sparkContext.broadcast((parts, counts))  # one row for each partition of the table
    at = rows.columns.index("_place")

    def run(batches):
        index, table = shared.value
        now, dealt = None, None
        for batch in batches:
            place = batch.column(at).to_numpy()
            part, row = place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)
            shard = np.empty(len(place), dtype=np.int32)
            for p in np.unique(part).tolist():
                if p != now:
                    now, dealt = p, np.repeat(np.arange(table.shape[1], dtype=np.int32), table[index[p]])
                    np.random.default_rng([seed, 1, p]).shuffle(dealt)
                mine = part == p
                shard[mine] = dealt[row[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard)."""
    base = common.without(df, ["shard", "slot"])
    rows = common.stash(common.packed(base, _place=F.monotonically_increasing_id()), "rows")
    part = F.shiftrightunsigned("_place", PLACE_BITS)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    counts = matrix([n for _, n in sizes], shards, seed)
    parts = {p: i for i, (p, _) in enumerate(sizes)}
    cells = max(LEAST_CELLS, -(-total // (shards * CELL_ROWS)))
    random = F.xxhash64("_place", F.lit(seed))
    # In the order of cells, and in a cell by the random number: together a random order of the shard.
    cell = F.pmod(F.shiftrightunsigned(random, 20), F.lit(cells)).alias("_cell")
    filled = _deal(rows.select("_place"), parts, counts, seed).select("shard", cell).groupBy("shard", "_cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = filled.select("shard", "_cell", before.alias("_first"))
    side = F.broadcast(first) if shards * cells <= BROADCAST_CELLS else first
    dealt = _deal(rows, parts, counts, seed).select("*", cell, random.alias("_random"))
    nth = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_random", "_place")).cast("long")
    placed = dealt.withColumn("_nth", nth).join(side, ["shard", "_cell"])
    return placed.select(*[F.col(f"row.`{c}`") for c in base.columns], "shard", (F.col("_first") + F.col("_nth") - 1).alias("slot"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    docs = common.documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
