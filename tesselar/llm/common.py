"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only by a local session that names no shared folder, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir; registered as Spark's checkpoint folder.

    A session on a cluster must name it: a folder of one machine would be lost with it, and others couldn't read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stash(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back; survives the loss of any executor.

    Columns that aren't used aren't read, and the planner knows the table's size. (checkpoint() would compute df twice, and
    keep the size that was estimated before, which loops multiply until planning fails.)
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tesselar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out.tesselar_path = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """df, computed once; for small tables and loops."""
    return stash(df, "cut")


def discard(df: DataFrame) -> None:
    """Deletes a table that stash() or cut() wrote, when nothing will read it again."""
    jvm, path = df.sparkSession._jvm, df.tesselar_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less its columns of these names, in whatever case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: What an operator in Python holds at once, with what it makes of it: rows, and bytes of text unless one row has more.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


#: Bytes of a batch between Spark and Python, unless the session says otherwise; Spark's own 64 MB are held several times by each task.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Makes Spark's Arrow batches small, so that tasks of texts need little memory besides the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, ARROW_BYTES)


def slices(batches: Iterator[pa.RecordBatch], at: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of `rows` rows and SLICE_BYTES in column `at` at most; a row is never cut."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))
        ends, k = np.cumsum(sizes), 0
        while k < batch.num_rows:
            n = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SLICE_BYTES, side="right")) - k
            n = max(1, min(n, rows))
            yield batch.slice(k, n)
            k += n


def append_arrow(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[pa.Array], list[pa.Array]], drop: bool = False) -> DataFrame:
    """df with the columns that fn makes of the column `text`, one Arrow slice at a time.

    Columns of df with the new names are replaced; drop: the text itself isn't given back.
    """
    bounded_batches(df.sparkSession)
    base = without(df, [f.name for f in fields if f.name.lower() != text.lower()])
    at = next(i for i, c in enumerate(base.columns) if c.lower() == text.lower())
    gone = drop or any(f.name.lower() == text.lower() for f in fields)
    left = [f for i, f in enumerate(base.schema.fields) if not (gone and i == at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            old = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if not (gone and i == at)]
            yield pa.RecordBatch.from_arrays([c for _, c in old] + fn(batch.column(at)), names=[n for n, _ in old] + [f.name for f in fields])

    return base.mapInArrow(run, T.StructType(left + fields))


def filter_arrow(df: DataFrame, text: str, fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of df for which fn gives true, from the column `text`."""
    bounded_batches(df.sparkSession)
    at = next(i for i, c in enumerate(df.columns) if c.lower() == text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(fn(batch.column(at)))

    return df.mapInArrow(run, df.schema)


def strings(column: pa.Array) -> list[str]:
    """The column's texts; a null is an empty one."""
    return [x or "" for x in column.to_pylist()]


def row_key(*cols: str) -> Column:
    """128 bits of the row's identity, as two longs: rows of one key are taken to be equal in these columns."""
    told = [x for c in cols for x in (F.isnull(F.col(c)), F.col(c))]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(0x9E3779B97F4A7C1), *told).alias("b"))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The rows of df as one column `row`, and more columns, which so can't clash with those of df."""
    return df.select(*[c.alias(n) for n, c in more.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def side(df: DataFrame, most: int) -> DataFrame:
    """df, computed once; for a join it is sent to all tasks if its rows, counted, are no more than `most`."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def ascii_lower(word: Column) -> Column:
    """word with A-Z in lower case and nothing else changed; lower() is the quick way where all is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, ASCII_UPPER, ASCII_LOWER))


class Bloom:
    """A Bloom filter of 64-bit hashes for use in expressions: a literal array of longs, two bits for each hash.

    It has 64 bits for each hash, between 2^MIN_BITS and 2^MAX_BITS in all (8 MB), so its size is bounded; at 8 million
    hashes one in twenty others passes. What passes must be verified.
    """

    MIN_BITS, MAX_BITS = 12, 26

    def __init__(self, hashes: DataFrame, n: int):
        self.power = min(self.MAX_BITS, max(self.MIN_BITS, (64 * n).bit_length()))
        h = F.col("h")
        places = hashes.toDF("h").where("h is not null").select(F.explode(F.array(self._low(h), self._high(h))).alias("at"))
        cells = places.select(F.expr("cast(at div 64 as int)").alias("cell"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("v"))
        values = [0] * (1 << self.power - 6)
        for cell, v in cells.collect():  # at most 2^20 cells
            values[cell] = v
        self.table = F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")

    def _low(self, h: Column) -> Column:
        return h.bitwiseAND(F.lit((1 << self.power) - 1))

    def _high(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit((1 << self.power) - 1))

    def has(self, h: Column) -> Column:
        bit = lambda at: F.getbit(F.get(self.table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
        return bit(self._low(h)) & bit(self._high(h))
