"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has 64 bits. Those that differ in at most RADIUS bits are linked. Fingerprints are cut into
blocks of bits; linked ones agree in some choice of whole blocks, so each choice is a table of buckets, and every
link lies in some bucket (no link is missed). A bucket keeps its fingerprints as 64 vertical bit planes; a query
fingerprint meets 64 others in one machine word. Differing bits are added by carry-save counters, plane by plane, and
a word is abandoned once all its 64 distances exceed the radius.

Scale: only distinct fingerprints are compared. The number of blocks grows with their number so that buckets stay
small; a bucket that is large all the same is dealt out as pairs of its parts. A task returns a star for each group
it finds, not its pairs.

Null texts count as empty and have the fingerprint 0, as do texts without words; that one is linked like any other.
Rows with a null id get their group's id, and count as no id of a group. Repeated rows each get a row. Very long texts
count whole: a text's words and hashes take some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm import common
from tesselar.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
BUCKET = 256  # buckets' mean size stays under this
HOT, PART = 2048, 1024  # a bucket beyond HOT rows is dealt out in parts of about PART rows
BATCH_ROWS, LOT_BYTES = 1 << 16, 24 << 20  # a task compares about so many rows, or bytes of them, at once
UNITS = 1 << 16
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, in their order; a text of fewer words is one shingle, one of none has none."""
    words = text.encode().lower().split()  # bytes: A-Z only; at 0x20 and 0x09-0x0D only
    n = len(words)
    if not n:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits: each is 1 if set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        counts += np.unpackbits(hashes[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """The 64 bits: each is 1 if set in over half the hashes of the text's shingles."""
    return majority(shingle_hashes(text))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", drop: bool = False) -> DataFrame:
    """df with its texts' fingerprints as (signed) longs; drop: without the texts."""

    def made(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t) for t in common.strings(column)], dtype=np.uint64).view(np.int64), pa.int64())]

    return common.append_arrow(df, text, [T.StructField(out, T.LongType())], made, drop)


def scheme(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """How many blocks the bits are cut into, and how many of them make a bucket's key, for n fingerprints."""
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < 44 and n > BUCKET << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks, blocks - radius


def bucket_keys(fp: Column, blocks: int, choose: int) -> Column:
    """An array of (table, key): one for each choice of blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), choose)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        keys.append(F.struct(F.lit(number).alias("t"), fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64))).alias("k")))
    return F.array(*keys)


def close(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS, units: int = UNITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places a < b of one group of which the fingerprints differ in at most radius bits, in lots of 64 * units at most.

    groups: equal numbers stand together. The words of planes never span groups.
    """
    n = len(fps)
    if not n:
        return
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    which = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[which]
    slot = (base[which] + place // 64) * 64 + place % 64
    total = int(words.sum())
    planes = np.empty((64, total), dtype=np.uint64)
    lanes = np.zeros(total * 64, dtype=np.uint8)
    for b in range(64):
        lanes[slot] = (fps >> np.uint64(b)) & np.uint64(1)
        planes[b] = np.packbits(lanes, bitorder="little").view("<u8")
    filled = np.zeros(total * 64, dtype=np.uint8)
    filled[slot] = 1
    filled = np.packbits(filled, bitorder="little").view("<u8")
    at = np.full(total * 64, -1, dtype=np.int64)
    at[slot] = np.arange(n)
    # A fingerprint meets the words from its own on.
    meets = words[which] - place // 64
    width = radius.bit_length()
    begin = 0
    upto = np.cumsum(meets)
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + units, side="right")))
        many = meets[begin:end]
        query = np.repeat(np.arange(begin, end), many)
        word = np.repeat(slot[begin:end] // 64, many) + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
        over = ~filled[word]
        counter = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - ((fps[query] >> np.uint64(b)) & np.uint64(1)))
            for k in range(width):  # carry-save addition of one bit in each lane
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 7:
                above = over.copy()
                if b >= radius:
                    above |= exceeds(counter, radius)
                live = above != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not live.all():
                    query, word, over = query[live], word[live], over[live]
                    counter = [c[live] for c in counter]
                if not len(query):
                    break
        if len(query):
            near = ~(over | exceeds(counter, radius))
            unit, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b2 = query[unit], at[word[unit] * 64 + lane]
            later = b2 > a
            yield a[later], b2[later]
        begin = end


def exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes of which the counter is over radius."""
    more, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            more |= equal & counter[k]
            equal &= ~counter[k]
    return more


def stars(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least place of each place's component; root: the same from earlier links."""
    if root is None:
        root = np.arange(n)
    else:
        a, b = np.concatenate([a, np.arange(n)]), np.concatenate([b, root])
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: int, most: int, most_bytes: int) -> Iterator[pa.Table]:
    """Lots of about most rows or most_bytes; rows that agree in the first columns, keys of them, come together and stay so."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < most and held.nbytes < most_bytes:
            continue
        same = np.logical_and.reduce([(c := held.column(i).to_numpy()) == c[-1] for i in range(keys)])
        if same.all():
            continue
        last = len(same) - int(np.argmin(same[::-1]))  # where the bucket that may go on begins
        lot, held = held.slice(0, last).combine_chunks(), held.slice(last).combine_chunks()
        yield lot
        del lot
    if held is not None and held.num_rows:
        lot, held = held.combine_chunks(), None
        yield lot


def numbered(keys: list[np.ndarray]) -> np.ndarray:
    """A number for each row's bucket; rows of one bucket stand together."""
    stacked = np.stack(keys)
    return np.cumsum(np.concatenate([[0], (stacked[:, 1:] != stacked[:, :-1]).any(axis=0)]))


def _compare(batches):
    """From rows (t, k, i, j, fp), a bucket's together, to stars (u, v) of linked fingerprints."""
    for lot in whole_buckets(batches, 4, BATCH_ROWS, LOT_BYTES):
        cols = [c.to_numpy() for c in lot.columns]
        fps, root = cols[-1].view(np.uint64), None
        for a, b in close(fps, numbered(cols[:-1])):
            root = stars(len(fps), a, b, root)
        if root is None:
            continue
        linked = np.flatnonzero(root != np.arange(len(fps)))
        u, v = fps[linked].view(np.int64), fps[root[linked]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def dealt(rows: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """rows (t, k and others) with i, j: each bucket has 0, 0; a large one is dealt out as pairs of its parts, by the column named.

    Large are buckets of more than HOT rows, or with a sum of weight (bytes that are joined to the rows later) over LOT_BYTES.
    """
    rest = [c for c in rows.columns if c not in ("t", "k")]
    plain = lambda df: df.select("t", "k", F.lit(0).alias("i"), F.lit(0).alias("j"), *rest)
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n"), F.sum(F.lit(0) if weight is None else weight).alias("w"))
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(2 * F.col("w") / LOT_BYTES)).cast("int")
    hot = common.cut(sizes.where((F.col("n") > HOT) | (F.col("w") > LOT_BYTES)).select("t", "k", parts.alias("parts")))
    n_hot = hot.count()
    if not n_hot:
        return plain(rows)
    # Under a bound of 100,000 hot buckets they are sent to all tasks; beyond it both sides are shuffled.
    marked = rows.join(F.broadcast(hot) if n_hot <= 100_000 else hot, ["t", "k"], "left")
    own = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    split = marked.where("parts is not null").select("t", "k", *rest, F.explode(met).alias("p")).select("t", "k", "p.i", "p.j", *rest)
    return plain(marked.where("parts is null")).unionByName(split)


def linked(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """u, v: links between distinct fingerprints that together connect all that are linked, directly or through others."""
    distinct = common.cut(fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct())
    blocks, choose = scheme(distinct.count())
    rows = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), blocks, choose)).alias("b")).select("b.t", "b.k", "fp")
    keys = ["t", "k", "i", "j"]
    return dealt(rows, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, "u long, v long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rid: Column | None = None, tie: Column | None = None) -> DataFrame:
    """One row for each of df: doc_id, rid (the row's number: that given, or one of its own), tie (the order of rows with one id), fp (long), component_id (the least id of the component) and first (whether it is the one row that a component keeps)."""
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"))
    rows = common.stash(with_fingerprint(slim, drop=True), "fingerprints")
    return grouped(rows, components(linked(rows), "u", "v"), "fp")


def grouped(rows: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """doc_id, rid, by, component_id and first for rows (doc_id, rid, tie and by); roots: node, root for the values of by that are linked."""
    roots = common.cut(roots)
    least = rows.groupBy(by).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie", "rid")).alias("least"))
    groups = common.cut(least.join(roots.withColumnRenamed("node", by), by, "left").select(by, F.coalesce("root", by).alias("root"), "least"))
    heads = common.cut(groups.groupBy("root").agg(F.min("least").alias("head")))  # else a large group's rows couldn't be split in the join
    of = groups.join(heads, "root").select(by, F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("head"))
    return rows.join(of, by, "left").select("doc_id", "rid", by, "component_id", (F.col("rid") == F.col("head")).alias("first"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near-duplicates: that of the least id; rows without id come last."""
    return only_first(df, near_duplicates, doc_id, text)


def only_first(df: DataFrame, near: Callable[..., DataFrame], doc_id: str, text: str) -> DataFrame:
    """df with the rows that are first in what near gives. The rows are written once, so that each has a number of its own.

    Of rows with one id the one with the least hash of its columns stays; rows that are equal in all of them are alike.
    """
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = common.stash(common.packed(df, rid=F.monotonically_increasing_id(), tie=F.xxhash64(*told)), "rows")
    found = near(rows.select("rid", "tie", F.col(f"row.`{doc_id}`").alias("doc_id"), F.col(f"row.`{text}`").alias("text")), rid=F.col("rid"), tie=F.col("tie"))
    gone = common.side(found.where(~F.col("first")).select("rid"), BROADCAST_ROWS)
    return common.unpacked(rows.join(gone, "rid", "left_anti"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = near_duplicates(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
