"""Near copies of texts by their sets of 5-word shingles: all pairs with a Jaccard similarity of LEAST or more.

The comparison is that of SimHash, by bit planes; what differs is the blocks. A pair of LEAST differs in 0.15 of a
SimHash's bits (the angle of the sets), so choices of whole blocks of bits would have to be of few bits, and buckets
would grow with the table: to keep them small at n texts takes n^0.24 tables times a constant of ten or more. The
blocks here are MinHash bands of the same shingles, of a fixed number: a pair of LEAST meets in none with a probability
of (1 - 0.8^5)^24 = 7e-5, more similar ones less. Bit planes then pass pairs within RADIUS bits, which a pair of LEAST
exceeds with a probability of about 1e-6, and these are checked exactly on the texts' sets of shingles' hashes. Only what
passes is a link; groups are components of links.

A group of copies is found by its middle: in each bucket the majority of the fingerprints, bit by bit, and the text
nearest to it; the others are compared with the nearest such text of their buckets. Then only texts of a bucket that
aren't in one component yet are compared, by the bit planes, in tasks that hold the bucket's sets; they return a link
for each text and component, no pairs. Large buckets are dealt out in parts.

Texts of equal words are one text here. Null texts count as empty; texts without words are one group. Rows with a null
id come last in their group. Very long texts count whole; their sets of hashes take 8 bytes a word.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm import common, simhash
from tesselar.llm.components import components

SHINGLE, LEAST = 5, 0.8
BANDS, BAND_ROWS = 24, 5
RADIUS = 24
COMPARE_ROWS = 1 << 13  # a task compares about so many rows at once
UNITS = 1 << 12  # of 64 pairs each, of which most may be near
CHUNK = 1 << 11
NUMBERED = 1 << 18  # members that are numbered at once
BROADCAST_ROWS = 500_000
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
SKETCH = [T.StructField(n, T.LongType()) for n in ("w1", "w2", "fp", "m")] + [T.StructField("bands", T.ArrayType(T.LongType()))]


def shingles(text: str) -> np.ndarray:
    """The set of the text's shingles, as sorted hashes."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band: a hash of its least values. An empty set has no keys."""
    if not len(found):
        return []
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(found), CHUNK):
        mixed = found[k : k + CHUNK, None] * _FACTORS + _ADDENDS
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, BAND_ROWS))]


def enough(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b members that share `both` have a Jaccard similarity of LEAST; in whole numbers, as 0.8 is no exact float."""
    return 10 * both >= round(10 * LEAST) * (a + b - both)


def near_in_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be alike."""
    return 10 * F.least(a, b) >= round(10 * LEAST) * F.greatest(a, b)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _sketches(column: pa.Array) -> list[pa.Array]:
    words, fps, sizes, keys = [], [], [], []
    for text in common.strings(column):
        found = shingles(text)
        words.append(xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split())))
        fps.append(simhash.majority(found))
        sizes.append(len(found))
        keys.append(bands(found))
    told = np.frombuffer(b"".join(words), dtype="<i8").reshape(-1, 2)
    return [pa.array(told[:, 0]), pa.array(told[:, 1]), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]


def _sets(column: pa.Array) -> list[pa.Array]:
    return [pa.array([shingles(t).tobytes() for t in common.strings(column)], pa.binary())]


def _check(batches):
    """From rows (u, v, a, b), a and b their sets, to the pairs (u, v) that are alike."""
    for batch in batches:
        sets = [[np.frombuffer(x.as_buffer(), dtype="<u8") for x in batch.column(i)] for i in (2, 3)]
        alike = [enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in zip(*sets, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(alike, pa.bool_()))


class Bucket:
    """The sets of one bucket's texts, with their members numbered."""

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        self.sizes = np.diff(ends, prepend=0)
        self.starts = ends - self.sizes
        known = np.unique(values)
        self.numbers = np.empty(len(values), dtype=np.int32)  # LOT_BYTES bound their count
        for x in range(0, len(values), NUMBERED):
            self.numbers[x : x + NUMBERED] = np.searchsorted(known, values[x : x + NUMBERED])
        self.marked = np.zeros(len(known), dtype=bool)

    def like(self, k: int) -> np.ndarray:
        """A mask of the texts that are alike to the k-th."""
        own = self.numbers[self.starts[k] : self.starts[k] + self.sizes[k]]
        self.marked[own] = True
        both = np.add.reduceat(self.marked[self.numbers], self.starts, dtype=np.int64)
        self.marked[own] = False
        return enough(both, self.sizes[k], self.sizes)


def _links(lot: pa.Table) -> pa.RecordBatch:
    """The links of one lot of whole buckets. All that it takes is free before the next lot is gathered."""
    t, k, i, j, root, node, fp = (c.to_numpy() for c in lot.columns[:7])
    n, raw = lot.num_rows, lot.column(7).chunk(0)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64) // 8
    values = np.frombuffer(raw.buffers()[2], dtype="<u8", count=int(offsets[-1]))
    groups = simhash.numbered([t, k, i, j])
    firsts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    lasts = np.concatenate([firsts[1:], [n]])
    # A component of many texts in the bucket is what others are compared with.
    _, kind, many = np.unique(np.stack([groups, root]), axis=1, return_inverse=True, return_counts=True)
    many = many[kind.ravel()]
    sizes, comp = np.diff(offsets), root.copy()
    known, bucket, links = -1, None, []
    for a, b in simhash.close(fp.view(np.uint64), groups, RADIUS, UNITS):
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        fit = (root[a] != root[b]) & (10 * small >= round(10 * LEAST) * large)
        a, b = a[fit], b[fit]
        swap = many[a] > many[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for asked in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
            if not len(asked) or (comp[b[asked]] == comp[a[asked[0]]]).all():
                continue  # links found meanwhile have joined them
            q, g = int(a[asked[0]]), int(groups[a[asked[0]]])
            low, high = firsts[g], lasts[g]
            if g != known:
                known, bucket = g, Bucket(values[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low])
            alike = bucket.like(q - low)
            for other in b[asked][alike[b[asked] - low]]:
                if comp[other] != comp[q]:
                    links.append((node[q], node[other]))
                    comp[comp == comp[other]] = comp[q]
    pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _compare(batches):
    """From rows (t, k, i, j, root, node, fp, set), a bucket's together, to links (u, v): for a text and each other component that it is alike to, one."""
    for lot in simhash.whole_buckets(batches, 4, COMPARE_ROWS, simhash.LOT_BYTES):
        found = _links(lot)
        del lot
        yield found


def _middles(members: DataFrame) -> DataFrame:
    """t, k, and the node, fp and m of the bucket's text that is nearest to the majority of its fingerprints."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    bit = lambda b: F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit((1 << b) - (b // 63 << 64))).otherwise(F.lit(0).cast("long"))
    counts = common.cut(members.groupBy("t", "k").agg(F.count("*").alias("n"), *ones))
    centres = counts.select("t", "k", reduce(lambda x, y: x.bitwiseOR(y), [bit(b) for b in range(64)]).alias("centre"))
    nearest = F.min(F.struct(differing(F.col("fp"), F.col("centre")).alias("d"), "node", "fp", "m")).alias("c")
    return members.join(centres, ["t", "k"]).groupBy("t", "k").agg(nearest).select("t", "k", F.col("c.node").alias("v"), F.col("c.fp").alias("v_fp"), F.col("c.m").alias("v_m"))


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rid: Column | None = None, tie: Column | None = None) -> DataFrame:
    """One row for each of df: doc_id, rid (the row's number), node (of its words), component_id (the least id of the component) and first (whether it is the one row that a component keeps).

    df is read twice; a rid that is given must be the same both times. Without one the rows are written first.
    """
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"))
    if rid is None:
        slim = common.stash(slim, "rows")
    rows = common.stash(common.append_arrow(slim, "text", SKETCH, _sketches, drop=True), "sketches")
    one = rows.groupBy("w1", "w2").agg(F.min("rid").alias("rid"))
    # Equal words have equal sketches: each text's are those of one of its rows.
    nodes = common.stash(one.withColumnRenamed("rid", "node"), "nodes")
    texts = rows.join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "fp", "m", "bands")
    spread = common.stash(texts.select("node", "fp", "m", F.posexplode("bands").alias("t", "k")), "bands")
    buckets = spread.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("node").alias("v"), F.max("node").alias("u"), F.bit_xor("fp").alias("x"))
    buckets = common.stash(buckets.where("n > 1"), "buckets")
    twos = buckets.where((F.col("n") == 2) & (F.bit_count("x") <= RADIUS)).select("u", "v")
    members = common.stash(spread.join(common.side(buckets.where("n > 2").select("t", "k"), BROADCAST_ROWS), ["t", "k"], "left_semi"), "members")
    d = differing(F.col("fp"), F.col("v_fp"))
    starred = members.join(_middles(members), ["t", "k"]).where((F.col("node") != F.col("v")) & (d <= RADIUS) & near_in_size(F.col("m"), F.col("v_m")))
    nearest = starred.groupBy(F.col("node").alias("u")).agg(F.min(F.struct(d.alias("d"), "v")).alias("c")).select("u", "c.v")
    pairs = common.side(twos.unionByName(nearest).distinct(), BROADCAST_ROWS)
    asked = pairs.select(F.col("u").alias("rid")).unionByName(pairs.select(F.col("v").alias("rid"))).unionByName(members.select(F.col("node").alias("rid"))).distinct()
    told = slim.select("rid", "text").join(common.side(asked, BROADCAST_ROWS), "rid", "left_semi")
    told = common.stash(common.append_arrow(told, "text", [T.StructField("set", T.BinaryType())], _sets, drop=True).withColumnRenamed("rid", "node"), "sets")
    # Few pairs are sent to the sets, many are shuffled with them; then the other text's set follows.
    both = told.select(F.col("node").alias("u"), F.col("set").alias("a")).join(pairs, "u").join(told.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    links = common.cut(both.select("u", "v", "a", "b").mapInArrow(_check, "u long, v long"))
    roots = common.cut(components(links, "u", "v").withColumnRenamed("node", "node_"))
    rooted = common.stash(members.join(roots, members["node"] == roots["node_"], "left").select("t", "k", F.coalesce("root", "node").alias("root"), "node", "fp", "m"), "rooted")
    open_ = rooted.groupBy("t", "k").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("t", "k")
    rest = common.stash(rooted.join(open_, ["t", "k"], "left_semi"), "open")
    keys = ["t", "k", "i", "j"]
    parts = common.side(simhash.dealt(rest, "node", 8 * F.col("m")), BROADCAST_ROWS)
    full = told.join(parts, "node").select(*keys, "root", "node", "fp", "set")
    more = common.cut(full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, "u long, v long"))
    of = nodes.join(components(links.unionByName(more), "u", "v"), "node", "left").select("w1", "w2", "node", "root")
    return _grouped(rows, common.cut(of))


def _grouped(rows: DataFrame, of: DataFrame) -> DataFrame:
    """doc_id, rid, node, component_id and first for rows; of: node and root (null: alone) by w1 and w2."""
    least = rows.groupBy("w1", "w2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tie", "rid")).alias("least"))
    groups = common.cut(of.join(least, ["w1", "w2"]).select("w1", "w2", "node", F.coalesce("root", "node").alias("root"), "least"))
    heads = common.cut(groups.groupBy("root").agg(F.min("least").alias("head")))  # else a large group's rows couldn't be split in the join
    told = common.cut(groups.join(heads, "root").select("w1", "w2", "node", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("head")))
    return rows.join(told, ["w1", "w2"]).select("doc_id", "rid", "node", "component_id", (F.col("rid") == F.col("head")).alias("first"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of near copies: that of the least id; rows without id come last."""
    return simhash.only_first(df, near_copies, doc_id, text)
