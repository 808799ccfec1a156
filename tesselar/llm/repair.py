"""Token ids as compressed binary blocks: grammar compression by repeated pairs, with random access.

Texts are encoded by the tokenizers library; an end id follows each. In ascending order of ids of documents they are
cut into blocks, and each block is a shard's grammar: frequent pairs of symbols become nonterminals, again and again,
until no pair is frequent. A block stores its sequence, the two symbols of each rule, and the length that each rule
expands to: from the running sum of lengths any range of ids is found and expanded alone.

File format: a Parquet table, a row for a block, in the shared folder. part and block give the order, before the ids of
the part before the block; doc_ids and
doc_ends (ids up to the end of each document, in the block) its documents; rules, lengths and sequence are
little-endian unsigned 32-bit integers; first_rule is the symbol of the first rule; n_tokens counts the block's ids.
The counts of pairs are over the whole block. A document is never cut, so a block has BLOCK_IDS ids or one document
over it.

Null texts are empty and give the end id alone. Null ids of documents come first. Rows with one id come by their texts'
hashes; equal rows are alike. An empty table gives no blocks. Very long texts are encoded whole and make a block of their
own size. Strings of the tokenizer's added tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import common

END = 2
BLOCK_IDS = 1 << 20
LEAST_COUNT, MOST_RULES = 24, 4096  # a pair is frequent from so many times on; new rules in a round
HASH_BITS = 18
CACHE_PARTS = 400_000  # beyond this many a cache is renewed, and only the one before it is kept; results don't depend on it
JOINED = 256  # new parts that go to the library as one text
CACHED_BYTES = 64
ROWS = 4096  # texts that are encoded together, within common.SLICE_BYTES
#: Punctuation that a part can start with, and white space besides 0x20 and line feeds.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ALNUM, MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
MARK[list(PUNCTUATION.encode())] = True

BLOCK_SCHEMA = "part int, block int, before bigint, doc_ids array<bigint>, doc_ends array<bigint>, first_rule bigint, rules binary, lengths binary, sequence binary, n_tokens bigint"


class Encoder:
    """The library's ids, as bytes.

    A single space or line feed between two visible characters starts a piece whatever stands around it, and so does
    punctuation (but an apostrophe) after a letter or digit. Texts are cut there, and each different part is encoded
    once; new parts go to the library together, and are told apart by the tokens that begin with a space or line feed.
    """

    def __init__(self, model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # the library cuts texts at these
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that begin with a space or line feed
        self.opens[[k for t, k in vocabulary.items() if t.startswith(("\u0120", "\u010a"))]] = True
        self.parts: dict[bytes, bytes] = {}  # ids of a part, with the space or line feed before it
        self.older: dict[bytes, bytes] = {}  # the cache before it was last renewed

    def ids(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def together(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part; punctuation alone gets a line feed before it, whose id is taken off again."""
        out: list[bytes] = []
        for k in range(0, len(parts), JOINED):
            group = parts[k : k + JOINED]
            raw = self.ids([b"".join([p if p[0] in b" \n" else b"\n" + p for p in group]).decode()])[0]
            cuts = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, dtype="<u4")])).tolist()
            out += [raw[a:b] if p[0] in b" \n" else raw[a + 4 : b] for p, a, b in zip(group, cuts, [*cuts[1:], len(raw)], strict=True)]
        return out

    def plain(self, text: str) -> bool:
        """Whether all its spaces stand between visible characters, line feeds are its only other white space, and it has no added token."""
        return not (any(t in text for t in self.added) or "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or any(c in text for c in OTHER_SPACE))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.plain(t) for t in texts]
        cut = iter(self.by_parts([t.encode() for t, p in zip(texts, plain, strict=True) if p]))
        whole = iter(self.ids([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(cut if p else whole) for p in plain]

    def by_parts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts. Each gets a line feed before it, so that its first part is like others; its id is taken off again."""
        if not texts:
            return []
        data = np.frombuffer(b"".join([x for t in texts for x in (b"\n", t)]) + b"\n", dtype=np.uint8)
        heads = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = _part_starts(data, heads)
        offsets = np.append(at, heads[-1])
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, ends, values = coded.dictionary.buffers()
        ends, values = np.frombuffer(ends, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), values.to_pybytes()
        parts = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        found = list(map(self.parts.get, parts))
        new = []
        for i in [i for i, x in enumerate(found) if x is None]:
            if (x := self.older.get(parts[i])) is None:
                new.append(i)
            else:
                found[i] = self.parts[parts[i]] = x
        lines = [i for i in new if parts[i][-1:] == b"\n"]  # nothing else
        new = [i for i in new if parts[i][-1:] != b"\n"]
        for some, ids in ((new, self.together([parts[i] for i in new])), (lines, self.ids([parts[i].decode() for i in lines]))):
            for i, x in zip(some, ids, strict=True):
                found[i] = x
                if len(parts[i]) <= CACHED_BYTES:
                    self.parts[parts[i]] = x
        if len(self.parts) > CACHE_PARTS:
            self.older, self.parts = self.parts, {}
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, values = ids.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[np.searchsorted(at, heads)].tolist()
        values = memoryview(values)
        return [bytes(values[a + 4 : b]) for a, b in zip(ends, ends[1:], strict=False)]


def _part_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where parts start, in UTF-8 texts with a line feed at each of heads, the last of which ends the data."""
    line = data == 10
    start = line | (data == 32)
    # Of line feeds in a row the last is a piece of its own if a visible character follows; those before it are one piece.
    before = line.copy()
    before[heads] = False
    start[1:-1] &= ~(line[1:-1] & before[:-2] & line[2:])
    # After ASCII letters and digits, and those of two bytes from U+00C0 to U+00FF.
    solid = ALNUM[data]
    solid[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    start[1:] |= MARK[data[1:]] & solid[:-1]
    start[heads] = True
    return np.flatnonzero(start[: heads[-1]])


def _frequent(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs (as 64-bit keys) of a and b, where they stand, which of them stands there, and where others may be frequent.

    No pair at all only if none is frequent.
    """
    bits = min(HASH_BITS, max(8, len(a).bit_length()))
    bucket = (a * np.uint32((0x9E3779B1 + 2 * k) & 0xFFFFFFFF) ^ b * np.uint32((0x85EBCA77 + 2 * k) & 0xFFFFFFFF)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - bits)
    # A pair is as rare as its bucket. Each well-filled bucket first stands for one pair of its own, counted exactly.
    full = at = np.flatnonzero((np.bincount(bucket, minlength=1 << bits) >= LEAST_COUNT)[bucket])
    if not len(at):
        return np.zeros(0, np.uint64), at, at, at
    bucket = bucket[at]
    keys = a[at].astype(np.uint64) << np.uint64(32) | b[at]
    pair = np.zeros(1 << bits, dtype=np.uint64)
    pair[bucket] = keys
    own = pair[bucket] == keys
    counts = np.bincount(bucket[own], minlength=1 << bits)
    if (counts >= LEAST_COUNT).any():
        at, which, found = at[own], bucket[own], pair
    else:  # a frequent pair may still hide behind its bucket's
        found, which = np.unique(keys, return_inverse=True)
        counts = np.bincount(which)
    frequent = np.flatnonzero(counts >= LEAST_COUNT)
    if len(frequent) > MOST_RULES:
        frequent = np.sort(frequent[np.argsort(-counts[frequent], kind="stable")[:MOST_RULES]])
    rule = np.full(len(counts), -1, dtype=np.int32)
    rule[frequent] = np.arange(len(frequent))
    which = rule[which]
    return found[frequent], at[which >= 0], which[which >= 0], full


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence, the rules (two columns of symbols) and what each expands to in length.

    Frequent pairs, the MOST_RULES most frequent first, become rules until no pair stands LEAST_COUNT times. A pair that
    was rare stays so unless one of its symbols is new: later rounds look only where pairs are new or were not ruled out.
    """
    seq = ids.astype(np.uint32)
    n = len(seq)
    rules = np.zeros((0, 2), dtype=np.uint32)
    lengths = np.zeros(0, dtype=np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n)  # the places of the symbols beside one; n: none
    alive = np.ones(n, dtype=bool)
    places = np.arange(n - 1)
    k = 0
    while len(places):
        pairs, at, chosen, full = _frequent(seq[places], seq[after[places]], k)
        if not len(pairs):
            break
        left, at = places[full], places[at]
        # Of pairs that overlap every second one, from the left.
        runs = np.flatnonzero(np.concatenate([[True], at[1:] != after[at[:-1]]]))
        nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.concatenate([runs, [len(at)]])))
        at, chosen = at[nth % 2 == 0], chosen[nth % 2 == 0]
        used = np.zeros(len(pairs), dtype=bool)
        used[chosen] = True
        seq[at] = first + len(rules) + (np.cumsum(used) - 1)[chosen]
        gone = after[at]
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        lengths = np.concatenate([lengths, _lengths(new, first, lengths).sum(axis=1)])
        rules = np.concatenate([rules, new])
        look = np.zeros(n + 1, dtype=bool)
        look[left] = look[at] = look[before[at]] = True  # before the first stands -1, which is n
        look[gone] = False
        places = np.flatnonzero(look[:n])
        if len(places) and after[places[-1]] == n:  # the last symbol begins no pair
            places = places[:-1]
        k += 1
    return seq[alive], rules, lengths


def _lengths(symbols: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """What symbols expand to in length."""
    out = np.ones(symbols.shape, dtype=np.int64)
    rule = symbols >= first
    out[rule] = lengths[symbols[rule] - first]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin to end of a block; only symbols that overlap this range are expanded."""
    # All symbols' expansions, one after another: ids stand for themselves.
    flat = np.concatenate([np.arange(first, dtype=np.uint32), _flat(rules, first)])
    width = np.concatenate([np.ones(first, dtype=np.int64), lengths])
    source = np.cumsum(width) - width
    times = width[seq]
    ends = np.cumsum(times)
    end = (int(ends[-1]) if len(ends) else 0) if end is None else end
    if begin >= end:
        return np.zeros(0, dtype=np.uint32)
    i, j = int(np.searchsorted(ends, begin, side="right")), int(np.searchsorted(ends, end, side="left")) + 1
    skipped = int(ends[i - 1]) if i else 0
    at = np.repeat(source[seq[i:j]] - (ends[i:j] - times[i:j] - skipped), times[i:j])
    at += np.arange(len(at))
    return flat[at][begin - skipped : end - skipped]


def _flat(rules: np.ndarray, first: int) -> np.ndarray:
    """What the rules expand to, one after another: level by level."""
    out = rules.ravel()
    while (rule := out >= first).any():
        times = 1 + rule.astype(np.int64)
        at = np.cumsum(times) - times
        wider = np.repeat(out, times)
        pairs = rules[out[rule] - first]
        wider[at[rule]], wider[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
        out = wider
    return out


_encoders: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    if (key := hash(model)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def write(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes df's ids, and gives the table of blocks. path: the tokenizer's JSON file (of fixed size), read on the driver."""
    with open(path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = _encoder(shared.value)
        first = encoder.tokenizer.get_vocab_size()
        part, number, before, held, size, docs = TaskContext.get().partitionId(), 0, 0, [], 0, []

        def block():
            ids = np.concatenate(held)
            seq, rules, lengths = compress(ids, first)
            ends = np.cumsum([len(x) for x in held])
            row = [part, number, before, docs, ends.tolist(), first, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes(), len(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in common.slices(batches, 1, ROWS):
            for i, raw in zip(batch.column(0).to_pylist(), encoder.encode(common.strings(batch.column(1))), strict=True):
                ids = np.frombuffer(raw + END.to_bytes(4, "little"), dtype="<u4")
                if held and size + len(ids) > BLOCK_IDS:
                    yield block()
                    number, before, held, size, docs = number + 1, before + size, [], 0, []
                held.append(ids)
                docs.append(i)
                size += len(ids)
        if held:
            yield block()

    common.bounded_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    # By the hash too, so that rows of one id, or of none, are split.
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return common.stash(ordered.mapInArrow(run, BLOCK_SCHEMA), "token-blocks")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, part, start (ids of the part before the document), n_tokens, ids binary, of every document in the blocks."""
    spark = blocks.sparkSession
    common.bounded_batches(spark)
    start, starts = 0, []
    for part, n in sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_tokens")).collect())):  # a row for each task that wrote
        starts.append((part, start))
        start += n
    first = F.broadcast(spark.createDataFrame(starts, "part int, part_start bigint"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: c[k] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                row = {n: (memoryview(v.as_buffer()) if n in ("rules", "lengths", "sequence") else v.as_py()) for n, v in row.items()}
                rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(row["sequence"], dtype="<u4"), rules, np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64), row["first_rule"])
                ends = row["doc_ends"]
                begins = [0, *ends[:-1]]
                for k in range(0, len(ends), 1024):
                    pairs = list(zip(begins[k : k + 1024], ends[k : k + 1024], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][k : k + 1024], pa.int64()), pa.array([row["part_start"] + row["before"] + a for a, _ in pairs], pa.int64()), pa.array([b - a for a, b in pairs], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in pairs], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return blocks.join(first, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    import public_tokenizers

    blocks = write(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return read(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
