"""Byte-level BPE: encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point gets a symbol (letter, digit, other, kinds of white
space, apostrophe that can open a contraction). A small automaton reads symbols; each symbol is a function on its
states. Such functions compose associatively, and their closure under composition (the transition monoid) is small,
so a table multiplies them: blocks are scanned side by side, block totals by prefix doubling, and the state before
every code point follows at once. Where a state and a symbol say so, a piece starts.

Pieces (byte slices) go through a cache to pair merging by ranks. Ids and the byte offset of each token are kept;
decoding gathers the vocabulary's bytes to those offsets.

Null texts are empty: no ids, no bytes. Repeated rows each get their result. Columns of the input named like the
new ones are replaced. An empty table gives an empty table.

Very long texts are scanned CHUNK_CHARS code points at a time, the automaton's state and the piece that goes on being
carried over, so a text takes a few times its own bytes and a bounded rest. A single piece (a run of letters, say) is
never cut; merging takes some 200 times its bytes if it is over SHORT_PIECE.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar.llm import common

# Symbols: letter, digit, other, apostrophe before one or two contraction letters, white space before white space or
# the end, other white space before a visible character, 0x20 before one, border between texts, nothing.
LETTER, DIGIT, OTHER, SHORT, LONG, SPACE, LAST_SPACE, PREFIX, BORDER, NOTHING = range(10)
SYMBOLS = 10
# States: a piece must start, in letters, in digits, in others, in white space, after a prefixing 0x20, one or two
# letters of a contraction to come.
START, IN_LETTERS, IN_DIGITS, IN_OTHERS, IN_SPACE, PREFIXED, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

#: Code points with Unicode's property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow the apostrophe of a contraction.
SHORT_ENDS, LONG_ENDS = "stmd", ("re", "ve", "ll")

CHUNK_CHARS = 1 << 18  # texts are put together to this many code points, and longer ones are scanned in such parts
BLOCK = 256
CACHE_BYTES = 48 << 20  # the cache is emptied beyond about so much memory; results don't depend on it
PIECE_COST = 180  # bytes of memory that an entry of the cache takes besides its piece and ids
CACHED_BYTES = 64
AHEAD = 2  # code points after one that decide on its symbol
SHORT_PIECE = 48


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this symbol."""
    if symbol == NOTHING:
        return state, False
    if symbol == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return START, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIXED)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, PREFIXED)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHERS, PREFIXED):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, SHORT: ONE_LEFT, LONG: TWO_LEFT}[symbol], True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    return {LAST_SPACE: START, PREFIX: PREFIXED, BORDER: START}[symbol], True


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements (as rows of next states), products with a symbol, products of two elements, starts by state and symbol."""
    gens = [tuple(step(s, c)[0] for s in range(STATES)) for c in range(SYMBOLS)]
    found = {tuple(range(STATES)): 0}
    queue = list(found)
    for f in queue:
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    elements = np.array(queue, dtype=np.uint8)
    by_symbol = np.array([[found[tuple(g[s] for s in f)] for g in gens] for f in queue], dtype=np.uint16)
    product = np.array([[found[tuple(g[s] for s in f)] for g in queue] for f in queue], dtype=np.uint16)
    starts = np.array([[step(s, c)[1] for c in range(SYMBOLS)] for s in range(STATES)])
    return elements, by_symbol, product, starts


ELEMENTS, BY_SYMBOL, PRODUCT, STARTS = monoid()


def states_before(symbols: np.ndarray, first: int = START) -> np.ndarray:
    """The automaton's state before each symbol, from the state first, by an associative scan."""
    n = len(symbols)
    blocks = max(1, -(-n // BLOCK))
    padded = np.full(blocks * BLOCK, NOTHING, dtype=np.uint16)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    flat, acc = BY_SYMBOL.ravel(), np.zeros(blocks, dtype=np.uint16)
    before = np.empty((BLOCK, blocks), dtype=np.uint16)
    for j in range(BLOCK):  # all blocks at once
        before[j] = acc
        acc = flat[acc.astype(np.int32) * SYMBOLS + columns[j]]
    reach = 1
    while reach < blocks:  # prefix doubling over block totals
        nxt = acc.copy()
        nxt[reach:] = PRODUCT[acc[:-reach], acc[reach:]]
        acc, reach = nxt, reach * 2
    entry = np.empty(blocks, dtype=np.int32)
    entry[0], entry[1:] = first, ELEMENTS[acc[:-1], first]
    return ELEMENTS.ravel()[before.astype(np.int32) * STATES + entry].T.ravel()[:n]


def symbols_of(points: np.ndarray, borders: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """points: code points; borders: where a text is preceded by a separator; classes: LETTER, DIGIT, OTHER or SPACE by code point."""
    out = classes[points]
    out[borders] = BORDER
    after = np.empty_like(out)
    after[:-1], after[-1:] = out[1:], BORDER
    space = out == SPACE
    last = space & (after != SPACE) & (after != BORDER)
    quote = np.flatnonzero((points == 0x27) & (out == OTHER))
    out[last] = LAST_SPACE
    out[last & (points == 0x20)] = PREFIX
    if len(quote):
        wide = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        one, two = wide[quote + 1], wide[quote + 2]
        # A border's code point can't be one of these letters.
        out[quote[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = SHORT
        out[quote[np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in LONG_ENDS])]] = LONG
    return out


def code_point_classes() -> bytes:
    """LETTER, DIGIT, OTHER or SPACE for each code point, as the installed tokenizer library's Unicode tables have it; compressed."""
    import tiktoken

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT)):
        matched = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text))
        table[np.frombuffer(matched.decode().encode("utf-32-le"), dtype=np.uint32)] = symbol
    table[WHITE_SPACE] = SPACE
    return zlib.compress(table.tobytes())


class Vocabulary:
    """What decoding needs: the tokens' bytes by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(words), dtype=np.uint8)

    def offsets(self, ids: bytes) -> bytes:
        """The byte at which each token ends."""
        return np.cumsum(self.lengths[np.frombuffer(ids, dtype="<u4")]).astype("<u4").tobytes()

    def decode(self, ids: bytes, offsets: bytes) -> bytes:
        k, ends = np.frombuffer(ids, dtype="<u4"), np.frombuffer(offsets, dtype="<u4")
        out, lot = [], CHUNK_CHARS
        for i in range(0, len(k), lot):
            begin = np.concatenate([[ends[i - 1] if i else 0], ends[i : i + lot]]).astype(np.int64)
            at = np.repeat(self.starts[k[i : i + lot]] - begin[:-1], np.diff(begin)) + np.arange(begin[0], begin[-1])
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}


class Codec(Vocabulary):
    """Encodes and decodes by a vocabulary of ranks."""

    def __init__(self, ranks: bytes, classes: bytes):
        self.ranks = read_ranks(ranks)
        super().__init__(self.ranks)
        self.classes = np.frombuffer(zlib.decompress(classes), dtype=np.uint8)
        self.cache = Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: again and again the leftmost of the pairs with the least rank becomes one."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        get = self.ranks.get
        if len(piece) <= SHORT_PIECE:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            pairs = [get(a + b, 1 << 40) for a, b in pairwise(parts)]
            while pairs and (least := min(pairs)) < 1 << 40:
                i = pairs.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 40)
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], 1 << 40)
            return [self.ranks[p] for p in parts]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; end 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != to:
                continue  # one of its parts has changed since
            gone, end[end[i]] = end[i], 0
            end[i] = to
            before[gone] = -1
            if to < n:
                before[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (b := before[i]) >= 0 and (r := get(piece[b:to])) is not None:
                heapq.heappush(heap, (r, b, to))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The pieces of each text."""
        together = "\0" + "\0".join(texts)
        points = np.frombuffer(together.encode("utf-32-le"), dtype=np.uint32)
        borders = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        symbols = symbols_of(points, borders, self.classes)
        starts = np.flatnonzero(STARTS[states_before(symbols), symbols])
        widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        raw = together.encode()
        slices = [raw[a:b] for a, b in pairwise([*at[starts].tolist(), len(raw)])]
        firsts = [*np.searchsorted(starts, borders).tolist(), len(slices)]
        return [slices[a + 1 : b] for a, b in pairwise(firsts)]

    def long_pieces(self, text: str) -> Iterator[list[bytes]]:
        """The pieces of one text, part by part."""
        state, begun = START, [b""]
        for a in range(0, len(text), CHUNK_CHARS):
            part = text[a : a + CHUNK_CHARS]
            points = np.frombuffer(text[a : a + CHUNK_CHARS + AHEAD].encode("utf-32-le"), dtype=np.uint32)
            symbols = symbols_of(points, [], self.classes)[: len(part)]
            states = states_before(symbols, state)
            state = step(int(states[-1]), int(symbols[-1]))[0]
            points = points[: len(part)]
            widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
            raw, starts = part.encode(), np.flatnonzero(STARTS[states, symbols])
            cuts = at[starts].tolist()
            if not cuts:
                begun.append(raw)
                continue
            yield [b"".join([*begun, raw[: cuts[0]]]), *(raw[x:y] for x, y in pairwise(cuts))]
            begun = [raw[cuts[-1] :]]
        yield [b"".join(begun)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get, k = self.cache.__getitem__, 0
        while k < len(texts):
            if len(texts[k]) > CHUNK_CHARS:
                out.append(b"".join(b"".join([get(p) for p in pieces if p]) for pieces in self.long_pieces(texts[k])))
                k += 1
                continue
            group, size = [], 0
            while k < len(texts) and size + len(texts[k]) <= CHUNK_CHARS:
                group.append(texts[k])
                size += len(texts[k])
                k += 1
            out += [b"".join(map(get, pieces)) for pieces in self.pieces(group)]
        return out


class Pieces(dict):
    """Ids, as bytes, by piece; made when first asked for. Emptied beyond CACHE_BYTES."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.size = codec, 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.codec.merge(piece), dtype="<u4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self.size += len(piece) + len(ids) + PIECE_COST
            if self.size > CACHE_BYTES:
                self.clear()
                self.size = 0
            self[piece] = ids
        return ids


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker and vocabulary; its cache outlives a task."""
    ranks, classes = shared.value
    key = zlib.crc32(ranks)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, classes)
    return _codecs[key]


def _share(spark: SparkSession, path: str):
    """The vocabulary file (of fixed size, under 1 MB) and the class table, read on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), code_point_classes()))


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("offsets", T.BinaryType())]
DECODED = T.StructField("decoded", T.BinaryType())


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False, drop: bool = False) -> DataFrame:
    """df with n_tokens long, ids binary and offsets binary (each token's end, in bytes); both little-endian unsigned 32-bit.

    path: a file of lines of a base64 token and its rank. No special tokens are made. decoded: the ids are decoded again
    by the same worker, to the column decoded, as decode() does; drop: without the text.
    """
    shared = _share(df.sparkSession, path)

    def made(column: pa.Array) -> list[pa.Array]:
        codec = _codec(shared)
        ids = codec.encode(common.strings(column))
        ends = [codec.offsets(x) for x in ids]
        back = [pa.array([codec.decode(x, y) for x, y in zip(ids, ends, strict=True)], pa.binary())] if decoded else []
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(ends, pa.binary()), *back]

    return common.append_arrow(df, text, [*FIELDS, DECODED] if decoded else FIELDS, made, drop)


def decode(df: DataFrame, path: str) -> DataFrame:
    """df, which has ids and offsets as encode() makes them, with decoded binary: the bytes of the text. Nulls give no bytes."""
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    base = common.without(df, ["decoded"])
    a, b = base.columns.index("ids"), base.columns.index("offsets")

    def run(batches):
        words = Vocabulary(read_ranks(shared.value))
        for batch in common.slices(batches, a):
            texts = [words.decode(x or b"", y or b"") for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, DECODED]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(common.documents(spark, sf_dir).select("doc_id", "text"), path, decoded=True, drop=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
