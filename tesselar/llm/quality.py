"""Quality rules: how much of a text repeats.

Words are numbered within their text. Rolling hashes of n-grams of several lengths come from one pass each over the
numbers (numpy); an n-gram of which the hash occurs twice or more marks all its words, and the code points of marked
words, against those of all words, are the coverage at that length. Lines count the same way.

Null texts have no words. Texts under MIN_WORDS fail the base rule. Repeated rows each get their result. Columns of
the input named like the new ones are replaced. An empty table gives an empty table. A text is measured as a whole,
however long; its words and their hashes take some 100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tesselar.llm import common

#: At most so many per cent of the words' code points may lie in repeated n-grams of a length.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: At most so many per cent of the words' code points may lie in repeated lines, and of the lines be repeats.
LINE_COVERAGE, LINE_SHARE = 20, 30
MIN_WORDS, MAX_REPEAT_WORDS = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "n_lines", *(f"gram{n}_chars" for n in COVERAGE))]
FLAGS = [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Where a key stands that occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return np.zeros(0, dtype=np.int64)
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    return order[twice]


def covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """A mask of the words in windows of n words that start at these places."""
    edges = np.zeros(words + 1, dtype=np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def measure(text: str) -> tuple[int, ...]:
    """The values of FIELDS for a text."""
    raw = text.encode()
    words = raw.split()  # bytes: at 0x20 and 0x09-0x0D only
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(raw.count(c) for c in SYMBOLS)
    lines, times = text.split("\n"), {}
    for line in lines:
        times[line] = times.get(line, 0) + 1
    dup_lines = line_chars = full_lines = 0
    if len(times) < len(lines):
        for line, k in times.items():
            if stripped := len(line) - sum(map(line.count, SPACES)):
                full_lines += k
                if k > 1:
                    dup_lines += k - 1
                    line_chars += k * stripped
    else:
        full_lines = sum(1 for line in lines if line.strip(SPACES))
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=n)
    repeat_words, grams = 0, [0] * len(COVERAGE)
    if n >= 3:
        pairs = ids[:-1] * np.uint64(len(numbers)) + ids[1:]
        # Exact numbers for windows: first of pairs, then of pairs with a third word.
        dense = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
        at = repeated(dense[:-1] * np.uint64(len(numbers)) + ids[2:])
        if len(at):
            repeat_words = int(covered(at, 3, n).sum())
            lengths = np.fromiter((len(w.decode()) for w in words), dtype=np.int64, count=n)
            # A repeated n-gram starts where a repeated shorter one starts: only those places are hashed.
            mixed = (ids + np.uint64(1)) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            for n_gram in range(4, max(COVERAGE) + 1):
                at = np.sort(at[at <= n - n_gram])
                rolling = np.zeros(len(at), dtype=np.uint64)
                for k in range(n_gram):
                    rolling = rolling * _MULTIPLIER + mixed[at + k]
                at = at[repeated(rolling)]
                if not len(at):
                    break
                if n_gram in COVERAGE:
                    grams[list(COVERAGE).index(n_gram)] = int(lengths[covered(at, n_gram, n)].sum())
    return n, word_chars, symbols, dup_lines, repeat_words, line_chars, full_lines, *grams


def verdict(m: tuple[int, ...]) -> tuple[bool, bool]:
    """base_failed and kept."""
    n, chars, _, dup_lines, repeat_words, line_chars, lines, *grams = m
    failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_WORDS * n
    bad = 100 * line_chars > LINE_COVERAGE * chars or 100 * dup_lines > LINE_SHARE * lines or any(100 * g > most * chars for g, most in zip(grams, COVERAGE.values(), strict=True))
    return failed, not failed and not bad


def rate(df: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """df with the columns FIELDS and FLAGS; drop: without the text."""

    def made(column: pa.Array) -> list[pa.Array]:
        rows = [measure(t) for t in common.strings(column)]
        flags = [verdict(m) for m in rows]
        return [pa.array([m[i] for m in rows], pa.int64()) for i in range(len(FIELDS))] + [pa.array([f[i] for f in flags], pa.bool_()) for i in range(2)]

    return common.append_arrow(df, text, FIELDS + FLAGS, made, drop)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with the columns of df, whatever their names."""
    return common.filter_arrow(df, text, lambda column: pa.array([verdict(measure(t))[1] for t in common.strings(column)], pa.bool_()))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, the coverages, base_failed and kept of every document."""
    return rate(common.documents(spark, sf_dir).select("doc_id", "text"), drop=True)


def _sql() -> str:
    grams = [3, *COVERAGE]
    windows = ", ".join("CASE WHEN lead(w, {0}) OVER p IS NOT NULL THEN concat_ws(' ', w, {1}) END AS g{2}".format(n - 1, ", ".join(f"lead(w, {k}) OVER p" for k in range(1, n)), n) for n in grams)
    counts = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS r{n}" for n in grams)
    marks = ", ".join(f"bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m{n}" for n in grams)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (WHERE m{n}), 0)::BIGINT AS gram{n}_chars" for n in COVERAGE)
    over = " OR ".join(f"100 * gram{n}_chars > {most} * word_chars" for n, most in COVERAGE.items())
    zero = ", ".join(f"coalesce(gram{n}_chars, 0)::BIGINT AS gram{n}_chars" for n in COVERAGE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
w1 AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
w2 AS (SELECT doc_id, i, w, {windows} FROM w1 WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
w3 AS (SELECT *, {counts} FROM w2),
w4 AS (SELECT doc_id, i, w, {marks} FROM w3),
g AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, count(*) FILTER (WHERE m3) AS n_repeat_words, {sums} FROM w4 GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM l0 GROUP BY doc_id, line),
l AS (SELECT doc_id, coalesce(sum(k - 1) FILTER (WHERE c > 0), 0)::BIGINT AS n_dup_lines, coalesce(sum(k * c) FILTER (WHERE k > 1), 0)::BIGINT AS line_chars, coalesce(sum(k) FILTER (WHERE c > 0), 0)::BIGINT AS n_lines FROM l1 GROUP BY doc_id),
j AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, line_chars, n_lines, {zero}
  FROM d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_WORDS} * n_words AS base_failed FROM j)
SELECT *, NOT base_failed AND NOT (100 * line_chars > {LINE_COVERAGE} * word_chars OR 100 * n_dup_lines > {LINE_SHARE} * n_lines OR {over}) AS kept FROM b
"""


OP2_SQL = _sql()
