"""Secret scans by a trigram inverted index, by DataFrame functions only.

Each rule is a regular expression. From its syntax tree come the strings that every match must hold, and from these a
Boolean query on trigrams: clauses, of which one must have all its trigrams in the text. Postings (trigram, row) of
the trigrams asked for are intersected by aggregation; what remains are candidates (row, rules), which the regular
expressions verify on the rows' texts. A rule without mandatory trigrams scans every text. The index holds lower-cased
texts, so it only ever finds too much.

Null texts are empty. Rows with one id and one text share their candidates, and each gets its row. Other columns of
the input don't matter to scan(); redact() keeps them, whatever their names. Very long texts are scanned whole; a text,
its lower-cased copy and what stands between its matches are held in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: code points that the group must have at least, for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds that a text's base spans come from, in their order. The first has matches that are too short and take up
#: their text all the same; for the others the length stands in the pattern, which finds the same matches.
BASE = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
]
#: Further kinds, with prefixes that their issuers publish.
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
RULES = BASE + MORE
#: What redact() takes out for a private key: up to the matching END line; if there is none before another BEGIN, the
#: headers and base64 lines that follow. Hyphens in the body are counted, since Java's loops over groups use the stack.
KEY_BLOCK = (
    r"-----BEGIN ([A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?)-----"
    r"(?:[^-]*(?:-(?!----(?:BEGIN|END) )[^-]*){0,200}-----END \1-----"
    r"|(?:(?:\s|\\[rn])*[A-Za-z-]{1,30}: [^\r\n\\]*){0,8}(?:\r?\n[A-Za-z0-9+/=\r\n]+(?![^\r\n]))?(?:(?:\s|\\[rn]|>){0,40}[A-Za-z0-9+/]{40,}={0,2}){0,400}(?:(?:\s|\\[rn]|>){1,40}(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,39}={1,2}|=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/]))){0,2})"
)
REDACTED = [Rule("pem", KEY_BLOCK) if r.kind == "pem" else r for r in RULES]
PLACEHOLDER = "[REDACTED]"
BROADCAST_KEYS = 500_000
MOST_STRINGS, MOST_CLAUSES = 16, 64

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which a matching text, lower-cased, satisfies one: it holds all its trigrams. An empty clause holds always."""
    clauses: list[frozenset[str]] = [frozenset()]

    def strings(op, value) -> list[str] | None:
        """All that a node matches, if these are few strings."""
        if op is K.LITERAL:
            return [chr(value).lower()]
        if op is K.IN:
            chars = []
            for kind, x in value:
                if kind is K.LITERAL:
                    chars.append(chr(x).lower())
                elif kind is K.RANGE and x[1] - x[0] < MOST_STRINGS:
                    chars += [chr(c).lower() for c in range(x[0], x[1] + 1)]
                else:
                    return None
            return sorted(set(chars)) if len(set(chars)) <= MOST_STRINGS else None
        if op is K.SUBPATTERN:
            return together(value[3])
        if op is K.BRANCH:
            parts = [together(x) for x in value[1]]
            return None if any(x is None for x in parts) else sorted({s for x in parts for s in x})
        if op is K.MAX_REPEAT and value[1] <= 4:
            inner = together(value[2])
            return None if inner is None else sorted({"".join(t) for n in range(value[0], value[1] + 1) for t in product(inner, repeat=n)})
        return None

    def together(nodes) -> list[str] | None:
        out = [""]
        for op, value in nodes:
            more = strings(op, value)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = [a + b for a in out for b in more]
        return out

    def demand(run: list[str]) -> None:
        nonlocal clauses
        each = {trigrams(s) for s in run}
        if frozenset() in each:
            return  # one of the strings demands nothing
        new = {c | e for c in clauses for e in each}
        if len(new) <= MOST_CLAUSES:  # else less is demanded, and more is verified
            clauses = sorted((c for c in new if not any(d < c for d in new)), key=sorted)

    def walk(nodes) -> None:
        run = [""]
        for op, value in nodes:
            more = strings(op, value)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = [a + b for a in run for b in more]
                continue
            demand(run)
            run = [""]
            if more is not None and len(more) <= MOST_STRINGS:
                run = more
            elif op is K.SUBPATTERN:
                walk(value[3])
            elif op is K.MAX_REPEAT and value[0] > 0:
                walk(value[2])
        demand(run)

    walk(_parser.parse(pattern))
    return clauses


def candidates(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """key, kinds: for each row of df (key, text) that the index finds, the rules to verify there."""
    spark = df.sparkSession
    asked = []
    for rule in rules:
        for number, clause in enumerate(trigram_query(rule.pattern)):
            asked += [(rule.kind, number, t, 1 << i, (1 << len(clause)) - 1) for i, t in enumerate(sorted(clause))]
    query = spark.createDataFrame(asked, "kind string, clause int, trigram string, bit long, whole long")
    # The text is lower-cased once, in a projection of its own, and looked through for one trigram after another.
    low = df.select("key", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted({a[2] for a in asked})]))
    postings = low.select("key", F.explode(present).alias("trigram"))
    # The query has a fixed number of rows, by the rules alone.
    met = postings.join(F.broadcast(query), "trigram").groupBy("key", "kind", "clause", "whole").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _matches(rule: Rule, text: Column) -> Column:
    """The spans of a rule's matches, leftmost first, in code points; from the matches and what stands between them."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit([r.kind for r in RULES].index(rule.kind)).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["spans"], F.array(span).cast(SPAN))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(F.size(whole) > 0, found).otherwise(empty)


def with_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """row (a struct of df's columns) and spans: the matches of all rules (start, rank, end, kind), by start and then rank."""
    keyed = common.packed(df, key=common.row_key(doc_id, text))
    # Candidates are sent to all tasks under a bound on their number; beyond it the rows are shuffled.
    found = common.side(candidates(keyed.select("key", F.col(f"row.`{text}`").alias("text")), rules), BROADCAST_KEYS)
    whole, none = F.coalesce(F.col(f"row.`{text}`"), F.lit("")), F.array().cast(SPAN)
    spans = []
    for rule in rules:
        scans = frozenset() in trigram_query(rule.pattern)
        spans.append(_matches(rule, whole) if scans else F.when(F.array_contains("kinds", rule.kind), _matches(rule, whole)).otherwise(none))
    return keyed.join(found, "key", "left").select("row", F.array_sort(F.concat(*spans)).alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _counter(rank: int) -> Callable[[Column], Column]:
    return lambda x: x["rank"] == rank


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of df: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("row.doc_id", F.col("spans").alias("found"))
    counts = [F.size(F.filter("found", _counter(k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_said(F.filter("found", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"), _said(F.col("found")).alias("spans"))


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """df with every span in the texts replaced by PLACEHOLDER, overlapping ones by one; length: a column with the texts' code points, set anew.

    A private key goes with its body (KEY_BLOCK); scan() reports its header only, as its SQL does.
    """
    found = with_spans(df, text, doc_id, REDACTED)
    whole = F.col(f"row.`{text}`")

    def add(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(whole, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(PLACEHOLDER))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"].cast("int") + 1, F.length(whole))))
    done = found.select("row", F.when(F.size("spans") > 0, rebuilt).alias("fresh"))
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}

    def column(name: str) -> Column:
        old = F.col(f"row.`{name}`")
        if name.lower() == text.lower():
            return F.coalesce("fresh", old).alias(name)
        if length and name.lower() == length.lower():
            return F.when(F.col("fresh").isNotNull(), F.length("fresh").cast(kinds[name.lower()])).otherwise(old).alias(name)
        return old

    return done.select(*map(column, df.columns))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    """The same by regular expressions alone: a match begins where what stands before it, and earlier matches, end."""
    found = " UNION ALL ".join(
        "SELECT doc_id, {0} AS rank, '{1}' AS kind, {2} AS least, regexp_extract_all(t, '{3}', 0) AS m, regexp_extract_all(t, '{3}', {4}) AS v, string_split_regex(t, '{3}') AS s FROM d WHERE regexp_matches(t, '{3}')".format(k, r.kind, r.least, r.pattern.replace("'", "''"), r.group) for k, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({found}),
x AS (SELECT doc_id, rank, kind, least, m, v, s, unnest(range(1, len(m) + 1)) AS k FROM r),
y AS (SELECT doc_id, rank, kind, (list_sum([length(z) for z in s[1:k]]) + coalesce(list_sum([length(z) for z in m[1:k - 1]]), 0))::BIGINT AS a, length(m[k]) AS n FROM x WHERE length(v[k]) >= least),
z AS (SELECT doc_id, rank, kind, a, kind || ':' || a || ':' || (a + n) AS said FROM y),
g AS (SELECT doc_id, {counts}, string_agg(said, ',' ORDER BY a, rank) FILTER (WHERE rank < {len(BASE)}) AS base, string_agg(said, ',' ORDER BY a, rank) AS spans FROM z GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


OP9_SQL = _sql()
