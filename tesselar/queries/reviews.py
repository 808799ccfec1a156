"""Changes, claims, gates, sessions, scores and resolution over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar import schema
from tesselar.functions import text
from tesselar.graph import PropertyGraph
from tesselar.operators import changes, evals, resolve, semdiff, sessions, validate
from tesselar.queries.registry import query
from tesselar.tables import graph, table

# Changes.


@query(
    """
WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_custkey % 3 AS op FROM customer),
l AS (SELECT 'nation' || c_nationkey || '.rs' AS path, op, 10 + c_nationkey + count(*) FILTER (WHERE op <> 1) OVER (PARTITION BY c_nationkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS line FROM c)
SELECT path, line::BIGINT AS line, count(*) AS n FROM l WHERE op < 2 GROUP BY path, line"""
)
def unified_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each nation, of its customers' lines: added, removed and kept in turn."""
    sign = F.when(F.col("c_custkey") % 3 == 0, "+").when(F.col("c_custkey") % 3 == 1, "-").otherwise(" ")
    name = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit(".rs"))
    lines = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(sign, F.col("c_name")).alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,9 +"), (F.col("c_nationkey") + 10).cast("string"), F.lit(",9 @@ fn f\n"))
    diffs = lines.select(F.col("c_nationkey").cast("string").alias("diff_id"), F.concat(head, "body").alias("text"))
    return changes.parse_diff(diffs).groupBy("path", "line").agg(F.count("*").alias("n"))


SYMBOLS = "s AS (SELECT p_partkey AS key, p_brand AS path, p_partkey % 400 AS start_line, p_partkey % 400 + p_size AS end_line FROM part)"
CHANGED = "c AS (SELECT 'Brand#' || (l_suppkey % 25 + 1) AS path, l_partkey % 450 AS line, count(*) AS times FROM lineitem WHERE l_suppkey % 25 < 20 GROUP BY ALL)"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("path"), (F.col("p_partkey") % 400).alias("start_line"), (F.col("p_partkey") % 400 + F.col("p_size")).alias("end_line"))
    brand = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"))
    changed = table(spark, sf_dir, "lineitem").select(brand.alias("path"), (F.col("l_partkey") % 450).alias("line"), F.lit(False).alias("is_new"), (F.col("l_suppkey") % 25 >= 20).alias("is_deleted"))
    return changes.touched(changed, symbols)


@query(
    f"""
WITH {SYMBOLS}, {CHANGED}, gone AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 25 + 1) AS path FROM lineitem WHERE l_suppkey % 25 >= 20)
SELECT key, sum(times)::BIGINT AS lines FROM (SELECT key, times FROM c JOIN s ON c.path = s.path AND line BETWEEN start_line AND end_line UNION ALL SELECT key, end_line - start_line + 1 FROM s WHERE path IN (SELECT path FROM gone)) GROUP BY key"""
)
def diff_lines_to_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols in brands as files; lines of orders as changed lines, the last brands as deleted files."""
    return _touched(spark, sf_dir)


@query(
    """
WITH s AS (SELECT l_partkey AS key, min(l_suppkey % 7) AS community, count(DISTINCT l_suppkey) AS processes FROM lineitem GROUP BY l_partkey)
SELECT round(least(1.0, 0.6 * avg(processes) / greatest(max(processes), 1) + 0.4 * count(DISTINCT community) / 20), 6)::DOUBLE AS risk FROM s"""
)
def change_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    symbols = lines.groupBy(F.col("l_partkey").alias("key")).agg(F.min(F.col("l_suppkey") % 7).alias("community"), F.count_distinct("l_suppkey").alias("processes"))
    return changes.risk(symbols, 20)


# Claims and gates.

CLAIMED = "text || ' see `Foo::bar`, `x_' || doc_id || '` (src/a/' || lang || '.rs) `no way` a/b.txt'"


@query(
    rf"""
WITH t AS (SELECT doc_id, {CLAIMED} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, list_filter(list_concat(list_filter(regexp_extract_all(t, '`([^`\n]*)`', 1), lambda x: regexp_matches(x, '^[A-Za-z0-9_:]*[A-Za-z_][A-Za-z0-9_:]*$')),
  list_filter(string_split_regex(t, '[ \t\n\x0B\f\r`(),]'), lambda x: contains(x, '/') AND regexp_matches(x, '^[A-Za-z0-9_/.-]+\.(rs|ts|tsx|py|go|js)$'))), lambda x: len(x) >= 3) AS c FROM t)
SELECT doc_id, array_to_string(c, ' ') AS claims, len(c)::INTEGER AS n FROM c"""
)
def claim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.lit(" see `Foo::bar`, `x_"), F.col("doc_id").cast("string"), F.lit("` (src/a/"), "lang", F.lit(".rs) `no way` a/b.txt"))
    found = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", validate.claims(said).alias("c"))
    return found.select("doc_id", F.array_join("c", " ").alias("claims"), F.size("c").alias("n"))


@query("SELECT 'p:' || l_partkey * 2 AS token, 'critical' AS severity FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def hallucination_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "add").when(F.col("l_returnflag") == "R", "remove").otherwise("modify")
    claimed = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p:"), (F.col("l_partkey") * 2).cast("string")).alias("token"), kind.alias("change_kind"))
    return validate.hallucinations(claimed, graph(spark, sf_dir).scan("Part").select(F.col("id").alias("token")))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey % 4) AS communities, CASE WHEN count(DISTINCT l_suppkey % 4) >= 3 THEN 'critical' WHEN count(DISTINCT l_suppkey % 4) = 2 THEN 'warning' ELSE 'ok' END AS severity FROM lineitem GROUP BY l_orderkey")
def community_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.community_axis(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 4).alias("community")), ["l_orderkey"])


@query("SELECT DISTINCT l_suppkey AS process, l_partkey AS symbol, 'critical' AS severity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)")
def process_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("process"))
    return validate.process_axis(excluded, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("process"), F.col("l_partkey").alias("symbol")))


@query(
    """
WITH n AS (SELECT p_partkey AS symbol, p_brand AS community, CASE WHEN p_size = 7 THEN 'check_token' ELSE p_name END AS name FROM part)
SELECT symbol, 'S1' AS gate, 'critical' AS severity FROM n WHERE name <> 'check_token' AND community IN (SELECT community FROM n WHERE regexp_matches(lower(name), 'auth|password|token|permission|role|crypto|encrypt|decrypt|verify|jwt|oauth|session'))"""
)
def gate_auth_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("community"), F.when(F.col("p_size") == 7, "check_token").otherwise(F.col("p_name")).alias("name"))
    return validate.gate_auth(part.where("name <> 'check_token'").select("symbol"), part.select("symbol", "community"), part.select("symbol", "name"))


@query("SELECT p_partkey AS symbol, 'S3' AS gate, 'warning' AS severity FROM part WHERE p_size > 25 AND p_type IN ('SMALL', 'ECONOMY')")
def gate_public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") > 25, "pub").otherwise("").alias("visibility"))
    return validate.gate_public(part.select(F.col("p_partkey").alias("symbol")), symbols, part.where(F.col("p_type").isin("SMALL", "ECONOMY")).select(F.col("p_partkey").alias("symbol")))


@query("SELECT p_partkey AS symbol, 'S5' AS gate, 'warning' AS severity FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000)")
def gate_test_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"))
    tests = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("process"))
    return validate.gate_tests(changed, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("process")), tests)


@query("SELECT 'Brand#' || l_suppkey % 25 AS file, 'S4' AS gate, CASE WHEN count(*) >= 2 THEN 'critical' ELSE 'warning' END AS severity FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) GROUP BY 1")
def gate_unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size < 49").select(F.col("p_partkey").alias("l_partkey"))
    missing = table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_anti")
    return validate.gate_imports(missing.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string")).alias("file")))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS info, count(*) FILTER (WHERE o_orderstatus = 'O') AS warning, count(*) FILTER (WHERE o_orderstatus = 'P') AS critical, count(*) FILTER (WHERE o_orderstatus = 'P') = 0 AS passes FROM orders")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return validate.report(table(spark, sf_dir, "orders").select(F.when(s == "P", "critical").when(s == "O", "warning").otherwise("info").alias("severity")))


# Semantic difference.


def _two(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, PropertyGraph]:
    """The graph, and the graph without parts of size 50 and without suppliers' edges of weight 2 or more."""
    g = graph(spark, sf_dir)
    small = table(spark, sf_dir, "part").where("p_size = 50").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return g, PropertyGraph(g.nodes.join(small, "id", "left_anti"), g.edges.where("not (kind = 'Uses' and weight > 1)"))


@query("SELECT rel, from_id, to_id FROM edges WHERE NOT (kind = 'Uses' AND weight > 1) AND (from_id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size = 50) OR to_id IN (SELECT 'p:' || p_partkey FROM part WHERE p_size = 50))", graph=True)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semdiff.dangling(_two(spark, sf_dir)[1])


@query(
    """
WITH s AS (SELECT l_orderkey, least(10.0, 1.0 * count(*) FILTER (WHERE l_returnflag = 'R') + 0.5 * count(*) FILTER (WHERE l_returnflag = 'A') + least(5.0, 0.1 * greatest(0, sum(l_quantity)::BIGINT - 100)))::DOUBLE AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, round(s, 6) AS score, CASE WHEN s < 1 THEN 'clean' WHEN s < 5 THEN 'concerning' ELSE 'regression' END AS verdict FROM s"""
)
def regression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("d"), F.count_if(F.col("l_returnflag") == "A").alias("c"), (F.sum("l_quantity").cast("long") - 100).alias("u"))
    s = semdiff.score(F.col("d"), F.col("c"), F.col("u"))
    return flags.select("l_orderkey", F.round(s, 6).alias("score"), semdiff.verdict(s).alias("verdict"))


@query("SELECT rel, count(*) FILTER (WHERE kind = 'Uses' AND weight > 1) AS removed, 0::BIGINT AS added FROM edges WHERE kind = 'Uses' AND weight > 1 GROUP BY rel", graph=True)
def semantic_diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semdiff.edges(*_two(spark, sf_dir)).groupBy("rel").agg(F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change") == "added").alias("added"))


# Sessions.

TURNS = "turns AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent_question' ELSE 'user_answer' END AS kind, text FROM conversations WHERE role <> 'system')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "agent_question").otherwise("user_answer")
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", kind.alias("kind"), "text")


#: A turn is taken if the one before it was of the other kind; the first must be a question.
TAKEN = "taken AS (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY turn), 'user_answer') AS ok FROM turns)"


@query(
    f"""
WITH {TURNS}, {TAKEN}
SELECT conv_id, CASE WHEN NOT bool_or(ok) THEN 'open' WHEN arg_max(kind, turn) FILTER (WHERE ok) = 'agent_question' THEN 'waiting_for_user' ELSE 'waiting_for_agent' END AS state, count(*) FILTER (WHERE ok)::INTEGER AS turn_count, count(*) FILTER (WHERE NOT ok)::INTEGER AS n_refused FROM taken GROUP BY conv_id"""
)
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(_turns(spark, sf_dir), "conv_id", "turn", "kind", sessions.OPEN).select("conv_id", "state", "turn_count", F.size("refused").alias("n_refused"))


@query(
    """
WITH turns AS (SELECT conv_id, turn * 2 AS turn, CASE role WHEN 'assistant' THEN 'agent_question' ELSE 'user_answer' END AS kind FROM conversations WHERE role <> 'system'
  UNION ALL SELECT conv_id, turn * 2 + 1, CASE role WHEN 'assistant' THEN 'agent_question' ELSE 'user_answer' END FROM conversations WHERE role <> 'system' AND turn % 2 = 1),
taken AS (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY conv_id ORDER BY turn), 'user_answer') AS ok FROM turns)
SELECT conv_id, turn AS seq, 'alternation_violation' AS reason FROM taken WHERE NOT ok"""
)
def session_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second turn said twice."""
    turns = _turns(spark, sf_dir)
    doubled = turns.select("conv_id", (F.col("turn") * 2).alias("turn"), "kind").unionByName(turns.where("turn % 2 = 1").select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), "kind"))
    return sessions.replay(doubled, "conv_id", "turn", "kind", sessions.OPEN).select("conv_id", F.explode("refused").alias("r")).select("conv_id", "r.seq", "r.reason")


@query(f"WITH {TURNS} SELECT conv_id, bool_or(kind = 'agent_question') AS has_question, bool_or(kind = 'user_answer') AS has_answer, bool_or(kind = 'agent_question') AND bool_or(kind = 'user_answer') AS complete FROM turns GROUP BY conv_id")
def session_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.completeness(_turns(spark, sf_dir), "conv_id", "kind")


@query(f"WITH {TURNS}, t AS (SELECT conv_id, string_agg(turn || ':' || kind || ':' || text, '|' ORDER BY turn) AS t FROM turns GROUP BY conv_id) SELECT conv_id, sha256(t) AS digest, strlen(t)::BIGINT AS n_bytes FROM t")
def transcript_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.digest(_turns(spark, sf_dir), "conv_id", "turn", F.concat_ws(":", F.col("turn").cast("string"), "kind", "text"))


def _index(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    orders, s = table(spark, sf_dir, "orders"), F.lit("old" if old else "new")
    rows = orders.where("o_orderkey % 3 < 2" if old else "o_orderkey % 3 > 0")
    return rows.select(
        F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").cast("string").alias("finding_id"), F.concat_ws("/", s, "o_orderstatus").alias("artifact_path"), s.alias("extractor_version"), s.alias("orchestrator_version"),
        F.when(F.col("o_orderstatus") != "O", s).alias("refined_at"), F.when(F.col("o_orderstatus") == "F", s).alias("verified_at"), (F.col("o_orderstatus") == "F").alias("verified"), s.alias("stage2_path"),
    )


_SIDE = "SELECT o_orderpriority AS run_id, o_orderkey::VARCHAR AS finding_id, '{0}/' || o_orderstatus AS artifact_path, '{0}' AS v, CASE WHEN o_orderstatus <> 'O' THEN '{0}' END AS refined_at, CASE WHEN o_orderstatus = 'F' THEN '{0}' END AS verified_at, o_orderstatus = 'F' AS verified FROM orders WHERE {1}"
_PICKED = {
    "preserve_downstream": "CASE WHEN o.refined_at IS NOT NULL THEN o.artifact_path ELSE n.artifact_path END, n.v, o.v, o.refined_at, o.verified_at, o.verified, o.v",
    "preserve_stage2": "n.artifact_path, n.v, n.v, n.refined_at, o.verified_at, o.verified, o.v",
    "preserve_refined_only": "o.artifact_path, o.v, o.v, o.refined_at, n.verified_at, n.verified, n.v",
    "replace": "n.artifact_path, n.v, n.v, n.refined_at, n.verified_at, n.verified, n.v",
}
_MODES = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, o.run_id, o.finding_id, {picked} FROM o JOIN n USING (run_id, finding_id) UNION ALL SELECT '{mode}', run_id, finding_id, artifact_path, v, v, refined_at, verified_at, verified, v FROM n ANTI JOIN o USING (run_id, finding_id) UNION ALL SELECT '{mode}', run_id, finding_id, artifact_path, v, v, refined_at, verified_at, verified, v FROM o ANTI JOIN n USING (run_id, finding_id)"
    for mode, picked in _PICKED.items()
)


@query(f"WITH o AS ({_SIDE.format('old', 'o_orderkey % 3 < 2')}), n AS ({_SIDE.format('new', 'o_orderkey % 3 > 0')}), m(mode, run_id, finding_id, artifact_path, extractor_version, orchestrator_version, refined_at, verified_at, verified, stage2_path) AS ({_MODES}) SELECT * FROM m")
def index_merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _index(spark, sf_dir, True), _index(spark, sf_dir, False)
    out = [sessions.merge_index(old, new, mode).select(F.lit(mode).alias("mode"), "*") for mode in sessions.KEPT]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'missing_title' WHEN lang = 'fr' THEN 'missing_relevance_category' END AS reason FROM documents")
def finding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    findings = d.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.when(F.col("n_chars") % 7 == 0, " ").otherwise("t").alias("title"), F.when(F.col("lang") != "fr", F.col("lang")).alias("relevance_category"))
    return sessions.valid_findings(findings).select("doc_id", "reason")


# Scores.


@query("SELECT doc_id, (CASE WHEN lower(trim(lang)) = lower(trim(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || ' ' ELSE 'en' END)) THEN 1 ELSE 0 END)::DOUBLE AS score FROM documents")
def score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("lang"), F.lit(" "))).otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", evals.exact(F.col("lang"), said).alias("score"))


F1_SIDES = """
e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')"""


@query(
    f"""
WITH {F1_SIDES}, k AS (SELECT l_suppkey FROM e UNION SELECT l_suppkey FROM a)
SELECT l_suppkey, round(2.0 * (SELECT count(*) FROM e JOIN a USING (l_suppkey, l_partkey) WHERE e.l_suppkey = k.l_suppkey) / ((SELECT count(*) FROM e WHERE e.l_suppkey = k.l_suppkey) + (SELECT count(*) FROM a WHERE a.l_suppkey = k.l_suppkey)), 6)::DOUBLE AS score FROM k"""
)
def score_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return evals.f1_of(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'N'"), ["l_suppkey"], "l_partkey")


@query(
    """
WITH p AS (SELECT label AS a, vec_id % 10 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b),
x AS (SELECT sum(n * (n - 1) / 2.0) AS cells, sum(n) AS n FROM c), r AS (SELECT sum(n * (n - 1) / 2.0) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2.0) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((cells - r * k / (n * (n - 1) / 2.0)) / (0.5 * (r + k) - r * k / (n * (n - 1) / 2.0)), 6)::DOUBLE AS score FROM x, r, k"""
)
def score_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.adjusted_rand(table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).alias("b")), "a", "b")


@query(
    """
WITH s AS (SELECT o_custkey, list_distinct(list(o_orderstatus) FILTER (WHERE o_totalprice > 250000)) AS f, list_distinct(list(o_orderstatus) FILTER (WHERE o_orderkey % 2 = 0)) AS t FROM orders GROUP BY o_custkey),
n AS (SELECT o_custkey, len(coalesce(f, [])) AS f, len(coalesce(t, [])) AS t, len(list_intersect(coalesce(f, []), coalesce(t, []))) AS b FROM s)
SELECT o_custkey, round(CASE WHEN f = 0 AND t = 0 THEN 1.0 ELSE (CASE WHEN f > 0 THEN b / f ELSE 0 END + CASE WHEN t > 0 THEN b / t ELSE 0 END) / 2 END, 6)::DOUBLE AS score FROM n"""
)
def score_pr_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    sides = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_totalprice") > 250000, status)).alias("f"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, status)).alias("t"))
    return sides.select("o_custkey", F.round(evals.precision_recall_mean(F.col("f"), F.col("t")), 6).alias("score"))


_WEIGHTS = ", ".join(f"('{q}', {w})" for q, w in evals.WEIGHTS.items())


@query(
    f"""
WITH w AS (SELECT * FROM (VALUES {_WEIGHTS}) v(query_id, weight)), s AS (SELECT source AS corpus, 'q' || (doc_id % 12 + 1) AS query_id, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.4 END) AS score FROM documents GROUP BY ALL),
m AS (SELECT corpus, sum(weight * coalesce(score, 0)) / sum(weight) AS m FROM (SELECT DISTINCT corpus FROM s) CROSS JOIN w LEFT JOIN s USING (corpus, query_id) GROUP BY corpus)
SELECT corpus, round(m, 6)::DOUBLE AS score, m >= 0.75 AS reaches_floor, m >= 0.85 AS reaches_target FROM m"""
)
def harness_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.concat(F.lit("q"), (F.col("doc_id") % 12 + 1).cast("string")).alias("query_id"), F.when(F.col("lang") == "en", 1.0).otherwise(0.4).alias("score"))
    return evals.weighted(scores, ["corpus"])


# Resolution.


@query(
    """
WITH e AS (SELECT 'Uses_' || l_returnflag AS rel, l_partkey AS from_id, l_suppkey AS to_id, l_linenumber AS phase, l_discount AS confidence FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY rel, from_id, to_id ORDER BY phase, confidence DESC) AS n FROM e)
SELECT rel, from_id, to_id, phase, confidence FROM r WHERE n = 1 AND NOT (from_id % 10 = 0 AND rel = 'Uses_R')"""
)
def edge_dedup_first_phase_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Uses_"), "l_returnflag").alias("rel"), F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_linenumber").alias("phase"), F.col("l_discount").alias("confidence"))
    return resolve.first_phase(edges, edges.where("from_id % 10 = 0 and rel = 'Uses_R'")).select("rel", "from_id", "to_id", "phase", "confidence")


_TABLES = ", ".join(f"'{r}'" for r in schema.REL_TABLES)


@query(f"WITH e AS (SELECT 'Uses_' || CASE p_size % 4 WHEN 0 THEN 'Field' WHEN 1 THEN 'Enum' WHEN 2 THEN 'Method' ELSE 'Function' END || '_' || CASE p_partkey % 3 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Trait' ELSE 'Module' END AS rel FROM part) SELECT rel, count(*) AS n, rel IN ({_TABLES}) AS known FROM e GROUP BY rel")
def rel_table_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, m, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % m + 1).cast("int"))
    rel = F.concat_ws("_", F.lit("Uses"), pick("p_size", 4, "Field", "Enum", "Method", "Function"), pick("p_partkey", 3, "Struct", "Trait", "Module"))
    edges = table(spark, sf_dir, "part").select(rel.alias("rel"))
    known = F.broadcast(schema.rel_tables(spark).select("rel", F.lit(True).alias("known")))
    return edges.groupBy("rel").agg(F.count("*").alias("n")).join(known, "rel", "left").select("rel", "n", F.coalesce("known", F.lit(False)).alias("known"))


@query(
    r"""
WITH a AS (SELECT p_partkey, 'HashMap<' || replace(upper(p_name[1:1]) || p_name[2:], ' ', ', &mut ') || ', Option<' || p_type || 'Box>> ' || p_brand AS t FROM part),
x AS (SELECT p_partkey, unnest(list_filter(string_split_regex(translate(t, '&*<>,()[]', '         '), '\s+'), lambda x: regexp_matches(x, '^\p{Lu}') AND x NOT IN ('HashMap', 'Option', 'Box', 'String', 'Vec'))) AS type FROM a)
SELECT p_partkey, type FROM x"""
)
def type_identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 100))
    annotation = F.concat(F.lit("HashMap<"), F.regexp_replace(name, " ", ", &mut "), F.lit(", Option<"), "p_type", F.lit("Box>> "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.type_identifiers(annotation)).alias("type"))


_RULES = ", ".join(f"('{m}!', '{p}')" for m, paths in resolve.MACROS["rust"].items() for p in paths)


@query(f"WITH r AS (SELECT * FROM (VALUES {_RULES}) v(callee, path)), s AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'panic!' WHEN 'view' THEN 'println!' WHEN 'click' THEN 'vec!' ELSE 'none!' END AS callee FROM events) SELECT event_id, path AS canonical_path FROM s JOIN r USING (callee)")
def macro_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    sites = table(spark, sf_dir, "events").select("event_id", F.when(t == "error", "panic!").when(t == "view", "println!").when(t == "click", "vec!").otherwise("none!").alias("callee_name"))
    return sites.join(F.broadcast(resolve.macro_rules(spark)), "callee_name").select("event_id", "canonical_path")


@query("SELECT p_partkey, path, first NOT IN ('crate', 'self', 'super') AND NOT starts_with(first, '.') AND first <> '' AND NOT contains(first, '/') AS external FROM (SELECT p_partkey, path, string_split(path, '::')[1] AS first FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'crate' WHEN 1 THEN 'std' WHEN 2 THEN '.rel' WHEN 3 THEN 'a/b' ELSE 'self' END || '::' || p_name AS path FROM part))")
def external_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.element_at(F.array(*map(F.lit, ["crate", "std", ".rel", "a/b", "self"])), (F.col("p_size") % 5 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("::", root, "p_name").alias("path"))
    return part.select("p_partkey", "path", text.is_external(F.col("path")).alias("external"))
