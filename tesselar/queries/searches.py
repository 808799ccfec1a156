"""Search queries over the parts, suppliers and nations of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.functions import text
from tesselar.graph import _rank
from tesselar.operators import search
from tesselar.queries.registry import query
from tesselar.tables import graph, table

SEARCHED = ["Nation", "Supplier", "Part"]
ASKED = "small_ring Supplier#000000012"
#: The query's words.
WORDS = "['small', 'ring', 'supplier#000000012']"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace(translate({x}, ':_/.', '    '), '(\p{{Lu}})', ' \1', 'g')), '\s+'), lambda x: x <> '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).scan(*SEARCHED).select("id", "label", "name", "qualified_name")


DOCS = "docs AS (SELECT id, label, name, qualified_name FROM nodes WHERE label IN ('Nation', 'Supplier', 'Part'))"

BM25 = f"""{DOCS},
long AS (SELECT id AS key, 'name' AS field, {_tokens("name")} AS t FROM docs UNION ALL SELECT id, 'qualified_name', {_tokens("qualified_name")} FROM docs),
totals AS (SELECT field, count(*) AS docs, avg(len(t)) AS mean_length FROM long GROUP BY field),
post AS (SELECT key, field, length, term, count(*) AS tf FROM (SELECT key, field, len(t) AS length, unnest(t) AS term FROM long) GROUP BY ALL),
hit AS (SELECT *, count(*) OVER (PARTITION BY field, term) AS df FROM post WHERE term IN (SELECT unnest({WORDS}))),
bm25 AS (SELECT key, round(sum(CASE field WHEN 'name' THEN 2.0 ELSE 1.0 END * ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM hit JOIN totals USING (field) GROUP BY key)"""

TFIDF = f"""
tw AS (SELECT id AS key, unnest({_tokens("name || ' ' || label || ' ' || qualified_name")}) AS term FROM docs),
tf AS (SELECT key, term, count(*) AS tf FROM tw GROUP BY ALL),
voc AS (SELECT term, ln((SELECT count(*) FROM docs)::DOUBLE / count(*)) + 1 AS idf FROM tf GROUP BY term),
wt AS (SELECT key, tf.term, (0.5 + 0.5 * tf / greatest(max(tf) OVER (PARTITION BY key), 1)) * idf AS w FROM tf JOIN voc USING (term)),
qw AS (SELECT term, idf AS q FROM voc WHERE term IN (SELECT unnest({WORDS}))),
norms AS (SELECT key, sqrt(sum(w * w)) AS norm FROM wt GROUP BY key),
cosine AS (SELECT key, round(sum(w * q) / (norm * (SELECT sqrt(sum(q * q)) FROM qw)), 6) AS score FROM wt JOIN qw USING (term) JOIN norms USING (key) GROUP BY key, norm)"""


@query(f"SELECT id, array_to_string({_tokens('qualified_name')}, ' ') AS words FROM nodes WHERE label = 'Part'", graph=True)
def tokenize_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).scan("Part").select("id", text.symbol_text(F.col("qualified_name")).alias("words"))


@query(f"WITH {BM25} SELECT key, score FROM bm25 ORDER BY score DESC, key LIMIT 30", graph=True)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(search.index(docs(spark, sf_dir), "id", ["name", "qualified_name"]), ASKED, 30)


@query(f"WITH {DOCS}, {TFIDF} SELECT key, score FROM cosine WHERE score > 0 ORDER BY score DESC, key LIMIT 30", graph=True)
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine(*search.tfidf(docs(spark, sf_dir), "id", search.document_words()), ASKED, 30)


@query(
    """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_aggregate([embedding[i]::DOUBLE * e[i]::DOUBLE for i in range(1, len(e) + 1)], 'sum') AS dot, sqrt(list_aggregate([x::DOUBLE * x::DOUBLE for x in embedding], 'sum')) AS a, sqrt(list_aggregate([x::DOUBLE * x::DOUBLE for x in e], 'sum')) AS b FROM embeddings, q)
SELECT vec_id AS key, round(dot / (a * b), 6) AS score FROM s ORDER BY score DESC, key LIMIT 10"""
)
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to the first one."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").first()
    return search.dense_top(vectors, "vec_id", "embedding", [float(x) for x in asked[0]], 10)


@query(
    """
WITH a AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200),
b AS (SELECT l_partkey AS key, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey ORDER BY sum(l_quantity) DESC, l_partkey LIMIT 200)
SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY key ORDER BY score DESC, key LIMIT 100"""
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by price and by quantity sold, fused."""
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("score"))
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("score"))
    return search.fuse([search.ranked(price, 200), search.ranked(sold, 200)], 100)


def _boosts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A supplier's nation is its community, with as many members as suppliers; a part's processes are the suppliers that it uses."""
    g = graph(spark, sf_dir)
    member = g.expand("Defines_Nation_Supplier").select(F.col("to_id").alias("key"), F.col("from_id").alias("community"))
    sizes = member.groupBy("community").agg(F.count("*").alias("size"))
    processes = g.of_kind("Uses").groupBy(F.col("from_id").alias("key")).agg(F.count("*").alias("processes"))
    return member.join(sizes, "community"), processes


BOOSTS = """
com AS (SELECT to_id AS key, from_id AS community, count(*) OVER (PARTITION BY from_id) AS size FROM edges WHERE rel = 'Defines_Nation_Supplier'),
pro AS (SELECT from_id AS key, count(*) AS processes FROM edges WHERE kind = 'Uses' GROUP BY from_id)"""


@query(
    f"""
WITH {BM25}, {TFIDF}, {BOOSTS},
r1 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM bm25 QUALIFY rank <= 60),
r2 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) AS rank FROM cosine WHERE score > 0 QUALIFY rank <= 60),
fused AS (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY key ORDER BY score DESC, key LIMIT 40)
SELECT key, round(score + CASE WHEN community IS NOT NULL AND coalesce(size, 100) < 20 THEN 0.002 ELSE 0 END + 0.001 * least(coalesce(processes, 0), 3), 6)::DOUBLE AS score
FROM fused LEFT JOIN com USING (key) LEFT JOIN pro USING (key) ORDER BY score + CASE WHEN community IS NOT NULL AND coalesce(size, 100) < 20 THEN 0.002 ELSE 0 END + 0.001 * least(coalesce(processes, 0), 3) DESC, key LIMIT 20""",
    graph=True,
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(docs(spark, sf_dir), ASKED, 20, *_boosts(spark, sf_dir), key="id")


@query(
    f"""
WITH {DOCS}, {BOOSTS},
t AS (SELECT id AS key, lower(name) AS n, lower(qualified_name) AS q, unnest(['ring', 'small']) AS t FROM docs),
s AS (SELECT key, max(CASE WHEN n = t THEN 1.0 WHEN n <> '' AND contains(n, t) THEN 0.7 + 0.3 * strlen(t) / strlen(n) WHEN contains(q, t) THEN 0.5 * (1 + strlen(t) / strlen(q)) ELSE 0 END)::DOUBLE AS best, bool_and(contains(q, t) OR contains(n, t)) AS every FROM t GROUP BY key)
SELECT key, round(least(best + CASE WHEN every THEN 0.1 ELSE 0 END + CASE WHEN community IS NOT NULL AND coalesce(size, 100) < 20 THEN 0.1 ELSE 0 END + 0.05 * least(coalesce(processes, 0), 3), 1.0), 6)::DOUBLE AS score
FROM s LEFT JOIN com USING (key) LEFT JOIN pro USING (key) WHERE best > 0 ORDER BY score DESC, key LIMIT 50""",
    graph=True,
)
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring(docs(spark, sf_dir), "ring small", 50, *_boosts(spark, sf_dir), key="id")


@query("SELECT 'stripped' AS how, id, label, qualified_name FROM nodes WHERE qualified_name = 'ASIA/NATION_2'", graph=True)
def resolve_qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_name(graph(spark, sf_dir).nodes, "src/ASIA/NATION_2", _rank("label", SEARCHED))


@query("SELECT 'suggestion' AS how, id, label, qualified_name FROM nodes WHERE string_split(qualified_name, '::')[-1] = 'small ring' ORDER BY label, qualified_name, id LIMIT 5", graph=True)
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_name(graph(spark, sf_dir).nodes, "nowhere::small ring", _rank("label", SEARCHED))


@query(
    """
SELECT kind, direction, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids, count(DISTINCT id) AS n
FROM (SELECT kind, 'out' AS direction, to_id AS id FROM edges WHERE from_id = 'p:7' UNION ALL SELECT kind, 'in', from_id FROM edges WHERE to_id = 'p:7') GROUP BY kind, direction""",
    graph=True,
)
def symbol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.context(graph(spark, sf_dir), "p:7").select("kind", "direction", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))
