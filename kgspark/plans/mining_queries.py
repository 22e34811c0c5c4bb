"""Mining, embeddings and golden sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import numbers
from kgspark.operators import entities, mining, retrieval
from kgspark.sources import graph as g

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


_TOK = "tok AS (SELECT p_partkey AS id, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_name]) AS token FROM part)"
_W = """df AS (SELECT token, ln(((SELECT count(*) FROM part) + 1) / (count(DISTINCT id) + 1)) + 1 AS idf FROM tok GROUP BY token),
h AS (SELECT id, ('0x' || substr(sha256(token), 1, 16))::UBIGINT AS h, (1 + ln(tf)) * idf AS w FROM (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL) JOIN df USING (token)),
b AS (SELECT id, CAST(h % 384 AS INT) AS bucket, sum(CASE WHEN (h // 2) % 2 = 1 THEN w ELSE -w END) AS w FROM h GROUP BY ALL)"""


@query("SELECT id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM b", _TOK, _W)
def embedding_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Signed feature hashing of part names."""
    docs = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return retrieval.embed(docs, retrieval.idf(docs).drop("df")).select("id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    """SELECT o_orderkey AS id, concat_ws(' ', 'Order ' || o_orderkey, c_mktsegment, string_agg(DISTINCT p_name, ' ' ORDER BY p_name)) AS embedding_text
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey, c_mktsegment"""
)
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """Title, source title and sorted labels of each document."""
    o = g.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.col("o_custkey").alias("source_id"))
    sources = g.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"))
    links = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id"))
    labels = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return retrieval.embedding_text(o, sources, links, labels)


@query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AS stale FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 = 0")
def embedding_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Which rows a back-fill embeds: those without a stored vector and those whose text has changed since."""
    docs = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_size")
    old = F.when(F.col("p_size") % 2 == 0, F.concat("text", F.lit(" before"))).otherwise(F.col("text"))
    held = docs.where("id % 3 = 0").select("id", F.sha2(old, 256).alias("digest"))
    return retrieval.to_embed(docs, held).select("id", F.col("held").isNull().alias("stale"))


_PLAIN = "plain AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS p FROM conversations), seed AS (SELECT unnest(['the', 'and the', 'der', 'de la', 'en']) AS term)"


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ("the", "and the", "der", "de la", "en")], "term string")


@query("SELECT conv_id, turn, term FROM plain JOIN seed ON contains(p, ' ' || term || ' ')", _PLAIN)
def step_terms_whole_word(spark: SparkSession, d: str) -> DataFrame:
    """J23, T07."""
    return mining.whole_words(g.table(spark, d, "conversations"), ["conv_id", "turn"], "text", _seeds(spark))


@query("SELECT term, count(*) AS frequency FROM plain JOIN seed ON contains(p, ' ' || term || ' ') GROUP BY term", _PLAIN)
def seed_term_hits(spark: SparkSession, d: str) -> DataFrame:
    """A09, D09."""
    return mining.seed_hits(g.table(spark, d, "conversations"), ["conv_id", "turn"], "text", _seeds(spark))


@query("SELECT lang, count(*) AS n_documents, count(DISTINCT source) AS n_sources, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) FILTER (n_chars < 500) AS n_short FROM documents GROUP BY lang")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """A10, A16."""
    short = F.sum(F.when(F.col("n_chars") < 500, 1).otherwise(0))
    return g.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"), short.alias("n_short"))


_DEC = """a AS (SELECT o_orderkey AS id, o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'items' ELSE 'steps' END AS section FROM orders WHERE o_orderstatus = 'F'),
log AS (SELECT l_orderkey AS document_id, CASE WHEN l_returnflag = 'A' THEN 'items.qty' ELSE 'title' END AS field, 'RULE-' || l_linenumber AS rule_id FROM lineitem)"""


@query("SELECT id, a.document_id, coalesce(field, '-') AS field, coalesce(rule_id, 'NONE') AS rule_id FROM a LEFT JOIN log ON a.document_id = log.document_id AND starts_with(field, section)", _DEC)
def decision_records(spark: SparkSession, d: str) -> DataFrame:
    """J19."""
    o = g.table(spark, d, "orders")
    section = F.when(F.col("o_orderkey") % 2 == 0, "items").otherwise("steps")
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("document_id"), section.alias("section"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"))
    log = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "A", "items.qty").otherwise("title").alias("field"), F.concat(F.lit("RULE-"), "l_linenumber").alias("rule_id"))
    return mining.decisions(a, log)


@query("SELECT query, document_id, arg_min(kind, nth) AS kind FROM (SELECT 0 AS nth, p_name AS query, p_partkey AS document_id, 'title' AS kind FROM part UNION ALL SELECT 1, split_part(p_name, ' ', 1), p_partkey, 'word' FROM part UNION ALL SELECT 2, lower(p_brand), p_partkey, 'brand' FROM part) GROUP BY ALL")
def golden_generate(spark: SparkSession, d: str) -> DataFrame:
    """D14."""
    return mining.golden(g.table(spark, d, "part"), "p_partkey", {"title": F.col("p_name"), "word": F.split("p_name", " ")[0], "brand": F.lower("p_brand")}).withColumnRenamed("p_partkey", "document_id")


@query(
    """SELECT name, coalesce(r_regionkey || '', 'reg_' || substr(sha256(name), 1, 12)) AS id, r_regionkey IS NULL AS created
 FROM (SELECT DISTINCT name FROM (SELECT r_name AS name FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation)) LEFT JOIN region ON r_name = name"""
)
def upsert_or_select(spark: SparkSession, d: str) -> DataFrame:
    """Existing rows by name, and one new row with a deterministic id for each name that is not there."""
    known = g.table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    nations = g.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    asked = g.table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.col("r_name").alias("name")).union(nations).union(nations)
    return entities.upsert_or_select(known, asked, "name", "reg_")


_BAKE = """bake AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Bake ' || CAST(l_quantity AS INT) || CASE l_returnflag WHEN 'A' THEN ' min' WHEN 'N' THEN ' minuti' ELSE ' minutes' END ||
 ', rest ' || l_linenumber || 'h at ' || CAST(l_quantity AS INT) || CASE WHEN l_linenumber % 2 = 0 THEN ' °C.' ELSE ' degrees, 3 hands.' END AS step FROM lineitem)"""


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_aggregate(regexp_extract_all(step, '(?i)-?\\d+(?:\\.\\d+)?\\s*(?:minuti|min\\b|ore|h\\b|secondi|sec\\b|s\\b)'), 'string_agg', '|') AS times, list_aggregate(regexp_extract_all(step, '(?i)-?\\d+(?:\\.\\d+)?\\s*(?:°C|gradi|degrees)\\b'), 'string_agg', '|') AS temperatures FROM bake", _BAKE)
def mention_time_temp(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of times and temperatures of a step in order; ``minutes`` and ``hands`` are none."""
    q, even = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 2 == 0
    unit = F.when(F.col("l_returnflag") == "A", " min").when(F.col("l_returnflag") == "N", " minuti").otherwise(" minutes")
    step = F.concat(F.lit("Bake "), q, unit, F.lit(", rest "), "l_linenumber", F.lit("h at "), q, F.when(even, " °C.").otherwise(" degrees, 3 hands."))
    rows = g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.mentions(step).alias("m"))

    def of(name: str) -> Column:
        return F.array_join(F.transform(F.filter("m", lambda x: x["property"] == name), lambda x: x["value"]), "|")

    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", of("time").alias("times"), of("temperature").alias("temperatures"))
