"""Graph tables projected from the star-schema tables, each with the same projection as SQL for an oracle.

``fact`` is append-only: a version is valid from its event until the next event of its logical id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("property"), (k % 5).alias("source_id"),
        F.floor(F.col("value") * 100).cast("long").cast("string").alias("value"), F.col("ts").alias("valid_from"),
    )
    e = e.withColumn("logical_id", F.concat_ws(":", "entity_id", "property", "source_id"))
    later = Window.partitionBy("logical_id").orderBy("valid_from", "event_id")
    e = e.withColumn("valid_to", F.lead("valid_from").over(later))
    third = F.col("event_id") % 3
    return e.select(
        F.concat_ws("__v_", "logical_id", "event_id").alias("id"), "logical_id", "entity_id", "property", "value", "valid_from", "valid_to", "source_id",
        F.when(F.col("valid_to").isNull(), "valid").otherwise("obsolete").alias("status"),
        F.when(third == 0, "EXTRACTED").when(third == 1, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"),
        F.when(F.col("event_id") % 4 == 0, True).when(F.col("event_id") % 4 == 1, False).alias("is_public"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("user_"), u).alias("label"), (u % 5 == 0).alias("is_public"),
        F.when(u % 3 == 0, F.array(F.lit("viewer"))).alias("roles"), F.array(F.concat(F.lit("team_"), u % 7)).alias("teams"),
        F.when(u % 4 != 0, F.concat(F.lit("t"), u % 3)).alias("tenant"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).groupBy(F.col("source_id").alias("id")).agg(F.max("valid_from").alias("ingested_at"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part, one relation for each return flag; ``N`` is the generic one."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation")).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "lang", "source", "text",
        F.when(F.col("quality") == 1, "L3").when(F.col("quality") == 0, "L2").otherwise("L1").alias("verification_level"),
        F.when(F.col("lang") == "en", "native").otherwise("pending").alias("translation_state"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical terms: words of part names and part types, by namespace."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    named = [("state", w[0]), ("ingredient", w[1]), ("technique", F.lower("p_type"))]
    out = [p.select(F.lit(n).alias("namespace"), c.alias("term")) for n, c in named]
    return out[0].union(out[1]).union(out[2]).distinct().select(F.concat_ws(":", "namespace", "term").alias("id"), "namespace", "term")


def normalized_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> its terms."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    ids = F.array(F.concat(F.lit("state:"), w[0]), F.concat(F.lit("ingredient:"), w[1]), F.concat(F.lit("technique:"), F.lower("p_type")))
    return p.select("p_partkey", F.explode(ids).alias("term_id"))


FACT = """fact AS (SELECT logical_id || '__v_' || event_id AS id, logical_id, entity_id, property, value, valid_from, valid_to, source_id,
  CASE WHEN valid_to IS NULL THEN 'valid' ELSE 'obsolete' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_public
 FROM (SELECT *, lead(valid_from) OVER (PARTITION BY logical_id ORDER BY valid_from, event_id) AS valid_to FROM
  (SELECT event_id, user_id AS entity_id, event_type AS property, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS value, ts AS valid_from,
   CAST(json_extract_string(props, '$.k') AS INT) % 5 AS source_id,
   user_id || ':' || event_type || ':' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS logical_id FROM events)))"""
ENTITY = """entity AS (SELECT id, 'user_' || id AS label, id % 5 = 0 AS is_public, CASE WHEN id % 3 = 0 THEN ['viewer'] END AS roles,
  ['team_' || (id % 7)] AS teams, CASE WHEN id % 4 <> 0 THEN 't' || (id % 3) END AS tenant FROM (SELECT DISTINCT user_id AS id FROM events))"""
SOURCE = "src AS (SELECT source_id AS id, max(valid_from) AS ingested_at FROM fact GROUP BY source_id)"
RELATION = "rel AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS relation FROM lineitem)"
DOCUMENT = """doc AS (SELECT d.doc_id AS id, substr(text, 1, 60) AS title, lang, source, text, CASE quality WHEN 1 THEN 'L3' WHEN 0 THEN 'L2' ELSE 'L1' END AS verification_level,
  CASE WHEN lang = 'en' THEN 'native' ELSE 'pending' END AS translation_state FROM documents d LEFT JOIN labels USING (doc_id))"""
TERM = """term AS (SELECT namespace || ':' || term AS id, namespace, term FROM (
  SELECT DISTINCT 'state' AS namespace, split_part(p_name, ' ', 1) AS term FROM part UNION SELECT 'ingredient', split_part(p_name, ' ', 2) FROM part UNION SELECT 'technique', lower(p_type) FROM part))"""
NORMALIZED = """norm AS (SELECT p_partkey, unnest(['state:' || split_part(p_name, ' ', 1), 'ingredient:' || split_part(p_name, ' ', 2), 'technique:' || lower(p_type)]) AS term_id FROM part)"""
