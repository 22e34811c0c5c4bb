"""Ranked search and retrieval from stored indexes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.operators import curator, reextract, retrieval
from kgspark.operators.fact_store import FactStore
from kgspark.operators.search_index import SearchIndex
from kgspark.operators.vector_index import VectorIndex
from kgspark.plans.mining_queries import _TOK, _W
from kgspark.sources import graph as g
from kgspark.sources.shared import shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT kind, key, score, matched, row_number() OVER (ORDER BY score DESC, kind, key) AS rank FROM (
 SELECT kind, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score, count(*) AS matched
 FROM tf JOIN df USING (kind, token) JOIN size USING (kind) GROUP BY ALL) ORDER BY score DESC, kind, key LIMIT 100""",
    g.TERM,
    """rows AS (SELECT 'entity' AS kind, p_partkey || '' AS key, concat_ws(' ', p_name, p_type) AS text FROM part UNION ALL SELECT 'term', id, term FROM term UNION ALL SELECT 'document', doc_id || '', text FROM documents),
w AS (SELECT kind, key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM rows),
size AS (SELECT kind, count(*) AS n, avg(coalesce(len(w), 0)) AS mean FROM w GROUP BY kind),
tok AS (SELECT kind, key, len(w) AS length, unnest(w) AS token FROM w),
tf AS (SELECT kind, key, length, token, count(*) AS tf FROM tok WHERE token IN ('the', 'ring', 'die', 'bolt') GROUP BY ALL),
df AS (SELECT kind, token, count(*) AS df FROM tf GROUP BY ALL)""",
)
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best of parts, terms and whole documents for four words, by BM25 over an inverted index."""
    kinds = [
        g.table(spark, d, "part").select(F.lit("entity").alias("kind"), F.col("p_partkey").cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type").alias("text")),
        g.terms(spark, d).select(F.lit("term").alias("kind"), F.col("id").alias("key"), F.col("term").alias("text")),
        g.table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), "text"),
    ]
    index = SearchIndex.built(reduce(DataFrame.union, kinds), _folder(spark, "search"))
    best = index.ranked("The ring, die bolt!", 100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "kind", "key")).cast("long"))


@query(
    """SELECT query_id, key, score, rank FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM
 (SELECT q.id AS query_id, r.id AS key, round(sum(q.weight * r.weight), 6) + 0.0 AS score FROM unit q JOIN unit r USING (bucket) WHERE q.id % 100 = 0 GROUP BY ALL)) WHERE rank <= 5""",
    _TOK, _W, "unit AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM b)",
)
def retrieve_stored(spark: SparkSession, d: str) -> DataFrame:
    """Part names embedded once and kept by cells, equal names as one vector; the five stored ones nearest to
    every hundredth, over all cells."""
    docs = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    names, copies = retrieval.different(docs)
    vectors = retrieval.dense(retrieval.embed(names, retrieval.idf(docs).drop("df")))
    index = VectorIndex.built(vectors.withColumnRenamed("id", "key"), _folder(spark, "vectors"), copies=copies)
    return index.nearest_to_stored(index.keys().where("key % 100 = 0"), 5)


@query("SELECT count(*) * 10 AS n, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether a search that reads a part of the cells finds nine of ten of the ten nearest vectors."""
    e = g.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    index = VectorIndex.built(e, _folder(spark, "vectors"))
    asked = index.stored().where("key % 100 = 0").select(F.col("key").alias("query_id"), "v")
    return index.recall(asked, 10, max(1, len(index.centres) * 2 // 3)).select("n", (F.col("recall") >= 0.9).alias("enough"))


def _curated(spark: SparkSession, d: str) -> tuple[FactStore, DataFrame]:
    """Orders whose items are part names, extracted by the nouns of these; then each brand's first name is approved as an alias
    of the brand, its last one is pending, ``bolt`` is withdrawn, and the documents with these are extracted anew."""
    part = g.table(spark, d, "part")
    items = g.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("pos"), F.col("p_name").alias("item")).distinct()
    items = stored(items)  # the first extraction, the index and the new extraction read it
    before = part.select(F.split("p_name", " ")[1].alias("alias")).distinct().withColumn("entry_id", F.concat(F.lit("ingredient:"), "alias"))
    brands = part.groupBy("p_brand").agg(F.min("p_name").alias("approved"), F.max("p_name").alias("pending"))
    brands = brands.unpivot("p_brand", ["approved", "pending"], "status", "term")
    after = curator.applied(before, brands.withColumn("entry_id", F.concat(F.lit("brand:"), "p_brand"))).where("alias <> 'bolt'")
    at = lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    store = FactStore.created(reextract.first_facts(items, before, at("2029-01-01")), _folder(spark, "curated"), 16)
    return store, reextract.reextract(store, reextract.indexed(items, _folder(spark, "items")), items, before, after, at("2030-01-01"), "curator")


_CURATED = """named AS (SELECT p_name, min('brand:' || p_brand) AS entry FROM (SELECT p_brand, min(p_name) AS p_name FROM part GROUP BY p_brand) GROUP BY p_name),
item AS (SELECT DISTINCT l_orderkey AS document_id, l_orderkey || ':item:' || l_partkey AS entity_id, 'ingredient:' || split_part(p_name, ' ', 2) AS v0,
 coalesce(entry, CASE WHEN split_part(p_name, ' ', 2) <> 'bolt' THEN 'ingredient:' || split_part(p_name, ' ', 2) END) AS v1 FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN named USING (p_name))"""


@query(
    """SELECT entity_id || ':term' AS logical_id, entity_id, v0 AS value, TIMESTAMP '2029-01-01' AS valid_from, CASE WHEN v1 IS DISTINCT FROM v0 THEN TIMESTAMP '2030-01-01' END AS valid_to,
 CASE WHEN v1 IS DISTINCT FROM v0 THEN 'obsolete' ELSE 'valid' END AS status FROM item
 UNION ALL SELECT entity_id || ':term', entity_id, v1, TIMESTAMP '2030-01-01', NULL, 'valid' FROM item WHERE v1 <> v0""",
    _CURATED,
)
def curator_reextract(spark: SparkSession, d: str) -> DataFrame:
    """The versions of all facts after approved aliases and a withdrawn one."""
    return _curated(spark, d)[0].read().select("logical_id", "entity_id", "value", "valid_from", "valid_to", "status")


@query("SELECT document_id, count(*) FILTER (v1 <> v0) AS n_versions, count(*) FILTER (v1 IS NULL) AS n_invalidated FROM item WHERE v1 IS DISTINCT FROM v0 GROUP BY document_id", _CURATED)
def curator_reextract_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents that these aliases changed, and how many of their facts."""
    return _curated(spark, d)[1].where("n_versions + n_invalidated > 0").select("document_id", "n_versions", "n_invalidated")
