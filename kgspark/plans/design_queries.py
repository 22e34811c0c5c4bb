"""Draft packs and public shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import public
from kgspark.operators import designer
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


_DRAFT = """cand AS (SELECT p_partkey AS nth, CASE WHEN p_size % 2 = 0 THEN 'ingredienti' ELSE 'stati' END AS vocabulary, CASE WHEN p_partkey % 10 = 0 THEN p_name || ' 2' ELSE p_name END AS term FROM part),
plain AS (SELECT *, CASE vocabulary WHEN 'stati' THEN 'STA-' ELSE 'ING-' END || upper(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g')) AS plain FROM cand),
held AS (SELECT DISTINCT 'ING-' || upper(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) || CASE WHEN p_size % 5 = 0 THEN '' ELSE '-' || p_size END AS id FROM part),
numbers AS (SELECT DISTINCT regexp_extract(id, '^(.*)-([1-9][0-9]*)$', 1) AS plain, TRY_CAST(regexp_extract(id, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT) AS n FROM (SELECT id FROM held UNION SELECT plain FROM plain) WHERE regexp_matches(id, '-[1-9][0-9]*$')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY nth) - CASE WHEN plain IN (SELECT id FROM held) THEN 0 ELSE 1 END AS r FROM plain),
free AS (SELECT plain, n, row_number() OVER (PARTITION BY plain ORDER BY n) AS r FROM (SELECT plain, unnest(range(2, 200 + max(r))) AS n FROM ranked GROUP BY plain) t WHERE NOT EXISTS (SELECT 1 FROM numbers x WHERE x.plain = t.plain AND x.n = t.n))"""


@query("SELECT vocabulary, CASE WHEN r = 0 THEN plain ELSE plain || '-' || n END AS id, term AS labels_en FROM ranked LEFT JOIN free USING (plain, r)", _DRAFT)
def design_pack(spark: SparkSession, d: str) -> DataFrame:
    """A draft glossary of part names, many of them with one slug, beside ids that are there already."""
    p = g.table(spark, d, "part")
    term = F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit(" 2"))).otherwise(F.col("p_name"))
    rows = p.select(F.when(F.col("p_size") % 2 == 0, "ingredienti").otherwise("stati").alias("vocabulary"), F.col("p_partkey").alias("nth"), term.alias("term"), F.array("p_name").alias("source_terms"), F.lit(None).cast("string").alias("ontology_uri"))
    base = designer.plain_id(F.lit("ING"), F.col("p_name"))
    held = p.select(F.when(F.col("p_size") % 5 == 0, base).otherwise(F.concat_ws("-", base, F.col("p_size").cast("string"))).alias("id"))
    return designer.draft(rows, held).select("vocabulary", "id", "labels_en")


@query(
    """SELECT id, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(valid_from) % 1000000 = 0 THEN '' ELSE '.' || strftime(valid_from, '%f') END AS since,
 'value=' || value || ' from=' || strftime(valid_from, '%Y-%m-%d') AS state FROM fact WHERE valid_to IS NULL""",
    g.FACT,
)
def facts_public(spark: SparkSession, d: str) -> DataFrame:
    """Open facts with their times as text, alone and inside a structure."""
    rows = g.facts(spark, d).where("valid_to IS NULL")
    nested = rows.select("id", F.col("valid_from").cast("timestamp_ntz").alias("since"), F.struct("value", F.col("valid_from").cast("date").alias("day")).alias("state"))
    safe = public.shaped(nested, ["id", "since", "state"])
    return safe.select("id", "since", F.concat(F.lit("value="), F.col("state.value"), F.lit(" from="), F.col("state.day")).alias("state"))
