"""Queries over facts, entities, relations, conflicts and truth maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import accounts, conflicts, curator, fact_store, facts, intervals, queues, relations, truth
from kgspark.operators.visibility import Principal, overlaps, patched, visible, visible_rows, with_parent
from kgspark.sources import graph as g
from kgspark.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWER = Principal("u1", ("viewer",), ("team_2",), "t1")
AT, NOW = "2024-01-15 00:00:00", "2024-06-01 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def query(sql: str | None = None, *ctes: str):
    """Register a query under its function's name, with its oracle SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


SEEN = "(e.tenant IS NULL OR e.tenant = 't1') AND (coalesce({p}, false) OR coalesce(list_has_any(e.roles, ['viewer']), false) OR coalesce(list_has_any(e.teams, ['team_2']), false))"


@query(f"SELECT id, label, tenant FROM entity e WHERE label LIKE 'user_1%' AND {SEEN.format(p='e.is_public')}", g.ENTITY)
def entity_filter_label(spark: SparkSession, d: str) -> DataFrame:
    """S01, F01, F02."""
    return visible_rows(g.entities(spark, d).where("label LIKE 'user_1%'"), VIEWER).select("id", "label", "tenant")


@query("SELECT id, entity_id, property, value, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY valid_from DESC, id DESC) AS n FROM fact WHERE valid_to IS NULL) WHERE n = 1", g.FACT)
def facts_current(spark: SparkSession, d: str) -> DataFrame:
    """S02, N01."""
    return facts.latest_open(g.facts(spark, d)).select("id", "entity_id", "property", "value", "valid_from")


@query(
    f"SELECT f.id, f.entity_id, f.property, f.value, e.tenant FROM fact f LEFT JOIN entity e ON f.entity_id = e.id WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AT}') AND {SEEN.format(p='coalesce(f.is_public, e.is_public)')}",
    g.FACT, g.ENTITY,
)
def facts_asof_visible(spark: SparkSession, d: str) -> DataFrame:
    """F06, F02, F03, J02."""
    rows = with_parent(facts.as_of(g.facts(spark, d), _at(AT)), g.entities(spark, d))
    return visible_rows(rows, VIEWER).select("id", "entity_id", "property", "value", "tenant")


@query("SELECT id, logical_id, row_number() OVER w AS version_no, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM fact WINDOW w AS (PARTITION BY logical_id ORDER BY valid_from, id)", g.FACT)
def fact_history_versions(spark: SparkSession, d: str) -> DataFrame:
    """N02, N03, J04."""
    return facts.history(g.facts(spark, d)).select("id", "logical_id", F.col("version_no").cast("long").alias("version_no"), "prev_id", "next_id")


@query("SELECT entity_id, property, id, status FROM fact", g.FACT)
def facts_include_obsolete(spark: SparkSession, d: str) -> DataFrame:
    """F07, J01."""
    return g.facts(spark, d).join(g.entities(spark, d).select(F.col("id").alias("entity_id")), "entity_id").select("entity_id", "property", "id", "status")


@query(
    f"SELECT id, CASE WHEN valid_to IS NULL AND entity_id % 10 = 3 THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to, CASE WHEN valid_to IS NULL AND entity_id % 10 = 3 THEN 'obsolete' ELSE status END AS status FROM fact",
    g.FACT,
)
def fact_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """W05."""
    rows = g.facts(spark, d)
    ids = rows.where("entity_id % 10 = 3").select("logical_id")
    return facts.invalidate(rows, ids, _at(NOW)).select("id", "valid_to", "status")


_CHANGE = "change AS (SELECT logical_id, CASE WHEN entity_id % 2 = 0 THEN 'changed' ELSE min(value) END AS new_value FROM fact WHERE valid_to IS NULL GROUP BY logical_id, entity_id)"


@query(
    f"""SELECT id, value, valid_from, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to, CASE WHEN hit THEN 'obsolete' ELSE status END AS status
 FROM (SELECT f.*, f.valid_to IS NULL AND f.value <> c.new_value AS hit FROM fact f JOIN change c USING (logical_id))
 UNION ALL SELECT f.id || '+', c.new_value, TIMESTAMP '{NOW}', NULL, 'valid' FROM fact f JOIN change c USING (logical_id) WHERE f.valid_to IS NULL AND f.value <> c.new_value""",
    g.FACT, _CHANGE,
)
def fact_update_scd2(spark: SparkSession, d: str) -> DataFrame:
    """W04, W08."""
    rows = g.facts(spark, d)
    value = F.when(F.col("entity_id") % 2 == 0, "changed").otherwise(F.col("value"))
    change = facts.current(rows).groupBy("logical_id", "entity_id").agg(F.min("value").alias("value")).select("logical_id", value.alias("value"))
    return facts.update(rows, change, _at(NOW)).select("id", "value", "valid_from", "valid_to", "status")


@query("SELECT id, property, 1::BIGINT AS n FROM fact WHERE logical_id NOT IN (SELECT logical_id FROM fact WHERE entity_id % 2 = 1)", g.FACT)
def fact_insert_checked(spark: SparkSession, d: str) -> DataFrame:
    """All facts sent to a table that has those of every second entity; those with new logical ids are inserted."""
    rows = g.facts(spark, d)
    new = facts.insert(rows.where("entity_id % 2 = 1"), rows, g.entities(spark, d))
    return new.select("id", "property", F.lit(1).cast("long").alias("n"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'patched' ELSE label END AS label, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'tx' ELSE tenant END AS tenant FROM entity", g.ENTITY)
def entity_patch(spark: SparkSession, d: str) -> DataFrame:
    """Only set columns are replaced."""
    e = g.entities(spark, d)
    patch = e.where("id % 2 = 0").select("id", F.lit("patched").alias("label"), F.when(F.col("id") % 3 == 0, "tx").alias("tenant"))
    return patched(e, patch, "id", "label", "tenant").select("id", "label", "tenant")


@query(f"SELECT f.id, coalesce(f.is_public, e.is_public, false) AS is_public, coalesce(list_aggregate(e.roles, 'string_agg', ','), '') AS roles, list_aggregate(e.teams, 'string_agg', ',') AS teams, {SEEN.format(p='coalesce(f.is_public, e.is_public)')} AS visible FROM fact f LEFT JOIN entity e ON f.entity_id = e.id", g.FACT, g.ENTITY)
def visibility_effective(spark: SparkSession, d: str) -> DataFrame:
    """F03, F05."""
    rows = with_parent(g.facts(spark, d), g.entities(spark, d))
    seen = visible(VIEWER, *map(F.col, ("is_public", "roles", "teams", "tenant")))
    return rows.select("id", F.coalesce("is_public", F.lit(False)).alias("is_public"), F.concat_ws(",", "roles").alias("roles"), F.concat_ws(",", "teams").alias("teams"), seen.alias("visible"))


_OWN = """own AS (SELECT f.id, f.entity_id, f.is_public, CASE WHEN f.n % 3 = 1 THEN ['editor_x', 'viewer'] WHEN f.n % 3 = 2 THEN [] END AS roles,
 CASE WHEN f.n % 5 = 1 THEN ['team_2'] WHEN f.n % 5 = 2 THEN [] END AS teams, CASE WHEN f.n % 4 = 1 THEN 't1' WHEN f.n % 4 = 2 THEN 't2' END AS tenant
 FROM (SELECT *, CAST(split_part(id, '__v_', 2) AS BIGINT) AS n FROM fact) f)"""


@query(
    """SELECT id, is_public, list_aggregate(roles, 'string_agg', ',') AS roles, list_aggregate(teams, 'string_agg', ',') AS teams, tenant,
 (tenant IS NULL OR tenant = 't1') AND (is_public OR coalesce(list_has_any(roles, ['viewer']), false) OR coalesce(list_has_any(teams, ['team_2']), false)) AS visible
 FROM (SELECT o.id, coalesce(o.is_public, e.is_public, false) AS is_public, coalesce(o.roles, e.roles) AS roles, coalesce(o.teams, e.teams) AS teams, coalesce(o.tenant, e.tenant) AS tenant FROM own o LEFT JOIN entity e ON o.entity_id = e.id)""",
    g.FACT, g.ENTITY, _OWN,
)
def visibility_own_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """facts with roles, teams and tenants of their own, some of them empty, over those of their entities."""
    n = F.split("id", "__v_")[1].cast("long")
    empty = F.array().cast("array<string>")
    own = g.facts(spark, d).select(
        "id", "entity_id", "is_public",
        F.when(n % 3 == 1, F.array(F.lit("editor_x"), F.lit("viewer"))).when(n % 3 == 2, empty).alias("roles"),
        F.when(n % 5 == 1, F.array(F.lit("team_2"))).when(n % 5 == 2, empty).alias("teams"),
        F.when(n % 4 == 1, "t1").when(n % 4 == 2, "t2").alias("tenant"),
    )
    rows = with_parent(own, g.entities(spark, d))
    seen = visible(VIEWER, *map(F.col, ("is_public", "roles", "teams", "tenant")))

    def text(c: str):
        return F.when(F.size(c) > 0, F.array_join(c, ","))

    return rows.select("id", F.coalesce("is_public", F.lit(False)).alias("is_public"), text("roles").alias("roles"), text("teams").alias("teams"), "tenant", seen.alias("visible"))


@query("SELECT source_id, target_id, coalesce(max(relation) FILTER (relation <> 'N'), 'N') AS relation, count(*) AS n_parallel FROM rel GROUP BY ALL", g.RELATION)
def relations_collapse(spark: SparkSession, d: str) -> DataFrame:
    """A19, W06."""
    return relations.collapse(g.relations(spark, d), "N")


@query("SELECT r.source_id, r.target_id, r.relation, p_name FROM rel r JOIN part ON target_id = p_partkey WHERE r.source_id = 7 AND p_size % 3 = 0", g.RELATION)
def relations_visible_target(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours whose target is visible (here: parts of every third size are public)."""
    part = g.table(spark, d, "part").select(F.col("p_partkey").alias("target_id"), "p_name", (F.col("p_size") % 3 == 0).alias("is_public"), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("teams"), F.lit(None).cast("string").alias("tenant"))
    return visible_rows(g.relations(spark, d).where("source_id = 7").join(part, "target_id"), VIEWER).select("source_id", "target_id", "relation", "p_name")


@query("SELECT source_id, target_id, max(relation) AS relation FROM (SELECT source_id, target_id, CASE WHEN source_id % 2 = 0 THEN 'X' ELSE relation END AS relation FROM (SELECT source_id, target_id, max(relation) AS relation FROM rel GROUP BY ALL)) GROUP BY ALL", g.RELATION)
def relation_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the batch replace those of their key."""
    base = g.relations(spark, d).groupBy("source_id", "target_id").agg(F.max("relation").alias("relation"))
    batch = base.where("source_id % 2 = 0").withColumn("relation", F.lit("X"))
    return relations.upsert(base, batch, ["source_id", "target_id"])


_CAND = "cand AS (SELECT * EXCLUDE (n) FROM (SELECT f.*, ingested_at, row_number() OVER (PARTITION BY entity_id, property, value, source_id ORDER BY f.id) AS n FROM fact f LEFT JOIN src ON f.source_id = src.id AND src.id <> 1 WHERE valid_to IS NULL) WHERE n = 1)"
_RANK = "CASE {}.confidence WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END"
_PAIR = f"""pair AS (SELECT a.entity_id, a.property, a.value AS value_a, b.value AS value_b, a.source_id AS source_id_a, b.source_id AS source_id_b,
 CASE WHEN {_RANK.format('a')} > {_RANK.format('b')} THEN 'a' WHEN {_RANK.format('b')} > {_RANK.format('a')} THEN 'b' WHEN coalesce(a.ingested_at, TIMESTAMP '1970-01-01') > coalesce(b.ingested_at, TIMESTAMP '1970-01-01') THEN 'a' ELSE 'b' END AS suggestion,
 CASE WHEN {_RANK.format('a')} > {_RANK.format('b')} THEN 'higher confidence (' || a.confidence || ' > ' || b.confidence || ')' WHEN {_RANK.format('b')} > {_RANK.format('a')} THEN 'higher confidence (' || b.confidence || ' > ' || a.confidence || ')'
  WHEN coalesce(a.ingested_at, TIMESTAMP '1970-01-01') <> coalesce(b.ingested_at, TIMESTAMP '1970-01-01') THEN 'more recent source' ELSE 'sources equally recent (tie-break b)' END AS reason
 FROM cand a JOIN cand b ON a.entity_id = b.entity_id AND a.property = b.property AND a.source_id < b.source_id AND a.value <> b.value)"""
_CONFLICT = (g.FACT, g.SOURCE, _CAND, _PAIR)


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Source 1 is not registered, so its time is unknown."""
    return conflicts.pairs(conflicts.candidates(g.facts(spark, d), g.sources(spark, d).where("id <> 1")))


@query("SELECT entity_id, property, value_a, value_b, source_id_a, source_id_b FROM pair", *_CONFLICT)
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J09, A04, J10."""
    return _found(spark, d).select("entity_id", "property", "value_a", "value_b", "source_id_a", "source_id_b")


@query("SELECT property, suggestion, reason, count(*) AS n FROM pair GROUP BY ALL", *_CONFLICT)
def conflict_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """M10, M11, M12."""
    return _found(spark, d).groupBy("property", "suggestion", "reason").agg(F.count("*").alias("n"))


@query("SELECT entity_id, property, value_a, value_b, source_id_a, source_id_b FROM pair WHERE entity_id % 3 <> 0 OR source_id_b = 2", *_CONFLICT)
def conflict_new_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of every third entity are pending already, with their sides swapped; those of source 2 name another
    source, so they are new."""
    found = _found(spark, d)
    known = found.where("entity_id % 3 = 0").select("entity_id", "property", F.col("value_b").alias("value_a"), F.col("value_a").alias("value_b"), F.when(F.col("source_id_b") == 2, 9).otherwise(F.col("source_id_b")).alias("source_id_a"), F.col("source_id_a").alias("source_id_b"), F.lit("pending").alias("status"))
    return conflicts.unreported(found, known).select("entity_id", "property", "value_a", "value_b", "source_id_a", "source_id_b")


@query("SELECT DISTINCT entity_id, property, CASE suggestion WHEN 'a' THEN value_b ELSE value_a END AS value, CASE suggestion WHEN 'a' THEN source_id_b ELSE source_id_a END AS source_id FROM pair", *_CONFLICT)
def conflict_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The facts that lose when every suggestion is approved."""
    return conflicts.losers(_found(spark, d))


@query("SELECT id, logical_id FROM fact WHERE source_id = 2 AND valid_to IS NULL", g.FACT)
def source_invalidate_direct(spark: SparkSession, d: str) -> DataFrame:
    """J13, G05."""
    return truth.derived_from(g.facts(spark, d), 2).select("id", "logical_id")


_EDGE = """edge AS (SELECT b.logical_id AS child, a.logical_id AS parent FROM (SELECT logical_id, entity_id, dense_rank() OVER (PARTITION BY entity_id ORDER BY property) AS n FROM fact WHERE valid_to IS NULL) a
 JOIN (SELECT logical_id, entity_id, confidence, dense_rank() OVER (PARTITION BY entity_id ORDER BY property) AS n FROM fact WHERE valid_to IS NULL) b ON a.entity_id = b.entity_id AND b.n = a.n + 1 AND b.confidence = 'INFERRED'),
walk AS (SELECT DISTINCT logical_id, 0 AS depth FROM fact WHERE source_id = 2 AND valid_to IS NULL UNION SELECT child, depth + 1 FROM walk JOIN edge ON parent = logical_id WHERE depth < 3)"""


@query("SELECT logical_id, min(depth) AS depth FROM walk GROUP BY logical_id HAVING min(depth) > 0", "RECURSIVE " + g.FACT, _EDGE)
def propagate_under_review(spark: SparkSession, d: str) -> DataFrame:
    """Inferred facts of the next property depend on an entity's facts."""
    from pyspark.sql.window import Window

    open_ = facts.current(g.facts(spark, d)).select("logical_id", "entity_id", "confidence", "source_id", F.dense_rank().over(Window.partitionBy("entity_id").orderBy("property")).alias("n"))
    parent = open_.select(F.col("logical_id").alias("parent"), "entity_id", (F.col("n") + 1).alias("n"))
    edges = open_.where("confidence = 'INFERRED'").join(parent, ["entity_id", "n"]).select(F.col("logical_id").alias("child"), "parent")
    return truth.propagate(open_.where("source_id = 2").select("logical_id"), edges, 3)


@query(
    "SELECT coalesce(s.logical_id, n.logical_id) AS logical_id, CASE WHEN s.logical_id IS NULL THEN 'invalidate' WHEN n.logical_id IS NULL OR s.value <> n.value THEN 'version' ELSE 'none' END AS action FROM (SELECT logical_id, CASE WHEN entity_id % 5 = 0 THEN 'old' ELSE value END AS value FROM fact WHERE valid_to IS NULL AND entity_id % 4 <> 0) s FULL JOIN (SELECT * FROM fact WHERE valid_to IS NULL) n ON s.logical_id = n.logical_id",
    g.FACT,
)
def rollback_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """J15, J16, J17."""
    rows = g.facts(spark, d)
    value = F.when(F.col("entity_id") % 5 == 0, "old").otherwise(F.col("value"))
    snapshot = facts.current(rows).where("entity_id % 4 <> 0").select("logical_id", value.alias("value"))
    return facts.reconcile(snapshot, rows).select("logical_id", "action")


@query(
    "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e JOIN (SELECT o_orderkey, o_custkey % 150 AS u, o_orderdate + INTERVAL 9500 DAY AS a, o_orderdate + INTERVAL 9530 DAY AS b FROM orders) o ON e.user_id = o.u AND e.ts >= o.a AND e.ts < o.b"
)
def asof_join_events_orders(spark: SparkSession, d: str) -> DataFrame:
    """F06 as an interval join: events in the thirty days after an order, by customer."""
    o = g.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.expr("o_orderdate + INTERVAL '9500' DAY").alias("a"), F.expr("o_orderdate + INTERVAL '9530' DAY").alias("b"))
    return intervals.interval_join(g.table(spark, d, "events"), o, ["user_id"], "ts", "a", "b").select("event_id", "o_orderkey")


@query(
    """SELECT entity_id, property, value, source_id, rival_value, rival_source_id, loses FROM (
 SELECT a.entity_id, a.property, a.value, a.source_id, b.value AS rival_value, b.source_id AS rival_source_id, (a.ra, a.ta, a.source_id) < (rb, tb, b.source_id) AS loses,
  row_number() OVER (PARTITION BY a.entity_id, a.property, a.value, a.source_id ORDER BY rb DESC, tb DESC, b.source_id DESC, b.value DESC) AS n
 FROM ordered a JOIN (SELECT *, ra AS rb, ta AS tb FROM ordered) b ON a.entity_id = b.entity_id AND a.property = b.property AND a.value <> b.value AND a.source_id <> b.source_id) WHERE n = 1""",
    g.FACT, g.SOURCE, _CAND, f"ordered AS (SELECT *, {_RANK.format('cand')} AS ra, coalesce(ingested_at, TIMESTAMP '1970-01-01') AS ta FROM cand)",
)
def conflict_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every side of a conflict with its best rival, without pairs."""
    return conflicts.classes(conflicts.candidates(g.facts(spark, d), g.sources(spark, d).where("id <> 1")))


@query(
    """SELECT 'update' AS outcome, logical_id, c_mktsegment AS value FROM customer JOIN fact ON logical_id = c_custkey || ':click:1' AND valid_to IS NULL WHERE value <> c_mktsegment
 UNION ALL SELECT 'create', c_custkey || ':segment:0', c_mktsegment FROM customer
 UNION ALL SELECT 'NOT_FOUND', c_custkey || ':click:1', NULL FROM customer WHERE c_custkey || ':click:1' NOT IN (SELECT logical_id FROM fact)
 UNION ALL SELECT 'invalidate', logical_id, value FROM fact WHERE valid_to IS NULL AND property = 'purchase'""",
    g.FACT,
)
def fact_store_writes(spark: SparkSession, d: str) -> DataFrame:
    """One property of every customer changed and another one added, a third closed, in a store that rewrites
    touched partitions only; what its audit rows say, with the values that are then open or were closed."""
    store = fact_store.FactStore.created(g.facts(spark, d), f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}")
    c, key = g.table(spark, d, "customer"), F.col("c_custkey")
    none = F.lit(None)
    seen = c.select(F.concat(key, F.lit(":click:1")).alias("logical_id"), F.col("c_mktsegment").alias("value"), none.cast("long").alias("entity_id"), none.cast("string").alias("property"))
    made = c.select(F.concat(key, F.lit(":segment:0")).alias("logical_id"), F.col("c_mktsegment").alias("value"), key.alias("entity_id"), F.lit("segment").alias("property"))
    refused = store.change(seen.union(made), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    store.invalidate(facts.current(store.read()).where("property = 'purchase'"), F.lit("2030-01-02 00:00:00").cast("timestamp_ntz"))
    done = store.versions().join(store.read().select(F.col("id").alias("fact_id"), "value"), "fact_id").select(F.col("change_type").alias("outcome"), "logical_id", "value")
    return done.union(refused.select("reason", "logical_id", F.lit(None).cast("string")))


@query(
    """SELECT 'amb-' || replace(logical_id, ':', '-') AS issue_id, 'ambiguous_fact' AS kind, value AS term, '' AS candidates FROM fact WHERE valid_to IS NULL AND confidence = 'AMBIGUOUS'
 UNION ALL SELECT 'untr-' || id, 'untranslated', coalesce(nullif(title, ''), id || ''), '' FROM doc WHERE translation_state NOT IN ('native', 'translated')
 UNION ALL SELECT 'conf-' || n_nationkey, 'pending_conflict', n_name, n_name || '|' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
 UNION ALL SELECT 'gloss-' || p_partkey, 'glossary_proposal', p_name, '' FROM part WHERE p_size % 4 = 0
 UNION ALL SELECT 'brief-1-dolce', 'brief_ambiguity', 'dolce', 'sweet|dessert'""",
    g.FACT, g.DOCUMENT,
)
def curator_issues(spark: SparkSession, d: str) -> DataFrame:
    """The five kinds of issues as one list."""
    nation, region = g.table(spark, d, "nation"), g.table(spark, d, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    conflict = pairs.select(F.col("n_nationkey").alias("id"), F.lit("e").alias("entity_id"), F.lit("p").alias("property"), F.col("n_name").alias("value_a"), F.col("r_name").alias("value_b"), F.when(F.col("n_nationkey") % 2 == 0, "pending").otherwise("approved").alias("status"))
    proposals = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.when(F.col("p_size") % 4 == 0, "pending").otherwise("rejected").alias("status"))
    brief = spark.createDataFrame([(1, "dolce", ["sweet", "dessert"])], "nth int, term string, candidates array<string>")
    found = curator.issues(g.facts(spark, d), g.documents(spark, d), conflict, proposals, brief)
    return found.select("issue_id", "kind", "term", F.array_join("candidates", "|").alias("candidates"))


@query(
    """SELECT name AS term, alias, entry_id FROM (SELECT name, alias, t.id AS entry_id, row_number() OVER (PARTITION BY name ORDER BY length(alias) DESC, alias, t.id) AS n
  FROM (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS name FROM part) JOIN (SELECT id, term AS alias FROM term) t ON contains(' ' || name || ' ', ' ' || alias || ' ')) WHERE n = 1 AND alias <> name""",
    g.TERM,
)
def curator_modifiers(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a glossary alias and more words, with their longest alias."""
    names = g.table(spark, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("term")).distinct()
    return curator.modifiers(names, g.terms(spark, d).select(F.col("term").alias("alias"), F.col("id").alias("entry_id")))


@query("SELECT c_custkey AS user_id, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS roles, coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') AS teams FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey")
def users_roles_teams(spark: SparkSession, d: str) -> DataFrame:
    """Active users with the sets of their roles and teams, many to many; users without any stay."""
    users = g.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))
    o = g.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("team"))
    return accounts.with_roles(accounts.active(users), o.select("user_id", "role"), o.select("user_id", "team")).select("user_id", F.array_join("roles", ",").alias("roles"), F.array_join("teams", ",").alias("teams"))


@query("SELECT DISTINCT c_custkey AS user_id FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR n_regionkey = 2")
def rbac_gate(spark: SparkSession, d: str) -> DataFrame:
    """Users with one of the required roles, by themselves or by their team (a nation's team has a role by
    its region)."""
    c = g.table(spark, d, "customer")
    teams = g.table(spark, d, "nation").select(F.col("n_nationkey").alias("team"), F.when(F.col("n_regionkey") == 2, "BUILDING").otherwise("none").alias("role"))
    roles = accounts.effective_roles(c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role")), teams, c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("team")))
    own = roles.groupBy("user_id").agg(F.collect_set("role").alias("roles"))
    return own.where(overlaps(F.col("roles"), ("BUILDING", "MACHINERY"))).select("user_id")


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM orders)) AS BIGINT) AS progress FROM orders GROUP BY ALL")
def job_status_list(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status with the share of all as a whole percentage."""
    o = g.table(spark, d, "orders")
    total = o.agg(F.count("*")).scalar()
    n = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return n.select("status", "n", F.floor(F.lit(100) * F.col("n") / total).cast("long").alias("progress"))


@query("SELECT event_type AS kind, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    at = [F.round(F.percentile("value", p), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return g.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(*at)


@query("SELECT o_orderkey AS id, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS age_days FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY")
def stale_files(spark: SparkSession, d: str) -> DataFrame:
    """Files older than a year at a date."""
    day = _at("2000-01-01 00:00:00")
    return g.table(spark, d, "orders").where(F.col("o_orderdate") < day - F.expr("INTERVAL '365' DAY")).select(F.col("o_orderkey").alias("id"), F.date_diff(day, F.col("o_orderdate")).cast("long").alias("age_days"))


@query("SELECT o_orderkey || '' AS entity_id, 'u' || (o_custkey % 5) AS user_id, 'decide' AS action, '{\"status\":\"pending\"}' AS old_value, '{\"status\":\"' || CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END || '\"}' AS new_value FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on every third of all queue rows; those that are pending leave an audit row."""
    o = g.table(spark, d, "orders")
    none = F.lit(None)
    queue = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"), none.cast("string").alias("resolved_by"), none.cast("timestamp_ntz").alias("resolved_at"), _at(AT).alias("created_at"))
    say = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.concat(F.lit("u"), F.col("o_custkey") % 5).alias("resolved_by"))
    return queues.decided(queue, say, _at(NOW))[1].drop("ts")


@query("SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE s_acctbal > 0 AND p_size > 10")
def symbol_edges_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose two ends are known nodes."""
    edges = g.relations(spark, d).select(F.col("source_id").alias("l_suppkey"), F.col("target_id").alias("l_partkey")).distinct()
    s = g.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = g.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return edges.join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi")
