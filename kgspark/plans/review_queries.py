"""Review, evaluation, code modules and writes of entities and sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import code, entities, evaluation, facts, retrieval, review, sequences
from kgspark.plans import document_queries
from kgspark.sources import graph as g
from kgspark.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


_QUEUE = """q AS (SELECT id, entity_id, property, value, source_id, entity_id % 5 AS k FROM fact WHERE valid_to IS NULL)"""


@query("SELECT id, CASE k WHEN 1 THEN 'ALREADY_RESOLVED' WHEN 2 THEN 'LOSING_FACT_NOT_FOUND' WHEN 3 THEN 'INVALID_CHOICE' ELSE 'approved' END AS outcome, CASE WHEN k IN (0, 4) THEN value END AS losing_value FROM q", g.FACT, _QUEUE)
def conflict_approve(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on a queue whose losing side is each open fact, some resolved, some against a value that is not there
    and some without a valid choice; the audit row names the losing value."""
    all_ = g.facts(spark, d)
    rows = facts.current(all_).withColumn("k", F.col("entity_id") % 5)
    lost = F.when(F.col("k") == 2, F.concat("value", F.lit("?"))).otherwise(F.col("value"))
    even = F.crc32("id") % 2 == 0
    queue = stored(rows.select(
        "id", "entity_id", "property", F.when(even, lost).otherwise("winner").alias("value_a"), F.when(even, "winner").otherwise(lost).alias("value_b"),
        F.when(even, F.col("source_id")).otherwise(99).alias("source_id_a"), F.when(even, 99).otherwise(F.col("source_id")).alias("source_id_b"),
        F.when(F.col("k") == 1, "rejected").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), "k",
    ))
    say = queue.select("id", F.when(F.col("k") == 3, "c").when(even, "b").otherwise("a").alias("choice"), F.lit("u1").alias("user_id"))
    # The losing facts of entities divisible by four are under review, which does not save them.
    held = all_.withColumn("status", F.when((F.col("entity_id") % 4 == 0) & F.col("valid_to").isNull(), "under_review").otherwise(F.col("status")))
    _, _, audit, refused = review.approved(held, queue.drop("k"), say, _now())
    done = audit.select(F.col("entity_id").alias("id"), F.get_json_object("new_value", "$.status").alias("outcome"), F.get_json_object("new_value", "$.losing_value").alias("losing_value"))
    return done.union(refused.select("id", F.col("reason").alias("outcome"), F.lit(None).cast("string")))


_RETRACTED = """open AS (SELECT DISTINCT logical_id, entity_id, confidence, CASE WHEN entity_id % 40 = 0 AND source_id = 2 THEN 99 ELSE source_id END AS source_id, (entity_id + 1) || ':' || property || ':' || source_id AS parent FROM fact WHERE valid_to IS NULL)"""
_LEVEL = """l{0} AS (SELECT DISTINCT logical_id, entity_id FROM open WHERE confidence = 'INFERRED' AND (entity_id IN (SELECT entity_id FROM l{1}) OR parent IN (SELECT logical_id FROM l{1})) AND logical_id NOT IN ({2}))"""
_BEFORE = [" UNION ALL ".join(f"SELECT logical_id FROM l{i}" for i in range(n)) for n in range(4)]


@query(
    "SELECT 'invalidated' AS kind, logical_id AS fact_id FROM l0 UNION ALL SELECT 'under_review', logical_id FROM l1 UNION ALL SELECT 'under_review', logical_id FROM l2 UNION ALL SELECT 'under_review', logical_id FROM l3",
    g.FACT, _RETRACTED, "l0 AS (SELECT logical_id, entity_id FROM open WHERE source_id = 99)", *[_LEVEL.format(n, n - 1, _BEFORE[n]) for n in (1, 2, 3)],
)
def source_invalidate_report(spark: SparkSession, d: str) -> DataFrame:
    """What the invalidation of a source closes, and what comes under review in three steps over the entities of
    facts and over edges: each fact hangs on the same property of the next entity."""
    moved = F.when((F.col("entity_id") % 40 == 0) & (F.col("source_id") == 2), 99).otherwise(F.col("source_id"))
    rows = g.facts(spark, d)
    edges = rows.select(F.col("logical_id").alias("child"), F.concat_ws(":", F.col("entity_id") + 1, "property", "source_id").alias("parent")).distinct()
    sources = g.sources(spark, d).union(spark.sql("SELECT 99, TIMESTAMP_NTZ '2024-01-01'"))
    return review.invalidated(rows.withColumn("source_id", moved), sources, 99, edges, "retracted", "u1", _now())[2]


@query("SELECT logical_id, value FROM fact WHERE valid_to IS NULL AND entity_id IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem))", g.FACT)
def document_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The current facts of the entities of one document."""
    lines = g.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("entity_id"))
    return review.snapshot(lines, g.facts(spark, d), lines.agg(F.min("document_id")).first()[0])


@query("SELECT p_partkey AS id, 'inserted' AS outcome FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'exists' FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'repeated' FROM part WHERE p_partkey % 4 = 0")
def entity_insert_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every third part is there, every second one is inserted, every fourth one twice."""
    p = g.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    held = p.where("id % 3 = 0")
    batch = p.where("id % 2 = 0").union(p.where("id % 4 = 0"))
    after, refused = entities.inserted(held, batch)
    return after.where("id % 3 <> 0").select("id", F.lit("inserted").alias("outcome")).union(refused.select("id", "reason"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND max(o_orderkey) IS NOT NULL THEN 'order-' || max(o_orderkey) ELSE c_name END AS uri, greatest(TIMESTAMP '1995-01-01', max(o_orderdate) FILTER (c_custkey % 2 = 0)) AS ingested_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a batch merged in, several rows of a source in it; the latest one counts."""
    held = g.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("uri"), F.lit("1995-01-01").cast("timestamp_ntz").alias("ingested_at"))
    o = g.table(spark, d, "orders").where("o_custkey % 2 = 0")
    batch = o.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ingested_at")).agg(F.max("o_orderkey").alias("k"))
    last = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("last"))
    batch = batch.join(last, "id").select("id", F.concat(F.lit("order-"), "last").alias("uri"), "ingested_at")
    return entities.sources_upserted(held, batch)


@query("SELECT a.conv_id, a.turn, b.turn AS other_turn, a.n AS position FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role = 'user') a FULL JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role <> 'user') b ON a.conv_id = b.conv_id AND a.n = b.n WHERE a.turn IS NOT NULL AND b.turn IS NOT NULL")
def position_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The turns of both sides of a conversation paired by their place on their side."""
    c = g.table(spark, d, "conversations")
    return sequences.paired(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id", "role", "turn")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-CH' WHEN 2 THEN 'en' ELSE '' END AS lang FROM documents")
def accept_language(spark: SparkSession, d: str) -> DataFrame:
    """F16: the language asked for: by parameter, by header, by parameter over header, or none."""
    k = F.col("doc_id") % 4
    given = F.when(k == 0, F.col("lang")).when(k == 2, "en").when(k == 3, "")
    header = F.when(k == 1, F.concat("lang", F.lit("-CH;q=0.9, en;q=0.5"))).when(k == 2, F.concat("lang", F.lit(", fr")))
    return g.table(spark, d, "documents").select("doc_id", F.coalesce(text.accept_language(given, header), F.lit("")).alias("lang"))


@query(
    """SELECT round(sum(m) / sum(a), 4) AS precision, round(sum(m) / sum(b), 4) AS recall, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(a) AS BIGINT) AS draft_resolved, CAST(sum(b) AS BIGINT) AS golden_resolved FROM (
 SELECT CASE WHEN p_partkey % 4 <> 0 THEN 1 ELSE 0 END AS a, CASE WHEN p_size % 3 <> 0 THEN 1 ELSE 0 END AS b, CASE WHEN p_partkey % 4 <> 0 AND p_size % 3 <> 0 AND p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS m FROM part)"""
)
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """A draft that leaves every fourth mention, and is wrong in every fifth, against a golden set."""
    p = g.table(spark, d, "part")
    golden = p.select(F.col("p_partkey").alias("doc"), F.lit(0).alias("nth"), F.col("p_name").alias("item"), (F.col("p_size") % 3 != 0).alias("resolved"))
    wrong = F.when(F.col("p_partkey") % 5 == 0, "wrong").otherwise(F.upper("p_name"))
    draft = p.select(F.col("p_partkey").alias("doc"), F.lit(0).alias("nth"), wrong.alias("item"), (F.col("p_partkey") % 4 != 0).alias("resolved"))
    return evaluation.normalization(draft, golden)


@query(
    """SELECT round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 4) AS recall, count(*) AS n FROM (SELECT q.p_partkey AS q, x.p_partkey AS t, row_number() OVER (PARTITION BY q.p_partkey ORDER BY
  (lower(q.p_brand) = lower(x.p_brand))::INT + (split_part(q.p_name, ' ', 1) = split_part(x.p_name, ' ', 1))::INT + (split_part(q.p_name, ' ', 2) = split_part(x.p_name, ' ', 2))::INT DESC, x.p_partkey) AS rank
 FROM part q JOIN part x ON q.p_partkey % 100 = 0) WHERE q = t"""
)
def recall_at_5(spark: SparkSession, d: str) -> DataFrame:
    """Parts with ids divisible by 100 are asked for by name and brand; all parts that share a word are ranked by
    how many they share."""
    p = g.table(spark, d, "part")
    named = p.select(F.col("p_partkey").alias("id"), F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_brand"))))).alias("words")).where("words IS NOT NULL")
    ranked = retrieval.shared_words(named.where("id % 100 = 0"), named, 5)
    golden = named.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("target_id")).distinct()
    return evaluation.recall_at(golden, ranked, 5)


_GATES = f"""SELECT metric, value, coalesce(value >= least, false) AS passed FROM (SELECT unnest(['roundtrip', 'relative_coverage', 'recall_at_5']) AS metric, unnest([1.0, 0.9, 0.85]::DOUBLE[]) AS least,
 unnest([(SELECT ratio FROM ({document_queries.SQL['roundtrip_ratio']})), (SELECT round(count(quality) / count(*), 4) FROM documents LEFT JOIN labels USING (doc_id)), (SELECT recall FROM ({SQL['recall_at_5']}))]::DOUBLE[]) AS value)"""


@query(_GATES)
def conformance_gates(spark: SparkSession, d: str) -> DataFrame:
    """The three gates on the ratios that are measured: round trips of documents, labels of documents, Recall@5."""
    rows = g.table(spark, d, "documents").join(g.table(spark, d, "labels"), "doc_id", "left")
    round_trips, recall = document_queries.roundtrip_ratio(spark, d).first().ratio, recall_at_5(spark, d).first().recall
    metrics = rows.agg(F.lit(round_trips).alias("roundtrip"), F.round(F.count("quality") / F.count("*"), 4).alias("relative_coverage"), F.lit(recall).alias("recall_at_5"))
    return evaluation.gates(metrics)


_UNITS = "SELECT CASE l_returnflag WHEN 'A' THEN 'dl' WHEN 'N' THEN 'g' ELSE 'cup' END AS unit, count(*) AS n FROM lineitem GROUP BY ALL"


@query(_UNITS)
def unit_observations(spark: SparkSession, d: str) -> DataFrame:
    """A08."""
    unit = F.when(F.col("l_returnflag") == "A", "dl").when(F.col("l_returnflag") == "N", "g").otherwise("cup")
    return evaluation.unit_counts(g.table(spark, d, "lineitem").select(unit.alias("unit")))


def _code(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions as modules, nations as functions, customers of high balance as classes; modules import the next one."""
    r, n = g.table(spark, d, "region"), g.table(spark, d, "nation")
    file = F.concat(F.lit("src/r"), "n_regionkey", F.lit(".py"))
    module = r.select(F.concat(F.lit("m"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("module").alias("kind"), F.concat(F.lit("src/r"), "r_regionkey", F.lit(".py")).alias("source_file"), F.lit(None).cast("string").alias("source_location"))
    function = n.select(F.concat(F.lit("f"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("function"), file, F.concat(F.lit("L"), 100 - F.floor(F.col("n_nationkey") / 7)))
    c = g.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 0")
    class_ = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("class"), file, F.lit("?"))
    imports = r.select(F.concat(F.lit("m"), "r_regionkey").alias("source"), F.concat(F.lit("m"), (F.col("r_regionkey") + 1) % 4).alias("target"), F.lit("imports_from").alias("relation"))
    calls = c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("f"), "n_nationkey"), F.lit("calls"))
    lost = n.select(F.concat(F.lit("f"), "n_nationkey"), F.lit("nowhere"), F.lit("calls"))
    return module.union(function).union(class_), imports.union(calls).union(calls).union(lost)


_SYM = """sym AS (SELECT n_regionkey AS r, 'function' AS kind, n_name AS label, 100 - n_nationkey // 7 AS line, 'f' || n_nationkey AS node FROM nation
 UNION ALL SELECT n_regionkey, 'class', c_name, 0, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
 UNION ALL SELECT a.r_regionkey, 'dependency', b.r_name, 0, NULL FROM region a JOIN region b ON b.r_regionkey = (a.r_regionkey + 1) % 4),
pos AS (SELECT *, row_number() OVER (PARTITION BY r, kind ORDER BY line, label, node) - 1 AS position FROM sym)"""


@query(
    """SELECT 'id_code_src_r' || r || '_py' AS document_id, concat_ws(chr(10), '---', 'title: ' || r_name, 'id: src/r' || r || '.py', 'lang: en', 'source_lang: en', 'verification_level: L1', 'canonical_version: 1', '---',
 '## Functions', string_agg('- ' || label, chr(10) ORDER BY position) FILTER (kind = 'function'), '## Classes', string_agg('- ' || label, chr(10) ORDER BY position) FILTER (kind = 'class'),
 '## Dependencies', string_agg('- ' || label, chr(10) ORDER BY position) FILTER (kind = 'dependency')) || chr(10) AS md FROM pos JOIN region ON r = r_regionkey GROUP BY r, r_name""",
    _SYM,
)
def code_documents(spark: SparkSession, d: str) -> DataFrame:
    """One canonical document for each module."""
    nodes, edges = _code(spark, d)
    return code.documents(nodes, code.symbols(nodes, edges))


@query("SELECT DISTINCT 'id_code_src_r' || a.r || '_py:cls:' || a.position AS source_id, 'id_code_src_r' || b.r || '_py:fn:' || b.position AS target_id, 'calls' AS relation FROM pos a JOIN customer ON a.node = 'c' || c_custkey JOIN pos b ON b.node = 'f' || c_nationkey", _SYM)
def code_relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between symbols by their entities' ids."""
    nodes, edges = _code(spark, d)
    return code.relations(edges, code.entity_rows(code.symbols(nodes, edges)))
