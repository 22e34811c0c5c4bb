"""Orders as markdown documents through parsing, canonical form, change log, verification and recomposition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import normalize as n
from kgspark.operators import packs, relations, template
from kgspark.plans.retrieval_queries import TASK_ROWS
from kgspark.sources import graph as g
from kgspark.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UNITS = {"A": "dl", "N": "g", "R": "cup"}
RULES = {"dl": ("ml", "100", 0), "cup": ("cup", "1", None)}
TERMS = {"small ring": "little ring", "red widget": "crimson widget"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sources(spark: SparkSession, d: str, units: dict[str, str] = UNITS) -> DataFrame:
    """o_orderkey, md: an order's lines as items and steps."""
    p = g.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = g.table(spark, d, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_ROWS))  # a task has as many rows whatever the input
    rows = lines.join(p, "l_partkey")
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.col("l_returnflag")).alias("unit")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    # Short values are shuffled; texts are made of them afterwards.
    lines = rows.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*order, unit, "p_name"))).alias("x"))
    qty = lambda x: x["l_quantity"].cast("int").cast("string")
    items = F.transform("x", lambda x: F.concat_ws(" ", F.lit("-"), qty(x), x["unit"], x["p_name"]))
    steps = F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Add the "), x["p_name"], F.lit(" and wait "), qty(x), F.lit(" min.")))
    head = F.concat(F.lit("---\ntitle: Order "), F.col("o_orderkey").cast("string"), F.lit("\nid: ord-"), F.col("o_orderkey").cast("string"), F.lit("\nlang: en\nservings: "), F.size("x").cast("string"), F.lit(f"\n---\n{n.ITEMS}\n"))
    md = F.concat(head, F.array_join(items, "\n"), F.lit(f"\n{n.STEPS}\n"), F.array_join(steps, "\n"), F.lit("\n"))
    return lines.select("o_orderkey", md.alias("md"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Parsed once and written: several projections read it."""
    return stored(sources(spark, d).withColumn("doc", n.parse(F.col("md"), tuple(UNITS.values()))))


def canonicalized(spark: SparkSession, d: str) -> DataFrame:
    return stored(parsed(spark, d).withColumn("canon", n.canonical(F.col("doc"), RULES, TERMS)))


@query("SELECT l_orderkey AS o_orderkey, count(*) AS n_items, count(*) AS n_steps, count(*) || '' AS servings FROM lineitem GROUP BY l_orderkey")
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    """S11, T10-T12."""
    told = lambda doc: F.struct(F.size(doc["items"]).cast("long").alias("n_items"), F.size(doc["steps"]).cast("long").alias("n_steps"), F.element_at(doc["fm"], "servings").alias("servings"))
    row = template.once(n.parse(F.col("md"), tuple(UNITS.values())), told)
    return sources(spark, d).select("o_orderkey", F.inline(F.array(row)))  # a generator: the row is computed once


@query("SELECT round(avg(CASE WHEN o % 5 IN (1, 2, 3) THEN 0.0 ELSE 1.0 END), 9) AS ratio, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem)")
def roundtrip_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Documents that come back byte for byte from their graph rows; by key some have two line ends at
    their end, a step out of number or an empty line, which no graph row holds."""
    k = F.col("o_orderkey") % 5
    odd = F.when(k == 1, F.concat("md", F.lit("\n"))).when(k == 2, F.regexp_replace("md", "\n1\\. ", "\n7. ")).when(k == 3, F.regexp_replace("md", f"\n{n.STEPS}", f"\n\n{n.STEPS}")).otherwise(F.col("md"))
    # Documents lie by their key once they are made, and so do their graph's rows: these are read where they are.
    docs = sources(spark, d).select("o_orderkey", odd.alias("md")).withColumn("doc", n.parse(F.col("md"), tuple(UNITS.values())))
    again = n.recomposed(n.graph_rows(docs, "o_orderkey", "doc", beside="md"), "o_orderkey")
    same = F.coalesce(F.col("label") == n.render(F.col("doc")), F.lit(False)).cast("double")
    told = again.select(F.inline(F.array(F.struct(same.alias("same")))))  # compared once
    return told.agg(F.round(F.avg("same"), 9).alias("ratio"), F.count("*").alias("n"))


_ITEM = "SELECT l_orderkey, p_name, l_returnflag, CAST(l_quantity AS INT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(
    f"""SELECT l_orderkey AS o_orderkey, field, before_text, after_text, count(*) AS n FROM (
 SELECT l_orderkey, 'items.qty' AS field, q || '' AS before_text, (q * 100) || '' AS after_text FROM ({_ITEM}) WHERE l_returnflag = 'A' AND q <> 0
 UNION ALL SELECT l_orderkey, 'items.unit', 'dl', 'ml' FROM ({_ITEM}) WHERE l_returnflag = 'A'
 UNION ALL SELECT l_orderkey, 'items.item', p_name, CASE p_name WHEN 'small ring' THEN 'little ring' ELSE 'crimson widget' END FROM ({_ITEM}) WHERE p_name IN ('small ring', 'red widget')) GROUP BY ALL"""
)
def canon_log_diff(spark: SparkSession, d: str) -> DataFrame:
    """One row for each difference, counted by its text."""
    log = n.change_log(canonicalized(spark, d), "o_orderkey", "doc", "canon")
    return log.groupBy("o_orderkey", "field", "before_text", "after_text").agg(F.count("*").alias("n"))


@query("SELECT round(avg(CASE WHEN o % 7 = 0 AND a > 0 THEN 0.0 ELSE 1.0 END), 9) AS replayed, count(*) AS n FROM (SELECT l_orderkey AS o, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY l_orderkey)")
def canon_log_replay(spark: SparkSession, d: str) -> DataFrame:
    """The log applied to the parsed documents gives the canonical ones, but where rows of the log are lost: every
    seventh document loses its changes of units."""
    docs = canonicalized(spark, d)
    log = n.change_log(docs, "o_orderkey", "doc", "canon").where("NOT (o_orderkey % 7 = 0 AND field = 'items.unit')")
    done = n.replay(docs, "o_orderkey", "doc", log)
    same = (F.to_json("items") == F.to_json("canon.items")).cast("double")
    return docs.join(done, "o_orderkey").agg(F.round(F.avg(same), 9).alias("replayed"), F.count("*").alias("n"))


@query(
    """SELECT l_orderkey AS o_orderkey, issue FROM (SELECT l_orderkey, unnest(list_filter([CASE WHEN l_orderkey % 5 = 1 THEN 'INGREDIENT_COUNT_MISMATCH' END, CASE WHEN l_orderkey % 5 = 2 THEN 'STEP_COUNT_MISMATCH' END,
 CASE WHEN l_orderkey % 5 = 3 THEN 'SERVINGS_MISMATCH' END, CASE WHEN l_orderkey % 5 IN (1, 2, 4) THEN 'P2_NUMBER_INVARIANT' END], lambda x: x IS NOT NULL)) AS issue FROM (SELECT DISTINCT l_orderkey FROM lineitem))"""
)
def verify_counts_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents corrupted by key: an item lost, a step added, servings or a number changed."""
    docs = stored(sources(spark, d))
    k = F.col("o_orderkey") % 5
    bad = F.when(k == 1, F.regexp_replace("md", "(?s)^(.*?## Items\\n)[^\\n]*\\n?", "$1")).when(k == 2, F.concat("md", F.lit("99. Wait 999 min.\n"))).when(k == 3, F.regexp_replace("md", "servings: ", "servings: 9")).when(k == 4, F.regexp_replace("md", "\\n1\\. ", "\n1. With 777 more, ")).otherwise(F.col("md"))
    units = tuple(UNITS.values())
    rows = stored(docs.select("o_orderkey", n.parse(F.col("md"), units).alias("a"), n.parse(bad, units).alias("b")))
    return rows.select("o_orderkey", F.explode(n.verify_counts(F.col("a"), F.col("b"))).alias("issue"))


@query("SELECT l_orderkey AS o_orderkey, CASE WHEN bool_or(contains(p_name, 'ring')) THEN -1 ELSE count(*) END AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def translate_guarded(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary translation keeps all numbers; a term that brings a number of its own (ring) is
    refused with its whole document."""
    terms = {"add the": "aggiungi", "wait": "aspetta", "small": "piccolo", "ring": "anello 2"}
    out = stored(sources(spark, d)).select("o_orderkey", n.translate(F.col("md"), terms).alias("t"))
    return out.select("o_orderkey", F.coalesce(F.regexp_count("t", F.lit("aspetta \\d+ min\\.")), F.lit(-1)).cast("long").alias("n"))


@query(
    """WITH w AS (SELECT l_orderkey AS o, list_distinct(flatten(list(string_split(p_name, ' ')))) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
v AS (SELECT o, a, CASE WHEN o % 2 = 0 THEN list_distinct(list_transform(a, lambda x: CASE x WHEN 'widget' THEN 'gadget' WHEN 'ring' THEN 'loop' ELSE x END)) ELSE a END AS b FROM w),
s AS (SELECT o, unnest(['title', 'items', 'steps']) AS section, unnest([['order'], a, list_concat(a, ['add', 'the', 'and', 'wait', 'min'])]) AS a, unnest([CASE WHEN o % 3 = 0 THEN ['bestellung'] ELSE ['order'] END, b, list_concat(b, ['add', 'the', 'and', 'wait', 'min'])]) AS b FROM v)
SELECT o AS o_orderkey, section, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) < CASE section WHEN 'title' THEN 0.4 WHEN 'items' THEN 0.5 ELSE 0.3 END AS escalate FROM s"""
)
def verify_sections_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap by section of documents whose words are changed by their key."""
    k = F.col("o_orderkey")
    other = F.when(k % 2 == 0, F.regexp_replace(F.regexp_replace("md", "widget", "gadget"), "ring", "loop")).otherwise(F.col("md"))
    other = F.when(k % 3 == 0, F.regexp_replace(other, "title: Order", "title: Bestellung")).otherwise(other)
    units = tuple(UNITS.values())
    rows = stored(stored(sources(spark, d)).select("o_orderkey", n.parse(F.col("md"), units).alias("a"), n.parse(other, units).alias("b")))
    return rows.select("o_orderkey", F.inline(n.verify_sections(F.col("a"), F.col("b"))))


PLAIN = template.Template(n.ITEMS, n.STEPS, n.KEYS, ("servings",), ())


@query(
    """SELECT o AS o_orderkey, CASE o % 8 WHEN 0 THEN 0 ELSE 1 END AS n_errors,
 CASE o % 8 WHEN 1 THEN 'NO_FRONT_MATTER' WHEN 2 THEN 'NOT_AN_INTEGER' WHEN 3 THEN 'MISSING_SECTION' WHEN 4 THEN 'ITEM_EXPECTED' WHEN 5 THEN 'QUANTITY_EXPECTED' WHEN 6 THEN 'STEP_NUMBER' WHEN 7 THEN 'NO_STEPS' END AS code,
 CASE o % 8 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 * n + 2 WHEN 7 THEN n + 2 ELSE 0 END AS line FROM (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey)"""
)
def parse_strict(spark: SparkSession, d: str) -> DataFrame:
    """Coded errors with their lines, of documents broken in seven ways by their key."""
    k, md = F.col("o_orderkey") % 8, F.col("md")
    bad = (
        F.when(k == 1, F.regexp_replace(md, "\\A---\n", ""))
        .when(k == 2, F.regexp_replace(md, "servings: \\d+", "servings: many"))
        .when(k == 3, F.regexp_replace(md, n.ITEMS, "## Things"))
        .when(k == 4, F.regexp_replace(md, f"{n.ITEMS}\n- ", f"{n.ITEMS}\n* "))
        .when(k == 5, F.regexp_replace(md, f"{n.ITEMS}\n- \\d+", f"{n.ITEMS}\n- some"))
        .when(k == 6, F.regexp_replace(md, "\n\\d+(\\. [^\n]*\n)\\z", "\n99$1"))
        .when(k == 7, F.regexp_replace(md, f"(?s)(\n{n.STEPS}\n).*", "$1"))
        .otherwise(md)
    )
    first = lambda e: F.get(e, F.lit(0))
    told = lambda e: F.struct(F.size(e).alias("n_errors"), first(e)["code"].alias("code"), F.coalesce(first(e)["line"], F.lit(0)).cast("long").alias("line"))
    row = template.once(template.errors(bad, PLAIN, tuple(UNITS.values())), told)
    return sources(spark, d).select("o_orderkey", F.inline(F.array(row)))  # a generator: the row is computed once


@query(
    """SELECT o AS o_orderkey, CASE o % 9 WHEN 1 THEN 'ID_MISMATCH' WHEN 2 THEN 'LANG_MISMATCH' WHEN 3 THEN 'SOURCE_LANG_MISMATCH' WHEN 4 THEN 'TIME_MIN_MISMATCH' WHEN 5 THEN 'DIFFICULTY_MISMATCH'
 WHEN 6 THEN 'INGREDIENT_COUNT_MISMATCH,P2_NUMBER_INVARIANT' WHEN 7 THEN 'TRANSLATED_PARSE,P2_NUMBER_INVARIANT' WHEN 8 THEN 'STEP_COUNT_MISMATCH' ELSE '' END AS issues FROM (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE o % 9 <> 6 OR n > 1
 UNION ALL SELECT o, 'TRANSLATED_PARSE,P2_NUMBER_INVARIANT' FROM (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE o % 9 = 6 AND n = 1"""
)
def verify_l1(spark: SparkSession, d: str) -> DataFrame:
    """Translations broken in eight ways by their key, held against their sources."""
    k, level = F.col("o_orderkey") % 9, F.col("o_orderkey") % 3
    head = "\n---\n" + n.ITEMS
    source = F.regexp_replace("md", "lang: en", "lang: it")
    source = F.regexp_replace(source, head, F.concat(F.lit("\ntime_min: 30\ndifficulty: "), F.element_at(F.array(*map(F.lit, template.LEVELS)), (level + 1).cast("int")), F.lit(f"\n---\n{template.SOURCE.items}")))
    source = F.regexp_replace(source, n.STEPS, template.SOURCE.steps)
    other = F.regexp_replace("md", head, F.concat(F.lit("\ntime_min: 30\ndifficulty: "), F.element_at(F.array(*map(F.lit, template.LEVELS.values())), (level + 1).cast("int")), F.lit(f"\nsource_lang: it\n---\n{template.TRANSLATED.items}")))
    other = F.regexp_replace(other, n.STEPS, template.TRANSLATED.steps)
    bad = (
        F.when(k == 1, F.regexp_replace(other, "\nid: ord", "\nid: doc"))
        .when(k == 2, F.regexp_replace(other, "\nlang: en", "\nlang: de"))
        .when(k == 3, F.regexp_replace(other, "source_lang: it", "source_lang: fr"))
        .when(k == 4, F.regexp_replace(other, "time_min: 30", "time_min: 31"))
        .when(k == 5, F.regexp_replace(other, "difficulty: hard", "difficulty: easy"))
        .when(k == 6, F.regexp_replace(other, f"{template.TRANSLATED.items}\n[^\n]*\n", f"{template.TRANSLATED.items}\n"))
        .when(k == 7, F.regexp_replace(other, "\\A---\n", ""))
        .when(k == 8, F.concat(other, (F.regexp_count(other, F.lit("\n\\d+\\. ")) + 1).cast("string"), F.lit(". Serve.\n")))
        .otherwise(other)
    )
    rows = stored(stored(sources(spark, d)).select("o_orderkey", source.alias("a"), bad.alias("b")))
    found = template.verify(F.col("a"), F.col("b"), tuple(UNITS.values()))
    return rows.select("o_orderkey", F.array_join(found, ",").alias("issues"))


PACK = packs.Pack(
    "pans", "1.0.0",
    entries=(
        {"namespace": "ingredienti", "id": "ING-1", "labels_en": "little ring", "labels_it": "anellino", "aliases": ["small ring"]},
        {"namespace": "ingredienti", "id": "ING-2", "labels_en": "crimson widget", "labels_it": "coso", "aliases": ["RED widget", "little ring"]},
    ),
    units=(packs.UnitRule("UNIT-DL", "dl", "ml", "100", 0), packs.UnitRule("UNIT-CUP", "tazza", "cup", "1.0"), packs.UnitRule("UNIT-ML", "ml", "l", "0.001", 3)),
    plurals={"cup": "cups"},
)


@query(
    f"""SELECT l_orderkey AS o_orderkey, field, before_text, after_text, rule_id, count(*) AS n FROM (
 SELECT l_orderkey, 'qty' AS field, q || '' AS before_text, (q * 100) || '' AS after_text, 'UNIT-DL' AS rule_id FROM ({_ITEM}) WHERE l_returnflag = 'A' AND q <> 0
 UNION ALL SELECT l_orderkey, 'unit', 'dl', 'ml', 'UNIT-DL' FROM ({_ITEM}) WHERE l_returnflag = 'A'
 UNION ALL SELECT l_orderkey, 'unit', 'cups', 'cup', 'UNIT-CUP' FROM ({_ITEM}) WHERE l_returnflag = 'R'
 UNION ALL SELECT l_orderkey, 'item', p_name, CASE p_name WHEN 'small ring' THEN 'little ring' ELSE 'crimson widget' END, 'GLOSSARY' FROM ({_ITEM}) WHERE p_name IN ('small ring', 'red widget')
 UNION ALL SELECT DISTINCT l_orderkey, 'unresolved', p_name, NULL, NULL FROM ({_ITEM}) WHERE p_name NOT IN ('small ring', 'red widget')) GROUP BY ALL"""
)
def canonicalize_items(spark: SparkSession, d: str) -> DataFrame:
    """Items by a pack's unit rules and glossary, with the rule of each change and the terms that
    are left for the queue."""
    units = UNITS | {"R": "cups"}
    known = tuple(units.values())
    docs = stored(stored(sources(spark, d, units)).withColumn("doc", n.parse(F.col("md"), known)))
    rows = stored(docs.select("o_orderkey", packs.canonical(F.col("doc"), PACK).alias("c")))
    log = rows.select("o_orderkey", F.inline("c.log")).select("o_orderkey", F.substring_index("field", ".", -1).alias("field"), "before_text", "after_text", "rule_id")
    lost = rows.select("o_orderkey", F.lit("unresolved").alias("field"), F.explode("c.unresolved").alias("before_text"), F.lit(None).cast("string").alias("after_text"), F.lit(None).cast("string").alias("rule_id"))
    return log.union(lost).groupBy("o_orderkey", "field", "before_text", "after_text", "rule_id").agg(F.count("*").alias("n"))


@query(
    """SELECT o AS o_orderkey, string_agg(line, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, q) AS items, CAST(sum(logged) AS BIGINT) AS n_log FROM (
 SELECT o, l_linenumber, l_partkey, l_suppkey, q, regexp_replace(regexp_replace(printf('%d.%02d', c // 100, c % 100), '0+$', ''), '\\.$', '') || unit || p_name AS line, logged FROM (
  SELECT o, l_linenumber, l_partkey, l_suppkey, q, p_name, (2 * q * factor * 1000 + n) // (2 * n) AS c, unit, logged FROM (
   SELECT l_orderkey AS o, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, p_name, count(*) OVER (PARTITION BY l_orderkey) AS n,
    CASE l_returnflag WHEN 'R' THEN 250 ELSE 1 END AS factor, CASE l_returnflag WHEN 'A' THEN ' dl ' WHEN 'N' THEN ' g ' ELSE ' ml ' END AS unit, CASE l_returnflag WHEN 'N' THEN 1 ELSE 2 END AS logged
   FROM lineitem JOIN part ON l_partkey = p_partkey))) GROUP BY o"""
)
def dose_standardize(spark: SparkSession, d: str) -> DataFrame:
    """Metric doses for ten servings, with a log row for each conversion, unknown unit and scaling."""
    rows = stored(parsed(spark, d).select("o_orderkey", packs.doses(F.col("doc")).alias("x")))
    line = F.transform("x.items", lambda i: F.concat_ws(" ", i["qty"], i["unit"], i["item"]))
    return rows.select("o_orderkey", F.array_join(line, "|").alias("items"), F.size("x.log").cast("long").alias("n_log"))


@query("SELECT id, namespace, label_en, false AS is_public FROM (VALUES ('ingredienti:ING-1', 'ingredienti', 'little ring'), ('ingredienti:ING-2', 'ingredienti', 'crimson widget')) v(id, namespace, label_en) UNION ALL SELECT 'state:' || s, 'state', s, true FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS s FROM part)")
def pack_terms(spark: SparkSession, d: str) -> DataFrame:
    """A pack's terms merged over stored ones, of which one is outdated."""
    new = packs.terms(spark, PACK)
    word = F.split("p_name", " ")[0]
    none = F.lit(None).cast("string")
    held = g.table(spark, d, "part").select(F.concat(F.lit("state:"), word).alias("id"), F.lit("state").alias("namespace"), word.alias("term_id"), word.alias("label_en"), word.alias("label_it"), F.lit("").alias("definition"), none.alias("ontology_uri"), F.lit(True).alias("is_public"), F.array().cast("array<string>").alias("roles"), F.array().cast("array<string>").alias("teams")).distinct()
    old = new.where("term_id = 'ING-1'").withColumns({"label_en": F.lit("outdated"), "is_public": F.lit(True)})
    return relations.upsert(held.union(old), new, ["id"]).select("id", "namespace", "label_en", "is_public")
