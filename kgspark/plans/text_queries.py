"""Queries over texts, terms, numbers and units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions import language, numbers, text
from kgspark.operators import entities, evaluation, mining, packs, retrieval, sequences
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


_SCORE = ", ".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in language.MARKERS[lang].split())})))"
    + "".join(f" + (CASE WHEN contains(t, '{c}') THEN 1 ELSE 0 END)" for c in language.ACCENTS.get(lang, ""))
    + f" AS {lang}"
    for lang in language.MARKERS
)


@query(
    f"""SELECT doc_id, CASE WHEN trim(t) = '' OR greatest(en, fr, de, it, es) = 0 OR en = greatest(en, fr, de, it, es) THEN 'en' WHEN fr = greatest(fr, de, it, es) THEN 'fr' WHEN de = greatest(de, it, es) THEN 'de' WHEN it >= es THEN 'it' ELSE 'es' END AS detected
 FROM (SELECT doc_id, t, {_SCORE} FROM (SELECT doc_id, t, regexp_extract_all(t, '\\p{{L}}+') AS w FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents)))"""
)
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """T16."""
    return g.table(spark, d, "documents").select("doc_id", language.detect(F.col("text")).alias("detected"))


@query("SELECT id, lang = 'en' AND translation_state = 'pending' OR lang <> 'en' AND translation_state = 'pending' AS flag_en, lang <> 'fr' AND translation_state = 'pending' AS flag_fr, lang <> 'fr' AS doc_flag_fr, lang <> 'en' AND translation_state NOT IN ('native', 'translated') AS doc_flag_en FROM doc", g.DOCUMENT)
def localize_flags(spark: SparkSession, d: str) -> DataFrame:
    """F14, F15."""
    lang, state = F.col("lang"), F.col("translation_state")
    return g.documents(spark, d).select(
        "id", text.untranslated("en", lang, state).alias("flag_en"), text.untranslated("fr", lang, state).alias("flag_fr"),
        text.untranslated_document("fr", lang, state).alias("doc_flag_fr"), text.untranslated_document("en", lang, state).alias("doc_flag_en"),
    )


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '[.!?]\\s') THEN regexp_extract(trim(text), '(?s)^(.*?[.!?])\\s', 1) ELSE trim(text) END AS sentence FROM conversations")
def first_sentence_title(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of every turn."""
    return g.table(spark, d, "conversations").select("conv_id", "turn", text.first_sentence(F.col("text")).alias("sentence"))


_TOK = "tok AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?') AS w FROM documents))"


@query("SELECT doc_id, count(token) AS n_tokens, count(DISTINCT token) AS n_distinct FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id", _TOK)
def tokens_bigrams(spark: SparkSession, d: str) -> DataFrame:
    """Counted inside the row."""
    sizes = F.transform(F.array(text.tokens(F.col("text"))), lambda t: F.struct(F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")))
    return g.table(spark, d, "documents").select("doc_id", F.inline(sizes))


@query("SELECT token, count(DISTINCT doc_id) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 1, 6) AS idf FROM tok GROUP BY token", _TOK)
def idf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and smooth inverse; a document's tokens are made distinct in its row, so only counts move."""
    return retrieval.idf(g.table(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


@query("SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY ALL", _TOK)
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each token is found in each document, without a shuffle."""
    return g.table(spark, d, "documents").select("doc_id", F.inline(text.counted(text.tokens(F.col("text")))))


@query("SELECT p_partkey, CAST(('0x' || substr(sha256(p_name), 1, 16))::UBIGINT % 384 AS BIGINT) AS bucket, CASE WHEN (('0x' || substr(sha256(p_name), 1, 16))::UBIGINT // 2) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM part")
def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The bucket and sign of a token's hash."""
    h = text.stable_hash(F.col("p_name"))
    return g.table(spark, d, "part").select("p_partkey", (h % retrieval.DIMENSIONS).cast("long").alias("bucket"), text.hash_sign(F.col("p_name")).alias("sign"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """T08, A03."""
    return entities.duplicates(g.table(spark, d, "documents"), "text", "doc_id")


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0")
def hash_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose (key, digest) a cache does not have; the cache has every third, every ninth outdated."""
    now = g.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    cache = now.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit("outdated")).otherwise(F.col("digest")).alias("digest"))
    return entities.unseen(now, cache, "doc_id")


# RE2 has no lookarounds: signs after a word character become spaces and separators are doubled, so each match has its own.
_PLAIN_LINE = "regexp_replace(regexp_replace(regexp_replace(x, '^\\s*\\d+\\.\\s+', ''), '([\\p{L}\\p{N}_.])-', '\\1 ', 'g'), '([^\\p{L}\\p{N}_.-])', '\\1\\1', 'g')"


@query(f"SELECT doc_id, len(n) AS n_numbers, coalesce(n[1], '') AS first_number FROM (SELECT doc_id, list_filter(flatten(list_transform(string_split(regexp_replace(text, '(?s)\\A---\\s*\\n.*?\\n---\\s*\\n?', ''), chr(10)), lambda x: regexp_extract_all({_PLAIN_LINE}, '(?:^|[^\\p{{L}}\\p{{N}}_.])(-?\\d+(?:\\.\\d+)?)(?:$|[^\\p{{L}}\\p{{N}}_.])', 1))), lambda x: NOT regexp_full_match(x, '0+')) AS n FROM documents)")
def numbers_extract(spark: SparkSession, d: str) -> DataFrame:
    """M01."""
    rows = g.table(spark, d, "documents").select("doc_id", numbers.numbers(F.col("text")).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.coalesce(F.get("n", F.lit(0)), F.lit("")).alias("first_number"))


#: Unit rules of the conversions: unit, target, factor, places (null: exact).
UNITS = [("A", "ml", "100.0", 0), ("N", "g", "1.0", None), ("R", "tablespoon", "15.0", 2)]


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'ml' WHEN 'N' THEN 'g' ELSE 'tablespoon' END AS unit, CAST(CASE l_returnflag WHEN 'A' THEN l_quantity * 100 WHEN 'N' THEN l_quantity ELSE l_quantity * 15 END AS BIGINT) AS quantity FROM lineitem")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    """Exact decimal conversion by a table of unit rules."""
    rules = F.broadcast(spark.createDataFrame([(u, t, f) for u, t, f, _ in UNITS], "l_returnflag string, unit string, factor string"))
    rows = g.table(spark, d, "lineitem").join(rules, "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "unit", numbers.convert(F.col("l_quantity"), F.col("factor"), None).cast("long").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(2.125 AS DECIMAL(4,3)) AS DECIMAL(18,3)) || '', '0+$', ''), '\\.$', '') AS scaled FROM lineitem")
def dose_scale(spark: SparkSession, d: str) -> DataFrame:
    """Quantities scaled by a factor with decimals, written without trailing zeros."""
    scaled = numbers.quantity_text(F.col("l_quantity").cast("decimal(18,2)") * F.lit("2.125").cast("decimal(4,3)"))
    return g.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scaled.alias("scaled"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'l' || chr(39) || p_name WHEN 2 THEN p_name || ' dietro' ELSE p_name END AS item FROM part")
def item_clean_split(spark: SparkSession, d: str) -> DataFrame:
    """Parentheses, connectors, apostrophes and spaces by the size of the part; words that begin like a
    connector stay."""
    w, k = F.split("p_name", " "), F.col("p_size") % 4
    raw = F.when(k == 0, F.concat(F.lit("di "), w[0], F.lit(" (2 kg) e "), w[1])).when(k == 1, F.concat(F.lit("l’"), w[0], F.lit("   "), w[1], F.lit(" (a, b) ")))
    raw = raw.when(k == 2, F.concat(F.lit("E "), w[0], F.lit(" DI "), w[1], F.lit(" dietro"))).otherwise(F.concat(F.lit("  "), F.col("p_name")))
    return g.table(spark, d, "part").select("p_partkey", text.clean_item(raw).alias("item"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || p_size AS slug FROM part")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    """T06."""
    return g.table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws("  ", "p_name", "p_size")).alias("slug"))


@query("SELECT p_partkey, substr(sha256(p_name), 1, 24) AS entity_id, 'src_' || substr(sha256(p_brand), 1, 12) AS source_id FROM part")
def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    """T09."""
    return g.table(spark, d, "part").select("p_partkey", entities.made_id("", F.col("p_name"), 24).alias("entity_id"), entities.made_id("src_", F.col("p_brand")).alias("source_id"))


_LET = "let AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM conversations)"


@query("SELECT a.conv_id, a.turn, round(CASE WHEN least(len(a.w), len(b.w)) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) END, 9) AS overlap FROM let a JOIN let b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1", _LET)
def overlap_coefficient(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns paired by position."""
    c = g.table(spark, d, "conversations").select("conv_id", "turn", text.letters(F.col("text")).alias("w"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.overlap_coefficient(F.col("w"), F.col("v")), 9).alias("overlap"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS section FROM conversations")
def section_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last user turn up to each turn."""
    last = sequences.carried(F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn")
    return g.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(last, F.lit(-1).cast("long")).alias("section"))


@query("SELECT conv_id, turn, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS in_sequence FROM conversations")
def sequence_gap_check(spark: SparkSession, d: str) -> DataFrame:
    """N07."""
    return g.table(spark, d, "conversations").select("conv_id", "turn", sequences.in_sequence("conv_id", "turn").alias("in_sequence"))


@query("SELECT l_orderkey, string_agg(l_linenumber || '. ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag) || chr(10) AS body FROM lineitem GROUP BY l_orderkey")
def render_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents recomposed from their ordered parts, with one closing line end."""
    line = F.concat_ws(". ", "l_linenumber", "l_returnflag")
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", line.alias("line"))))
    return g.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))


@query("SELECT p_partkey, p_name, t.id AS term_id FROM part JOIN term t ON t.namespace = 'ingredient' AND lower(trim(split_part(p_name, ' ', 2))) = t.term", g.TERM)
def term_normalize_exact(spark: SparkSession, d: str) -> DataFrame:
    """Items to terms, exact after case folding; the glossary's size is checked by the planner, not assumed."""
    t = g.terms(spark, d).where("namespace = 'ingredient'").select("term", F.col("id").alias("term_id"))
    return g.table(spark, d, "part").withColumn("term", F.lower(F.trim(F.split("p_name", " ")[1]))).join(t, "term").select("p_partkey", "p_name", "term_id")


@query("SELECT a.id AS longer_id, b.id AS shorter_id FROM (SELECT id, x, unnest(string_split(x, ' ')) AS w FROM (SELECT DISTINCT lower(p_name) AS id, lower(p_name) AS x FROM part)) a JOIN term b ON a.w = b.term AND length(a.x) > length(b.term)", g.TERM)
def term_containment_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a shorter term as a whole word, joined on their words and not by comparing all pairs."""
    names = g.table(spark, d, "part").select(F.lower("p_name").alias("id")).distinct().withColumn("name", F.col("id"))
    return mining.contained(names, g.terms(spark, d))


@query("SELECT p_name AS term, count(*) AS frequency, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS aliases FROM part GROUP BY ALL")
def entity_merge_freq(spark: SparkSession, d: str) -> DataFrame:
    """Merged candidates with their frequency and ordered aliases."""
    return mining.merged(g.table(spark, d, "part"), "p_name", "p_brand").withColumn("aliases", F.array_join("aliases", ","))


_V = "old AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 5 <> 0), new AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_partkey % 11 <> 0)"


@query("SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN new n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v <> n.v", _V)
def pack_changelog(spark: SparkSession, d: str) -> DataFrame:
    """Added, removed and changed keys between two versions."""
    p = g.table(spark, d, "part")
    old = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    new = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("v"))
    return packs.changelog(old, new, "k", "v")


@query("SELECT CAST(count(*) FILTER (quality IS NOT NULL) AS BIGINT) AS resolved, count(*) AS total, round(count(quality) / count(*), 9) AS coverage, round(count(*) FILTER (quality = 1) / count(quality), 9) AS precision_ FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A11, A12, J22."""
    rows = g.table(spark, d, "documents").join(g.table(spark, d, "labels"), "doc_id", "left")
    return evaluation.coverage(rows, F.col("quality").isNotNull(), F.col("quality") == 1)
