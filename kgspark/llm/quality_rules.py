"""1. Quality rules: line-first cleaning, then rejection of documents that lose too much text. Native.

Each line is held against punctuation rules (most words end in symbols; a long line without a single mark; shouting;
words stuttering), a navigation rule (separators as words) and boilerplate phrases. Failed lines go, and a document that
loses more than MOST_LOST of its word characters goes whole. Everything is an expression over one row: no shuffle.

Repeated five-word windows are found inside the row as well: window hashes are sorted with their places, equal
neighbours are compared word by word, and only rows that have an equal hash at all pay for the sort.

Defined results: a null, empty or blank text has no words and fails the base rules; null doc_ids and repeated rows are
judged as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, table, words

WINDOW = 5
MOST_LOST = 0.3
LEAST_WORDS, MOST_REPEATED = 10, 0.2
_S = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
SYMBOL_END = f"{SYMBOLS}(?:{_S}|\\z)"
SEPARATOR = f"(?:\\A|{_S})[|»›•](?:{_S}|\\z)"
MARK = "[.,;:!?…]"
BOILERPLATE = (
    "(?i)(?:we use cookies|cookie (?:policy|settings|preferences)|privacy policy|terms of (?:use|service)|all rights reserved"
    "|enable javascript|javascript is (?:disabled|required)|subscribe to our newsletter|click here to|lorem ipsum|skip to (?:main )?content|back to top)"
)


def failed(line: Column, w: Column) -> Column:
    """Whether a line with the words ``w`` fails a rule; lines without words pass."""
    n = F.size(w)
    letters = F.regexp_count(line, F.lit("\\p{L}"))
    again = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(w, i) == F.get(w, i - 1)))
    return (n > 0) & (
        ((n >= 3) & (F.regexp_count(line, F.lit(SYMBOL_END)) * 5 > n))
        | ((n >= 3) & (F.regexp_count(line, F.lit(SEPARATOR)) * 10 > n))
        | ((n >= 8) & (F.regexp_count(line, F.lit(MARK)) == 0))
        | ((letters >= 10) & (F.regexp_count(line, F.lit("\\p{Lu}")) * 2 > letters))
        | ((n >= 4) & (again * 2 > n))
        | F.rlike(line, F.lit(BOILERPLATE))
    )


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: how many words lie in a five-word window found twice or more in ``words``."""
    n, last = F.size("words"), WINDOW - 1
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
    placed = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice("words", a["i"] + 1, WINDOW) == F.slice("words", b["i"] + 1, WINDOW))

    def at(j: Column) -> Column:
        return F.get("placed", j)

    twice = F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda j: F.coalesce(same(at(j), at(j - 1)), F.lit(False)) | F.coalesce(same(at(j), at(j + 1)), F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda j: at(j)["i"]))
    covered = F.transform("starts", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1), x + WINDOW) - x))
    return (
        docs.withColumn("hashes", hashes)
        .withColumn("placed", placed)
        .withColumn("starts", F.when(F.col("placed").isNotNull(), starts))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
        .drop("hashes", "placed", "starts")
    )


def quality_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the columns ``keep``, the base figures, the verdict and clean_text.

    kept is false where the base rules fail or the failed lines hold more than MOST_LOST of the word characters.
    """
    rows = documents(docs, *keep).withColumn("words", words(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    rows = _repeated(rows).drop("words")
    rows = rows.withColumn("lines", F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line"), words(line).alias("w"))))
    rows = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), F.length(F.array_join(x["w"], "")).alias("chars"), failed(x["line"], x["w"]).alias("failed"))))
    worded = F.transform(F.filter("lines", lambda x: x["chars"] > 0), lambda x: x["line"])
    lost = F.aggregate(F.filter("lines", lambda x: x["failed"]), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    base_failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MOST_REPEATED))
    return rows.withColumn("chars_lost", lost).select(
        "doc_id", *keep, "n_words", "word_chars",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.col("chars_lost") * 100 <= F.col("word_chars") * int(100 * MOST_LOST))).alias("kept"),
        F.size(F.filter("lines", lambda x: x["failed"])).cast("long").alias("n_lines_lost"),
        "chars_lost",
        F.array_join(F.transform(F.filter("lines", lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("clean_text"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


#: Rows of ``{docs}`` judged; the pipeline's SQL starts from the same text.
JUDGED = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + {WINDOW - 1}] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, k, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM
  (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT doc_id, k, line, w, length(array_to_string(w, '')) AS chars, len(w) > 0 AND (
    (len(w) >= 3 AND len(regexp_extract_all(line, '{SYMBOL_END}')) * 5 > len(w))
    OR (len(w) >= 3 AND len(regexp_extract_all(line, '{SEPARATOR}')) * 10 > len(w))
    OR (len(w) >= 8 AND NOT regexp_matches(line, '{MARK}'))
    OR (len(regexp_extract_all(line, '\\p{{L}}')) >= 10 AND len(regexp_extract_all(line, '\\p{{Lu}}')) * 2 > len(regexp_extract_all(line, '\\p{{L}}')))
    OR (len(w) >= 4 AND len(list_filter(range(2, len(w) + 1), lambda x: w[x] = w[x - 1])) * 2 > len(w))
    OR regexp_matches(line, '{BOILERPLATE}')) AS failed FROM l),
s AS (SELECT doc_id, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS n_dup_lines, count(*) FILTER (failed) AS n_lines_lost,
  coalesce(sum(chars) FILTER (failed), 0)::BIGINT AS chars_lost, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT failed), '') AS clean_text FROM j GROUP BY doc_id),
judged AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
  n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ws) < {LEAST_WORDS} OR coalesce(n, 0) * 100 > len(ws) * {int(100 * MOST_REPEATED)} AS base_failed,
  NOT (len(ws) < {LEAST_WORDS} OR coalesce(n, 0) * 100 > len(ws) * {int(100 * MOST_REPEATED)}) AND chars_lost * 100 <= length(array_to_string(ws, '')) * {int(100 * MOST_LOST)} AS kept,
  n_lines_lost, chars_lost, clean_text FROM d JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))"""

SQL = f"WITH {JUDGED} SELECT * EXCLUDE (clean_text) FROM judged"
