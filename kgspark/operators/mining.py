"""Corpus mining: seed terms, statistics, decisions, golden queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_words(lines: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """Key, term for every term (one or more words) that a line holds as whole words, case-insensitively.

    Lines give their different sequences of as many words as terms have, so this is an equi-join of short rows. Only the
    lengths of terms are collected.
    """
    t = terms.select("term", F.lower("term").alias("_gram"))
    sizes = sorted(r.n for r in t.select(F.size(F.split("_gram", " ")).alias("n")).distinct().collect())
    plain = F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " ")), " ")

    def of(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.concat(*[of(w, n) for n in sizes])) if sizes else F.array().cast("array<string>")

    rows = lines.select(*key, F.explode(F.get(F.transform(F.array(plain), grams), F.lit(0))).alias("_gram"))
    return rows.join(t, "_gram").select(*key, "term").distinct()


def seed_hits(lines: DataFrame, key: list[str], text: str, terms: DataFrame) -> DataFrame:
    """Term, frequency: lines with the term, each counted once."""
    return whole_words(lines, key, text, terms).groupBy("term").agg(F.count("*").alias("frequency"))


def merged(rows: DataFrame, term: str, alias: str) -> DataFrame:
    """Term, frequency, aliases: the candidates of equal terms as one, with their different aliases in order."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set(alias)).alias("aliases"))


def contained(names: DataFrame, terms: DataFrame) -> DataFrame:
    """longer_id, shorter_id: names (id, name) that hold a shorter term (id, term; one word or more) as whole words.

    Names meet terms on their words and sequences of words, so no pairs are compared.
    """
    met = whole_words(names, ["id", "name"], "name", terms.select("term").distinct()).where(F.length("name") > F.length("term"))
    return met.select(F.col("id").alias("longer_id"), "term").join(terms.select(F.col("id").alias("shorter_id"), "term"), "term").select("longer_id", "shorter_id")


def decisions(adjudications: DataFrame, log: DataFrame) -> DataFrame:
    """Approved adjudications with the log rows of their document whose field begins with their section.

    Without any, one row says so (field ``-``).
    """
    a = adjudications.where("status = 'approved'")
    rows = log.select(F.col("document_id"), "field", "rule_id")
    met = a.join(rows, (a["document_id"] == rows["document_id"]) & F.startswith(rows["field"], a["section"]), "left")
    return met.select(a["id"], a["document_id"], F.coalesce("field", F.lit("-")).alias("field"), F.coalesce("rule_id", F.lit("NONE")).alias("rule_id"))


def golden(rows: DataFrame, id_: str, templates: dict[str, Column]) -> DataFrame:
    """Query, document_id, kind from templated columns; a query counts for the first kind that gives it."""
    parts = [rows.select(F.lit(n).alias("nth"), c.alias("query"), F.col(id_).alias("document_id"), F.lit(kind).alias("kind")) for n, (kind, c) in enumerate(templates.items())]
    both = reduce(DataFrame.union, parts).where("query IS NOT NULL AND query <> ''")
    return both.groupBy("query", "document_id").agg(F.min_by("kind", "nth").alias("kind"))
