"""What a curator has to look at, and which glossary entry a term extends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.functions.text import folded, slug
from kgspark.operators.mining import whole_words


def issues(facts: DataFrame, documents: DataFrame, conflicts: DataFrame, proposals: DataFrame, brief: DataFrame | None = None) -> DataFrame:
    """issue_id, kind, term, candidates, note, from five sources.

    facts: logical_id, entity_id, value, valid_to, confidence; documents: id, title, translation_state; conflicts: id,
    entity_id, property, value_a, value_b, status; proposals: id, term, status; brief: nth, term, candidates.
    """
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, kind: str, prefix: str, key: Column, term: Column, note: Column, candidates: Column = none) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), key).alias("issue_id"), F.lit(kind).alias("kind"), term.alias("term"), candidates.alias("candidates"), note.alias("note"))

    open_ = facts.where("valid_to IS NULL AND confidence = 'AMBIGUOUS'")
    flagged = documents.where("coalesce(translation_state, 'native') NOT IN ('native', 'translated')")
    sides = F.array(F.coalesce("value_a", F.lit("")), F.coalesce("value_b", F.lit("")))
    parts = [
        rows(open_, "ambiguous_fact", "amb-", slug(F.col("logical_id")), F.col("value"), F.concat(F.lit("AMBIGUOUS fact "), "logical_id", F.lit(" on entity "), "entity_id")),
        rows(flagged, "untranslated", "untr-", slug(F.col("id").cast("string")), F.coalesce(F.nullif("title", F.lit("")), F.col("id").cast("string")), F.concat(F.lit("translation_state="), "translation_state")),
        rows(conflicts.where("status = 'pending'"), "pending_conflict", "conf-", F.col("id").cast("string"), F.coalesce("value_a", "value_b", F.lit("")), F.concat(F.lit("pending conflict on "), "entity_id", F.lit("."), "property"), sides),
        rows(proposals.where("status = 'pending'"), "glossary_proposal", "gloss-", F.col("id").cast("string"), F.col("term"), F.lit("pending glossary proposal")),
    ]
    if brief is not None:
        parts.append(rows(brief, "brief_ambiguity", "brief-", F.concat_ws("-", "nth", slug(F.col("term"))), F.col("term"), F.lit("modifier ambiguity from the domain brief"), F.col("candidates")))
    return reduce(DataFrame.unionByName, parts)


def longest_alias(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Term, alias, entry_id: of the aliases that a term holds as whole words the longest one (then the first by name)."""
    known = aliases.select(F.trim(folded(F.col("alias"))).alias("alias"), "entry_id").where("alias <> ''")
    met = whole_words(terms.select("term", folded(F.col("term")).alias("_line")), ["_line"], "_line", known.select(F.col("alias").alias("term")).distinct())
    rows = terms.select("term", folded(F.col("term")).alias("_line")).join(met.select("_line", F.col("term").alias("alias")), "_line").join(known, "alias")
    best = Window.partitionBy("term").orderBy(F.length("alias").desc(), "alias", "entry_id")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("term", "alias", "entry_id")


def modifiers(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Terms that hold an alias and more words; a term that is an alias itself is none."""
    return longest_alias(terms, aliases).where(F.trim(folded(F.col("term"))) != F.col("alias"))


#: Beginnings of new entries' ids by namespace.
PREFIXES = {"tecnica": "TEC", "ingredienti": "ING", "stati": "STA"}


def proposals(found: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """A pending proposal for each issue: another alias of the entry its term extends, else a new entry.

    entries: entry_id, namespace; aliases: alias, entry_id. New ids that exist already take the next free number.
    """
    base = longest_alias(found.select("term").distinct(), aliases).join(entries, "entry_id").select("term", "entry_id", "namespace")
    met = found.join(base, "term", "left")
    namespace = F.coalesce("namespace", F.lit("ingredienti"))
    stem = F.concat(F.lit(PREFIXES["ingredienti"] + "-"), F.coalesce(F.nullif(F.upper(slug(F.col("term"))), F.lit("")), F.lit("TERM")))
    taken = entries.select(F.regexp_replace("entry_id", "-\\d+$", "").alias("_stem"), F.coalesce(F.regexp_extract("entry_id", "-(\\d+)$", 1).try_cast("int"), F.lit(1)).alias("_n")).groupBy("_stem").agg(F.max("_n").alias("_last"))
    new = met.withColumn("_stem", stem).join(taken, "_stem", "left")
    made = F.when(F.col("_last").isNull(), F.col("_stem")).otherwise(F.concat_ws("-", "_stem", F.col("_last") + 1))
    return new.select(
        F.concat(F.lit("prop-"), slug(F.col("issue_id"))).alias("proposal_id"), "issue_id",
        F.when(F.col("entry_id").isNull(), "add_entry").otherwise("add_alias").alias("kind"), "term",
        namespace.alias("namespace"), F.coalesce("entry_id", made).alias("entry_id"), F.lit("pending").alias("status"), "note",
    )


def applied(aliases: DataFrame, proposed: DataFrame) -> DataFrame:
    """The aliases (alias, entry_id) with those of approved proposals; others change nothing."""
    return aliases.union(proposed.where("status = 'approved'").select(F.col("term").alias("alias"), "entry_id")).distinct()
