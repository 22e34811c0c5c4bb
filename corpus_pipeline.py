"""A training corpus in five stages, each written as a table before the next one reads it.

Quality rules drop failed lines and rejected documents; line dedup drops repeated runs, and documents of which nothing is
left; of each group of near duplicates the document with the smallest doc_id stays; secrets are blanked out; and what is
left is packed into sequences. All stages but the last return the columns of ``documents``.

Defined results: a null text counts as empty and goes with the quality rules; a null doc_id never replaces another
document of its group; repeated rows are near duplicates of each other, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import restored, squeezed, stored, table, where_column, words
from kgspark.llm.jaccard_join import jaccard_classes
from kgspark.llm.line_dedup import line_dedup
from kgspark.llm.packing import pack
from kgspark.llm.quality_rules import quality_rules
from kgspark.llm.secret_scan import redacted, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail them."""
    return _documents(where_column(quality_rules(docs, "lang", "source"), "kept").withColumnRenamed("clean_text", "text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier document has; those of which no word is left go."""
    return _documents(line_dedup(docs, "lang", "source").where(F.size(words(F.col("text"))) > 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word Jaccard 0.8: the one with the smallest doc_id."""
    found = stored(jaccard_classes(docs).where("comp is not null").select("doc_id", "k", "comp"), "groups")
    least = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")).alias("x"))
    firsts = least.select(F.col("x.k").alias("first_k"), F.col("x.doc_id").alias("first_id"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).select(COLUMNS)
    keyed = squeezed(rows.withColumn("k", F.unhex(F.md5("text"))))
    # By text and doc_id, so that the copies of a text do not meet in one task.
    first = keyed.join(firsts, (F.col("k") == F.col("first_k")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    once = Window.partitionBy("k", "doc_id").orderBy("lang", "source", "n_chars")
    first = restored(first.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select(COLUMNS))
    return first.union(rows.where(F.size(words(F.col("text"))) == 0))  # texts without words are in no group


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked out."""
    return _documents(secret_scan(docs, "lang", "source").withColumn("text", redacted(F.col("text"), F.col("findings"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies among the sequences."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: Winnowing, forests and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
