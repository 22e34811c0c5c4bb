"""A draft pack from the candidates of a corpus brief: glossary entries with ids of their own, and unit rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.functions.text import slug

#: The unit rules of a draft: from, to, factor, places, note.
UNITS = [
    ("g", "g", 1.0, None, None),
    ("kg", "kg", 1.0, None, None),
    ("ml", "ml", 1.0, None, None),
    ("l", "l", 1.0, None, None),
    ("dl", "ml", 100.0, 0, "1 dl = 100 ml"),
    ("°C", "°C", 1.0, None, None),
    ("min", "min", 1.0, None, None),
    ("h", "h", 1.0, None, None),
    ("cucchiaio", "tablespoon", 1.0, None, "1 tablespoon = 15 ml"),
    ("tazza", "cup", 1.0, None, "1 cup = 250 ml"),
    ("pizzico", "pinch", 1.0, None, None),
    ("spicchio", "clove", 1.0, None, None),
    ("foglia", "leaf", 1.0, None, None),
    ("rametto", "sprig", 1.0, None, None),
    ("bustina", "sachet", 1.0, None, None),
    ("mazzetto", "bunch", 1.0, None, None),
    ("fette", "slice", 1.0, None, None),
    ("fili", "thread", 1.0, None, None),
]
#: The prefix of the ids of each vocabulary.
PREFIXES = {"tecnica": "TEC", "ingredienti": "ING", "stati": "STA"}


def plain_id(prefix: Column, term: Column) -> Column:
    """PREFIX-SLUG in capitals; TERM where no letter or digit is left."""
    base = slug(F.replace(F.trim(term), F.lit("’"), F.lit("'")))
    return F.concat_ws("-", prefix, F.upper(F.coalesce(F.nullif(base, F.lit("")), F.lit("term"))))


def allocated(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` (plain, nth and others) with ``id``: an id for each that neither ``existing`` (id) nor another row has.

    The first row of a plain id (by nth) gets it, unless it exists; the others get the first numbers from 2 on, in their
    order, that are free: ``PLAIN-n`` is neither an existing id nor the plain id of other rows. Ids that end in a number are
    thus never taken from the terms they stand for. Rows are numbered in their group and free numbers are ranked in it, and
    the two meet by rank; no group is collected.
    """
    held = existing.select("id").distinct()
    plain = rows.select("plain").distinct()
    taken = held.union(plain.select(F.col("plain").alias("id"))).distinct()
    numbers = taken.select(F.regexp_extract("id", "^(.*)-(\\d+)$", 1).alias("plain"), F.regexp_extract("id", "^(.*)-(\\d+)$", 2).alias("text")).where("text <> '' AND text NOT LIKE '0%'")
    numbers = numbers.select("plain", F.col("text").try_cast("long").alias("n")).where("n >= 2").join(plain, "plain", "left_semi")
    by = Window.partitionBy("plain").orderBy("nth")
    known = held.select(F.col("id").alias("plain"), F.lit(1).alias("_known"))
    ranked = rows.join(known, "plain", "left").withColumn("_rank", F.row_number().over(by) - F.when(F.col("_known").isNull(), 1).otherwise(0))
    need = ranked.groupBy("plain").agg(F.max("_rank").alias("need")).where("need > 0")
    full = need.join(numbers.groupBy("plain").agg(F.count("*").alias("n_taken")), "plain", "left")
    tried = full.select("plain", F.explode(F.sequence(F.lit(2).cast("long"), 1 + F.col("need") + F.coalesce("n_taken", F.lit(0)))).alias("n"))
    free = tried.join(numbers, ["plain", "n"], "left_anti").withColumn("_rank", F.row_number().over(Window.partitionBy("plain").orderBy("n")))
    met = ranked.join(free, ["plain", "_rank"], "left")
    return met.withColumn("id", F.when(F.col("_rank") == 0, F.col("plain")).otherwise(F.concat_ws("-", "plain", F.col("n").cast("string")))).select("id", *rows.columns)


def draft(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Vocabulary, id, labels_en, labels_it, aliases, ontology_uri of each candidate.

    candidates: vocabulary (of PREFIXES), nth, term, source_terms array<string>, ontology_uri. The first source term that is
    not blank is the label in the source's language (the term itself where there is none), the others are aliases.
    """
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("vocabulary"))
    rows = allocated(candidates.withColumn("plain", plain_id(prefix, F.col("term"))), existing)
    said = F.coalesce(F.filter("source_terms", lambda t: F.length(F.trim(t)) > 0), F.array().cast("array<string>"))
    return rows.select("vocabulary", "id", F.col("term").alias("labels_en"), F.coalesce(F.get(said, F.lit(0)), F.col("term")).alias("labels_it"), F.slice(said, 2, F.greatest(F.size(said), F.lit(1))).alias("aliases"), "ontology_uri")


def units(spark: SparkSession) -> DataFrame:
    """rule_id, from_unit, to_unit, factor, rounding, note of the unit rules of a draft."""
    rows = spark.createDataFrame(UNITS, "from_unit string, to_unit string, factor double, rounding int, note string")
    return rows.select(F.concat(F.lit("UNIT-"), F.upper(slug(F.col("from_unit")))).alias("rule_id"), "*")
