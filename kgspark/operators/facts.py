"""Bitemporal facts as an append-only table of versions.

Updates and invalidations return the whole new table version: closed rows keep their id, new versions get the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """versions valid at a time; the interval is half-open."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def current(facts: DataFrame) -> DataFrame:
    """Open versions."""
    return facts.where(F.col("valid_to").isNull())


def latest_open(facts: DataFrame) -> DataFrame:
    """One open version for each logical id, the latest."""
    last = Window.partitionBy("logical_id").orderBy(F.desc("valid_from"), F.desc("id"))
    return current(facts).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def history(facts: DataFrame) -> DataFrame:
    """Version numbers and the neighbouring versions."""
    by = Window.partitionBy("logical_id").orderBy("valid_from", "id")
    return facts.select("*", F.row_number().over(by).alias("version_no"), F.lag("id").over(by).alias("prev_id"), F.lead("id").over(by).alias("next_id"))


def update(facts: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Close the open version of each changed logical id and append a new one.

    changes: logical_id, value. Rows whose value is the same change nothing (null-safe).
    """
    c = changes.dropDuplicates(["logical_id"]).select("logical_id", F.col("value").alias("_new"), F.lit(True).alias("_set"))
    marked = facts.join(c, "logical_id", "left").withColumn("_hit", F.col("_set") & F.col("valid_to").isNull() & ~F.col("value").eqNullSafe(F.col("_new")))
    marked = marked.withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    closed = F.when(F.col("_hit"), now).otherwise(F.col("valid_to")), F.when(F.col("_hit"), "obsolete").otherwise(F.col("status"))
    old = marked.withColumn("valid_to", closed[0]).withColumn("status", closed[1]).select(facts.columns)
    new = marked.where("_hit").withColumn("id", F.concat("id", F.lit("+"))).withColumn("value", F.col("_new")).withColumn("valid_from", now)
    return old.unionByName(new.withColumn("valid_to", F.lit(None).cast(facts.schema["valid_to"].dataType)).withColumn("status", F.lit("valid")).select(facts.columns))


def invalidate(facts: DataFrame, logical_ids: DataFrame, at: Column) -> DataFrame:
    """Close open versions of these logical ids without a successor."""
    hit = facts.join(logical_ids.select("logical_id", F.lit(True).alias("_hit")).distinct(), "logical_id", "left")
    close = F.coalesce("_hit", F.lit(False)) & F.col("valid_to").isNull()
    return hit.withColumn("status", F.when(close, "obsolete").otherwise(F.col("status"))).withColumn("valid_to", F.when(close, at).otherwise(F.col("valid_to"))).select(facts.columns)


def insert(facts: DataFrame, rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows to append: their entity exists and their logical id is new."""
    return rows.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(facts.select("logical_id"), "logical_id", "left_anti")


def reconcile(snapshot: DataFrame, now: DataFrame) -> DataFrame:
    """What restores a snapshot (logical_id, value): 'version', 'invalidate' or 'none' for each logical id."""
    s = snapshot.select("logical_id", F.col("value").alias("then"), F.lit(True).alias("_then"))
    n = current(now).select("logical_id", F.col("value").alias("current"), F.lit(True).alias("_now"))
    action = F.when(F.col("_then").isNull(), "invalidate").when(F.col("_now").isNull() | ~F.col("then").eqNullSafe(F.col("current")), "version").otherwise("none")
    return s.join(n, "logical_id", "full").select("logical_id", "then", "current", action.alias("action"))
