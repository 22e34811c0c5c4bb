"""Conflicting facts of different sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank(confidence: Column) -> Column:
    """M11."""
    return F.when(confidence == "EXTRACTED", 3).when(confidence == "INFERRED", 2).when(confidence == "AMBIGUOUS", 1).otherwise(0)


def candidates(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Open facts with their source's recency, the first of each (entity, property, value, source)."""
    s = sources.select(F.col("id").alias("source_id"), "ingested_at")
    rows = facts.where("valid_to IS NULL AND status = 'valid' AND source_id IS NOT NULL").join(s, "source_id", "left")
    first = Window.partitionBy("entity_id", "property", "value", "source_id").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one entity and property whose values and sources differ, ordered by (source, value).

    The suggested side has the higher confidence, else the more recent source (an unknown time counts as the epoch), else
    it is b; ``reason`` says which.
    """
    keys = ["entity_id", "property"]
    side = ["value", "source_id", "confidence", "ingested_at"]
    a = rows.select(*keys, *[F.col(c).alias(f"{c}_a") for c in side])
    b = rows.select(*keys, *[F.col(c).alias(f"{c}_b") for c in side])
    ordered = (F.col("source_id_a") < F.col("source_id_b")) & (F.col("value_a") != F.col("value_b"))
    ra, rb = rank(F.col("confidence_a")), rank(F.col("confidence_b"))
    ta, tb = recency(rows, "ingested_at_a"), recency(rows, "ingested_at_b")
    winner = F.when(ra > rb, "a").when(rb > ra, "b").when(ta > tb, "a").otherwise("b")

    def higher(x: str, y: str) -> Column:
        names = [F.coalesce(f"confidence_{s}", F.lit("None")) for s in (x, y)]
        return F.concat(F.lit("higher confidence ("), names[0], F.lit(" > "), names[1], F.lit(")"))

    reason = F.when(ra > rb, higher("a", "b")).when(rb > ra, higher("b", "a")).when(ta != tb, "more recent source").otherwise("sources equally recent (tie-break b)")
    return a.join(b, keys).where(ordered).withColumns({"suggestion": winner, "reason": reason})


def classes(rows: DataFrame) -> DataFrame:
    """J10, G01 without pairs: each candidate that has a rival (another value of another source for its entity and property),
    with its best rival (value, source_id) and whether that one wins: entity_id, property, value, source_id, rival_value,
    rival_source_id, loses.

    Sides are in one order (confidence, recency, source), so of a group the best side decides, or, for those that share its
    value or its source, the best of the rest. Three aggregations find these few sides; rows stay as many as candidates.
    ``pairs`` lists all pairs where they are wanted.
    """
    keys = ["entity_id", "property"]
    side = F.struct(rank(F.col("confidence")).alias("r"), recency(rows, "ingested_at").alias("t"), F.col("source_id").alias("s"), F.col("value").alias("v"))
    held = rows.select(*keys, side.alias("own"))

    def best(name: str, *others: str) -> Column:
        """The best side whose value (v.x) and source (s.x) are not those of x."""
        ok = F.lit(True)
        for o in others:
            field, of = o.split(".")
            ok = ok & (F.col(f"own.{field}") != F.col(f"{of}.{field}"))
        return F.max(F.when(ok, F.col("own"))).alias(name)

    top = held.groupBy(*keys).agg(best("b1"))
    more = held.join(top, keys).groupBy(*keys, "b1").agg(best("b2", "s.b1"), best("b3", "v.b1"), best("b4", "s.b1", "v.b1"))
    rest = held.join(more, keys).groupBy(*keys, "b1", "b2", "b3", "b4").agg(best("b5", "v.b1", "s.b3"), best("b6", "s.b1", "v.b2"))
    same_v, same_s = F.col("own.v") == F.col("b1.v"), F.col("own.s") == F.col("b1.s")
    of_others = F.when(F.col("b3.s") != F.col("own.s"), F.col("b3")).otherwise(F.col("b5"))
    of_sources = F.when(F.col("b2.v") != F.col("own.v"), F.col("b2")).otherwise(F.col("b6"))
    rival = F.when(same_v & same_s, F.col("b4")).when(same_v, of_others).when(same_s, of_sources).otherwise(F.col("b1"))
    met = held.join(rest, keys).withColumn("rival", rival).where("rival IS NOT NULL")
    order = lambda c: F.struct(f"{c}.r", f"{c}.t", f"{c}.s")
    return met.select(*keys, F.col("own.v").alias("value"), F.col("own.s").alias("source_id"), F.col("rival.v").alias("rival_value"), F.col("rival.s").alias("rival_source_id"), (order("own") < order("rival")).alias("loses"))


def recency(rows: DataFrame, column: str) -> Column:
    """A source's time; the epoch where there is none."""
    epoch = F.lit("1970-01-01 00:00:00").cast(rows.schema["ingested_at"].dataType)
    return F.coalesce(F.col(column), epoch)


def unreported(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs without a pending conflict on the same values of the same sources, in either order."""
    sides = F.struct("source_id_a", "value_a"), F.struct("source_id_b", "value_b")
    names = [f"_{c}" for c in ("source_1", "value_1", "source_2", "value_2")]

    def keyed(df: DataFrame) -> DataFrame:
        swap = sides[0] > sides[1]
        ends = [F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("source_id_a", "source_id_b"), ("value_a", "value_b"), ("source_id_b", "source_id_a"), ("value_b", "value_a"))]
        return df.withColumns(dict(zip(names, ends, strict=True)))

    k = keyed(known.where("status = 'pending'")).select("entity_id", "property", *names)
    return keyed(found).join(k, ["entity_id", "property", *names], "left_anti").drop(*names)


def losers(approved: DataFrame) -> DataFrame:
    """The losing side of approved conflicts: entity_id, property, value, source_id."""
    lost = F.when(F.col("suggestion") == "a", F.struct(F.col("value_b").alias("value"), F.col("source_id_b").alias("source_id"))).otherwise(F.struct(F.col("value_a").alias("value"), F.col("source_id_a").alias("source_id")))
    return approved.select("entity_id", "property", lost.alias("x")).select("entity_id", "property", "x.value", "x.source_id").distinct()
