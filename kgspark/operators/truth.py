"""Invalidating a source and marking what was inferred from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.sources.shared import stored

MAX_DEPTH = 10


def derived_from(facts: DataFrame, source_id: int) -> DataFrame:
    """Open facts of a source."""
    return facts.where((F.col("source_id") == source_id) & F.col("valid_to").isNull())


def propagate(roots: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """logical_id, depth of everything reached over edges (child, parent) in at most ``depth`` steps, roots left out.

    One join and one written table for each level, at most MAX_DEPTH; nothing is collected. The smallest depth counts, so cycles end.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    seen = roots.select("logical_id").distinct().withColumn("depth", F.lit(0))
    level = seen
    for d in range(1, depth + 1):
        step = level.join(edges.withColumnRenamed("parent", "logical_id"), "logical_id").select(F.col("child").alias("logical_id")).distinct()
        level = stored(step.join(seen, "logical_id", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.union(level)
    return seen.where("depth > 0")
