"""Relations between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse(relations: DataFrame, generic: str) -> DataFrame:
    """One relation for each pair: specific beats generic, then the last by name."""
    best = F.max_by("relation", F.struct((F.col("relation") != generic).alias("specific"), "relation"))
    return relations.groupBy("source_id", "target_id").agg(best.alias("relation"), F.count("*").alias("n_parallel"))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch replaces rows of its keys; the last row of a key in the batch wins by all its columns."""
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.select(columns).withColumn("_new", F.lit(1)))
    rest = [F.desc(c) for c in columns if c not in keys]
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), *rest)
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(columns)
