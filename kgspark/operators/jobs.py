"""Ingestion jobs as a table: created, started, paused, completed or failed, as next table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("code", "document", "image")
STATUSES = ("pending", "running", "paused", "completed", "failed")


def created(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """The jobs with new pending rows (id, source_uri, type); unknown types are an error."""
    if not rows.where(~F.col("type").isin(*TYPES) | F.col("type").isNull()).isEmpty():
        raise ValueError(f"type must be one of {', '.join(TYPES)}")
    new = rows.join(jobs.select("id"), "id", "left_anti").withColumns({"status": F.lit("pending"), "progress": F.lit(0)})
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema if f.name not in new.columns]
    return jobs.unionByName(new.select("*", *missing).select(jobs.columns))


def moved(jobs: DataFrame, events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The jobs after events (id, status, error), and the events refused: unknown jobs or statuses.

    Running keeps the first start and clears the end, completed is 100 percent, and completed and failed set the end.
    """
    e = events.dropDuplicates(["id"]).select("id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    good = e.where(F.col("_status").isin(*STATUSES))
    met = jobs.join(good, "id", "left")
    to, on = F.col("_status"), F.col("_status").isNotNull()
    ended = to.isin("completed", "failed")
    after = met.withColumns(
        {
            "status": F.coalesce(to, "status"),
            "progress": F.when(to == "completed", 100).otherwise(F.col("progress")),
            "error": F.when(to == "failed", F.col("_error")).when(on, F.lit(None)).otherwise(F.col("error")),
            "started_at": F.when(to == "running", F.coalesce("started_at", now)).otherwise(F.col("started_at")),
            "finished_at": F.when(ended, now).when(to == "running", F.lit(None)).otherwise(F.col("finished_at")),
        }
    )
    refused = e.join(jobs.select("id"), "id", "left_anti").union(e.where(~F.col("_status").isin(*STATUSES) | F.col("_status").isNull())).distinct()
    return after.select(jobs.columns), refused.select("id", F.col("_status").alias("status"))


def progressed(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The jobs with their progress as a whole percentage of done (id, n_done, n_files)."""
    share = F.floor(F.lit(100) * F.col("n_done") / F.col("n_files")).cast("int")
    met = jobs.join(done.where("n_files > 0").select("id", share.alias("_share")), "id", "left")
    return met.withColumn("progress", F.coalesce("_share", "progress")).select(jobs.columns)
