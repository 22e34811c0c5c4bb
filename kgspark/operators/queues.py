"""Review queues and the audit of their decisions, as next table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "approved", "rejected")


def listed(queue: DataFrame, status: str | None = None) -> DataFrame:
    """rows of a status in the order of their ids; an unknown status is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return (queue if status is None else queue.where(F.col("status") == status)).orderBy("id")


def created(queue: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The queue with new pending rows; those whose id is known are left out."""
    new = rows.join(queue.select("id"), "id", "left_anti")
    new = new.withColumns({"status": F.lit("pending"), "resolved_by": F.lit(None).cast("string"), "resolved_at": F.lit(None).cast("timestamp_ntz"), "created_at": now})
    return queue.unionByName(new.select(queue.columns))


def decided(queue: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next queue, its audit rows, and the decisions refused (unknown, not pending or no valid status).

    decisions: id, status, resolved_by.
    """
    d = decisions.dropDuplicates(["id"]).select("id", F.col("status").alias("_status"), F.col("resolved_by").alias("_by"))
    valid = F.col("_status").isin("approved", "rejected")
    met = queue.join(d, "id", "left").withColumn("_go", F.coalesce(valid & (F.col("status") == "pending"), F.lit(False)))
    audit = met.where("_go").select(
        F.col("_by").alias("user_id"), F.lit("decide").alias("action"), F.col("id").cast("string").alias("entity_id"),
        F.to_json(F.struct("status")).alias("old_value"), F.to_json(F.struct(F.col("_status").alias("status"))).alias("new_value"), now.alias("ts"),
    )
    refused = d.join(met.where("_go").select("id"), "id", "left_anti").select("id", F.col("_status").alias("status"), F.col("_by").alias("resolved_by"))
    go = F.col("_go")
    after = met.withColumns({"status": F.when(go, F.col("_status")).otherwise(F.col("status")), "resolved_by": F.when(go, F.col("_by")).otherwise(F.col("resolved_by")), "resolved_at": F.when(go, now).otherwise(F.col("resolved_at"))})
    return after.select(queue.columns), audit, refused
