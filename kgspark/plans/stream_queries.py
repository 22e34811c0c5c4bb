"""Streams run to their end, held against the batch form of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources import graph as g
from kgspark.sources.shared import shared_dir
from kgspark.streaming import ingest, job_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {g.FACT} SELECT logical_id, value, valid_from, valid_to FROM fact WHERE valid_to IS NOT NULL")
def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    """Closed versions of facts as their events arrive."""
    e = ingest.read_stream(spark, f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    value = F.floor(F.col("value") * 100).cast("long").cast("string")
    rows = e.select(F.concat_ws(":", "user_id", "event_type", k).alias("logical_id"), value.alias("value"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"))
    return ingest.drained(ingest.versions(rows))


@query("SELECT DISTINCT source || '' AS source, sha256(text) AS digest FROM documents")
def stream_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each content of a source once; what is more than a week (here: of seconds that ids count) behind is forgotten."""
    rows = ingest.read_stream(spark, f"{d}/documents.parquet").select("source", F.sha2("text", 256).alias("digest"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"))
    return ingest.drained(ingest.changed(rows, "source", "digest", "ts")).drop("ts")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 86400 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, n, t, 3000000 >= 1000000 AS allowed, 3000000 - 1000000 AS tokens FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, e.t, least(3000000, b.tokens + e.t - b.t) >= 1000000, least(3000000, b.tokens + e.t - b.t) - CASE WHEN least(3000000, b.tokens + e.t - b.t) >= 1000000 THEN 1000000 ELSE 0 END
 FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT event_id AS seq, allowed FROM b"""
)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Three requests at once and one more for each second, over the events of a user; a day runs in a second."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fast = F.timestamp_micros(F.floor(us / 86400))
    # Events less than a fast microsecond apart keep their order.
    e = ingest.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), fast.alias("ts"), us.alias("nth"), F.col("event_id").alias("seq"))
    return ingest.drained(ingest.token_bucket(e, 1.0, 3.0))


@query("SELECT id, 'completed' AS status, n_rows, CAST(100 AS INT) AS progress FROM (SELECT 'events' AS id, count(*) AS n_rows FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations)")
def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Two streams run as jobs, and what their progress tells of them."""
    where = f"{shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    with job_log.JobLog(spark, where) as log:
        runs = [job_log.tracked(ingest.read_stream(spark, f"{d}/{name}.parquet").select(key), log, name, f"{where}/{name}") for name, key in (("events", "event_id"), ("conversations", "conv_id"))]
        for run in runs:
            run.awaitTermination()
            log.settled(run)
    totals = [g.table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("id"), "n_rows") for name in ("events", "conversations")]
    return job_log.told(log.events(), totals[0].union(totals[1])).select("id", "status", "n_rows", "progress")
