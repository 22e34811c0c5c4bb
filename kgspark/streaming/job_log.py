"""Ingestion jobs told from the progress of streams.

``JobLog`` is a ``StreamingQueryListener``: each start, each micro-batch with rows and each end of a stream becomes one row of
an event table in the shared folder, written when it happens, so what a lost driver did is still there. A stream's job is the
name it runs under; a stream that goes on from its checkpoint under the same name goes on with the same job. ``told`` folds
the events into the job table.

Ends: with an error ``failed``, after ``pause`` ``paused``, else ``completed``. A driver that is lost leaves ``running``, and
the next start of the job follows it. A batch that is done again after a failure is reported again; it counts once.
"""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EVENT = "job string, run string, seq long, event string, batch long, rows long, error string, at timestamp_ntz"


class JobLog(StreamingQueryListener):
    """Writes the events of named streams under ``path``; streams without a name are not jobs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._names: dict[str, str] = {}  # of runs that have not ended
        self._paused: set[str] = set()
        self._lock, self._ended = threading.Lock(), threading.Condition()
        self._done: set[str] = set()

    def _write(self, run, event: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        with self._lock:  # so that a job's events are told apart by their time
            seq = int(now.timestamp() * 1_000_000)
            row = (self._names[str(run)], str(run), seq, event, batch, rows, error, now)
            self.spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name:
            self._names[str(event.runId)] = event.name
            self._write(event.runId, "running")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.runId) in self._names and p.numInputRows > 0:
            self._write(p.runId, "progress", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        run = str(event.runId)
        if run in self._names:
            end = "failed" if event.exception else "paused" if run in self._paused else "completed"
            self._write(run, end, error=event.exception)
            del self._names[run]
            self._paused.discard(run)
        with self._ended:
            self._done.add(run)
            self._ended.notify_all()

    def __enter__(self) -> JobLog:
        """Listen to the session's streams."""
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def pause(self, stream: StreamingQuery) -> None:
        """Stop a stream; its job is paused, and goes on when a stream of that name starts from the same checkpoint."""
        self._paused.add(str(stream.runId))
        stream.stop()

    def settled(self, stream: StreamingQuery, seconds: float = 60) -> bool:
        """Wait until the end of a stream is written: events come a little after what they tell of."""
        with self._ended:
            return self._ended.wait_for(lambda: str(stream.runId) in self._done, seconds)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(f"{self.path}/events")


def told(events: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """id, status, n_batches, n_rows, error, started_at, finished_at of every job, from the events; with ``jobs`` (id, n_rows:
    rows there are in all) also progress, a whole percentage, 100 where the job is completed.

    The latest event but for progress gives the status; a job that runs again has no end and no error.
    """
    moves = F.col("event") != "progress"
    at = F.struct("seq", F.col("event").isin("completed", "failed", "paused"))  # at one time an end follows a start
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, at))
    batches = events.where(~moves).groupBy(F.col("job").alias("id"), "batch").agg(F.max("rows").alias("rows"))
    sums = batches.groupBy("id").agg(F.count("*").alias("n_batches"), F.sum("rows").alias("n_rows"))
    state = events.groupBy(F.col("job").alias("id")).agg(
        last("event", moves).alias("status"), last("error", moves).alias("error"), last("at", moves).alias("_at"),
        F.min(F.when(F.col("event") == "running", F.col("at"))).alias("started_at"),
    )
    ended: Column = F.col("status").isin("completed", "failed")
    rows = state.join(sums, "id", "left").withColumns({"n_batches": F.coalesce("n_batches", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0)), "finished_at": F.when(ended, F.col("_at"))})
    rows = rows.select("id", "status", "n_batches", "n_rows", "error", "started_at", "finished_at")
    if jobs is None:
        return rows
    share = F.when(F.col("status") == "completed", 100).when(F.col("total") > 0, F.least(F.floor(F.lit(100) * F.col("n_rows") / F.col("total")), F.lit(100)).cast("int")).otherwise(0)
    return rows.join(jobs.select("id", F.col("n_rows").alias("total")), "id", "left").withColumn("progress", share).drop("total")


def tracked(stream: DataFrame, log: JobLog, name: str, where: str, hook=None, trigger: dict | None = None) -> StreamingQuery:
    """Start a stream as a job of a log that listens: to Parquet under ``where``, or through ``hook`` (``foreachBatch``)."""
    out = stream.writeStream.queryName(name).option("checkpointLocation", f"{where}/checkpoint").trigger(**(trigger or {"availableNow": True}))
    return (out.foreachBatch(hook) if hook else out.format("parquet").option("path", f"{where}/rows")).start()

