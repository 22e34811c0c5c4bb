"""Streams over files, run to their end and checkpointed in the shared folder.

State is kept in the state store (RocksDB), rows are taken in the order of their event time, and no key's rows are gathered
in memory. A restart from the same checkpoint goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.sources.shared import shared_dir
from kgspark.streaming import ordered


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A table's files as a stream, some at a time.

    The path goes as a pattern that matches itself, since a table may be a single file.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame | ordered.InOrder, mode: str = "append", where: str | None = None) -> DataFrame:
    """Run a stream over all there is and read what it wrote. The same ``where`` goes on with new files only."""
    spark = stream.sparkSession
    where = where or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.ROCKS)
    if isinstance(stream, ordered.InOrder):
        if mode != "append":
            raise ValueError("rows in the order of time are appended")
        out = stream.stream.writeStream.foreachBatch(stream.writer(where))
    else:
        out = stream.writeStream.format("parquet").option("path", f"{where}/rows")
    run = out.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows").select(stream.schema.names)


def changed(stream: DataFrame, key: str, digest: str, ts: str | None = None, late: str = "7 days") -> DataFrame:
    """The first row of each key and content digest.

    With an event time ``ts`` what was seen is forgotten ``late`` after it, so state does not grow for ever.
    """
    if ts is None:
        return stream.dropDuplicates([key, digest])
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, digest])


def versions(stream: DataFrame, late: str = "0 seconds") -> ordered.InOrder:
    """logical_id, value, valid_from, valid_to of every version that a later row of its logical id closes.

    stream: logical_id, value, ts, seq. Rows wait as state until the watermark (``late`` behind the newest row) has passed
    their millisecond and are then taken in the order of (ts, seq); those that come later than that, and those without a
    ts, are left out.
    """
    rows = stream.select(F.col("logical_id").cast("string").alias("logical_id"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return ordered.InOrder(ordered.waiting(rows, "logical_id", late), ordered.Versions())


def token_bucket(stream: DataFrame, rate: float, most: float | None = None, late: str = "0 seconds") -> ordered.InOrder:
    """Seq, allowed: each key's bucket holds ``most`` (2 * rate) tokens, fills by ``rate`` a second, and a row takes one.

    stream: key, ts, seq, in order as ``versions`` has it, and maybe nth (long): the order of rows of one ts, before seq.
    Levels are exact. A full bucket is forgotten. A bucket that can hold no whole token
    would let nothing pass, so that is an error.
    """
    most = 2 * rate if most is None else most
    if most < 1:
        raise ValueError("a bucket has to hold a token")
    nth = F.col("nth") if "nth" in stream.columns else F.lit(None)
    rows = stream.select("key", nth.cast("long").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return ordered.InOrder(ordered.waiting(rows, "key", late), ordered.Bucket(rate, most, rows.schema["key"].dataType))


def window_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n by tumbling windows; rows later than ``late`` behind the newest are left out."""
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
