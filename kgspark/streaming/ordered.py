"""Rows of a stream taken in the order of their time, with memory that does not grow with a key's rows.

Rows wait as groups of an aggregation by event time (state store: RocksDB), which gives them out in the micro-batch whose
watermark has passed them. A step then sorts these with what the batches before it have left of each key, which is a table
in the shared folder: ``foreachBatch`` writes what the step gives under the batch's number, and what it leaves to one of two
folders by turns, so that a batch that comes again reads what it read before and overwrites its own. Sorts spill to disk,
and no rows are gathered by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def waiting(rows: DataFrame, key: str, late: str) -> DataFrame:
    """Rows (key, ts, seq, value) of a stream as (key, us, seq, value), each once the watermark is past its millisecond.

    Rows without a time have no place in the order and are left out.
    """
    timed = rows.where("ts IS NOT NULL").withColumns({"us": F.unix_micros("ts"), "ms": F.date_trunc("millisecond", "ts")}).withWatermark("ms", late)
    equal = timed.groupBy(key, "ms", "us", "seq", "value").agg(F.count("*").alias("n"))
    return equal.select(key, "us", "seq", "value", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_")).drop("_")


class Versions:
    """Each row closes the version before it; the open one, a key's last row, is left."""

    out = T.StructType().add("logical_id", "string").add("value", "string").add("valid_from", "timestamp_ntz").add("valid_to", "timestamp_ntz")
    kept = T.StructType().add("logical_id", "string").add("us", "long").add("seq", "long").add("value", "string")

    def taken(self, rows: DataFrame, left: DataFrame | None) -> DataFrame:
        rows = rows if left is None else rows.unionByName(left)
        return rows.withColumn("stop", F.lead("us").over(Window.partitionBy("logical_id").orderBy("us", "seq", "value")))

    def given(self, taken: DataFrame) -> DataFrame:
        at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
        return taken.where("stop IS NOT NULL").select("logical_id", "value", at("us").alias("valid_from"), at("stop").alias("valid_to"))

    def left(self, taken: DataFrame) -> DataFrame:
        return taken.where("stop IS NULL").drop("stop")


class Bucket:
    """Each row takes a token if there is one; a bucket that is full again is as good as none.

    Levels are whole numbers: a token is as many parts as a microsecond's share of it needs, so no rounding adds up. The
    value of a row, if any, is its place among rows of one time. Sorted rows pass through a loop; one bucket is in memory.
    """

    out = T.StructType().add("seq", "long").add("allowed", "boolean")

    def __init__(self, rate: float, most: float, key: T.DataType):
        per = Fraction(str(rate)) / 1_000_000  # tokens a microsecond
        full = Fraction(str(most))
        self.token = math.lcm(per.denominator, full.denominator)
        self.gain, self.most = int(per * self.token), int(full * self.token)
        if self.most >= 1 << 63:
            raise ValueError("rate and size have too many decimals")
        self.kept = T.StructType().add("key", key).add("us", "long").add("tokens", "long")

    def taken(self, rows: DataFrame, left: DataFrame | None) -> DataFrame:
        """key, us, seq, allowed of each row, and the bucket's tokens in the last one of a key."""
        if left is not None:
            rows = rows.unionByName(left, allowMissingColumns=True)
        else:
            rows = rows.withColumn("tokens", F.lit(None).cast("long"))
        order = ["key", F.col("tokens").isNull(), "us", F.coalesce("value", F.lit(0)), "seq"]
        schema = T.StructType([*self.kept.fields[:2], *self.out.fields, self.kept["tokens"]])
        return rows.repartition("key").sortWithinPartitions(*order).select("key", "us", "seq", "tokens").mapInArrow(self._loop, schema)

    def _loop(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None  # the one before: key, us, seq, allowed, tokens
        for batch in batches:
            schema = pa.schema([batch.schema.field("key"), ("us", pa.int64()), ("seq", pa.int64()), ("allowed", pa.bool_()), ("tokens", pa.int64())])
            done = []
            for key, us, seq, level in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                tokens = self.most
                if row is not None:
                    if row[0] == key:
                        tokens = min(self.most, row[4] + max(0, us - row[1]) * self.gain)
                        row = (*row[:4], None)
                    done.append(row)
                if level is None:
                    allowed = tokens >= self.token
                    row = (key, us, seq, allowed, tokens - allowed * self.token)
                else:
                    row = (key, us, None, None, level)
            yield _batch(done, schema)
        if row is not None:
            yield _batch([row], schema)

    def given(self, taken: DataFrame) -> DataFrame:
        return taken.where("allowed IS NOT NULL").select("seq", "allowed")

    def left(self, taken: DataFrame) -> DataFrame:
        """Buckets that are not full at the newest row."""
        last = taken.where("tokens IS NOT NULL").select("key", "us", "tokens")
        newest = taken.agg(F.max("us")).first()[0]
        if newest is None or not self.gain:
            return last
        return last.where(F.lit(newest) - F.col("us") <= F.expr(f"({self.most}L - tokens) div {self.gain}L"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class InOrder:
    """A stream of ``waiting`` and the step that takes its rows; ``ingest.drained`` runs it."""

    stream: DataFrame
    step: Versions | Bucket

    @property
    def schema(self) -> T.StructType:
        return self.step.out

    @property
    def sparkSession(self):  # noqa: N802
        return self.stream.sparkSession

    def writer(self, where: str):
        """The function for ``foreachBatch``: ``where``/rows/batch=n and, by turns, ``where``/left/0 and 1."""

        def write(batch: DataFrame, number: int) -> None:
            left = batch.sparkSession.read.schema(self.step.kept).parquet(f"{where}/left/{(number - 1) % 2}") if number else None
            taken = self.step.taken(batch, left).persist(StorageLevel.DISK_ONLY)
            try:
                self.step.given(taken).write.mode("overwrite").parquet(f"{where}/rows/batch={number}")
                self.step.left(taken).write.mode("overwrite").parquet(f"{where}/left/{number % 2}")
            finally:
                taken.unpersist()

        return write
