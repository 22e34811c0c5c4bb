"""Conflicts found while facts stream in.

Each micro-batch of facts is written under its number, the entities it touches are scanned for conflicts that are not
reported yet, and these are written under the same number; a ledger row, written last, says that the batch is done. A batch
that comes again (a restart between writing and the checkpoint) is skipped if the ledger has it, and writes its own two
partitions anew if not, reading only the batches before it; so nothing is reported twice.

Facts are dealt into PARTS by their entity, and a batch reads those parts only that its entities lie in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators import review

PARTS = 32


class ConflictHook:
    """The function that ``foreachBatch`` calls; tables lie under ``where``, in the shared folder."""

    def __init__(self, sources: DataFrame, where: str, parts: int = PARTS):
        self.sources, self.where, self.parts = sources, where, parts

    def _part(self):
        return F.pmod(F.xxhash64("entity_id"), F.lit(self.parts)).cast("int")

    def _read(self, spark: SparkSession, name: str, like: DataFrame) -> DataFrame:
        """Rows of ``name`` with the number of their batch, of no batch at first."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
        if self._done(spark) is None:
            return spark.createDataFrame([], fields)
        return spark.read.schema(fields).parquet(f"{self.where}/{name}")

    def _done(self, spark: SparkSession) -> set[int] | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/ledger")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return {r.batch for r in spark.read.parquet(f"{self.where}/ledger").select("batch").distinct().collect()}  # one row for each batch

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in (self._done(spark) or ()):
            return
        own = batch.withColumns({"part": self._part(), "batch": F.lit(number).cast("long")})
        self._write(own.repartition("part"), "facts", number)
        own = spark.read.schema(own.drop("batch").schema).parquet(f"{self.where}/facts/batch={number}")
        parts = [r.part for r in own.select("part").distinct().collect()]  # PARTS at most
        before = self._read(spark, "facts", own.withColumn("batch", F.lit(0).cast("long"))).where((F.col("batch") < number) & F.col("part").isin(parts))
        facts = before.drop("batch", "part").unionByName(own.drop("part"))
        shape = review.detected(facts.limit(0), self.sources, _queue(facts)).withColumns({"status": F.lit("pending"), "batch": F.lit(0).cast("long")})
        known = self._read(spark, "conflicts", shape).where(F.col("batch") < number)
        found = review.detected(facts, self.sources, known, own).withColumns({"status": F.lit("pending"), "batch": F.lit(number).cast("long")})
        self._write(found, "conflicts", number)
        n = spark.read.schema(shape.drop("batch").schema).parquet(f"{self.where}/conflicts/batch={number}").count()
        spark.createDataFrame([(number, own.count(), n)], "batch long, facts long, conflicts long").coalesce(1).write.mode("append").parquet(f"{self.where}/ledger")

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        """The one partition of this batch, whatever was there."""
        out = rows.drop("batch").write.mode("overwrite")
        (out.partitionBy("part") if "part" in rows.columns else out).parquet(f"{self.where}/{name}/batch={number}")

    def conflicts(self, spark: SparkSession) -> DataFrame:
        """All conflicts reported by batches that are done."""
        done = spark.read.parquet(f"{self.where}/ledger").select("batch").distinct()
        return spark.read.option("mergeSchema", "true").parquet(f"{self.where}/conflicts").join(F.broadcast(done), "batch", "left_semi")


def _queue(facts: DataFrame) -> DataFrame:
    """An empty table of known conflicts of such facts."""
    sides = [F.col(c).alias(f"{c}_{s}") for s in "ab" for c in ("value", "source_id")]
    return facts.select("entity_id", "property", *sides, F.lit("pending").alias("status")).limit(0)


def detect(stream: DataFrame, sources: DataFrame, where: str, hook: Callable | None = None) -> ConflictHook:
    """Run a stream of facts over all there is, with the hook on each micro-batch; the same ``where`` goes on."""
    hook = hook or ConflictHook(sources, where)
    run = stream.writeStream.foreachBatch(hook).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return hook
