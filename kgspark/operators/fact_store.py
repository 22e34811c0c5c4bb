"""Versioned writes that rewrite the touched partitions of a fact table only.

Facts lie in PARTS partitions by the hash of their logical id. A write asks the partitions of its own logical ids for what
they hold, in short rows, and stages what is to be done. Partitions with a difference are then read and overwritten in one
job: Spark writes the next versions beside them and puts these in their place when the job is done; the others keep their
files. So facts as a whole are shuffled and written once for each write. Each change leaves an audit row (a Version) in a
table of its own. Ids of versions follow from what they are made of, so a write that is repeated after a failure gives the
same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.sources.shared import stored

PARTS = 64
#: What a change can set; a column that is absent or null keeps its value.
SETTABLE = ("value", "property", "confidence", "status", "source_id", "entity_id")


def _name(kind: str, *parts: Column) -> Column:
    return F.concat(F.col("logical_id"), F.lit(kind), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


@dataclass
class FactStore:
    """A fact table under ``path``, in the shared folder."""

    spark: SparkSession
    path: str
    parts: int = PARTS

    @classmethod
    def created(cls, facts: DataFrame, path: str, parts: int = PARTS) -> FactStore:
        store = cls(facts.sparkSession, path, parts)
        store._write(facts, "overwrite")
        return store

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("logical_id"), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Nothing is shuffled for it: a task writes a file for each partition that it has rows of, in which neighbours are alike.
        dealt = rows.withColumn("part", self._part()).sortWithinPartitions("part", "logical_id").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        dealt.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/facts")

    def read(self, parts: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/facts")
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def versions(self) -> DataFrame:
        """The audit rows of all writes."""
        return self.spark.read.parquet(f"{self.path}/versions")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r.part for r in rows.select(self._part().alias("part")).distinct().collect()]  # ``parts`` at most

    def beside(self, rows: DataFrame) -> DataFrame:
        """The partitions that the logical ids of ``rows`` lie in."""
        return self.read(self._touched(rows))

    def met(self, asks: DataFrame, columns: list[str]) -> DataFrame:
        """``asks`` (logical_id and others) with ``held``, struct(open, valid_from, id and ``columns``): the latest
        open version of their logical id, else its last closed one, null where it is unknown."""
        row = {"_open": F.col("valid_to").isNull(), "_valid_from": F.col("valid_from"), "_id": F.col("id")} | {f"_{c}": F.col(c) for c in columns}
        facts = self.beside(asks).select("logical_id", *[c.alias(name) for name, c in row.items()])
        both = facts.unionByName(asks, allowMissingColumns=True).repartition("logical_id")
        last = F.max(F.when(F.col("_open").isNotNull(), F.struct(*[F.col(name).alias(name[1:]) for name in row]))).over(Window.partitionBy("logical_id"))
        return both.withColumn("held", F.when(F.col("logical_id").isNotNull(), last)).where("_open IS NULL").drop(*row)

    def carry_out(self, met: DataFrame, now: Column, reopen: bool = False) -> DataFrame:
        """Write what rows of ``met`` ask for; these with ``kind`` (update, create, invalidate, refused) and ``reason``, those
        that change nothing left out.

        met: also ``to`` (struct of some of SETTABLE), ``author`` and ``closes``, which asks to close instead of to set. Where
        a logical id is set and closed at once, what was set is closed.
        """
        sets = met.schema["to"].dataType.names
        own, closes, open_ = Window.partitionBy("logical_id"), F.col("closes"), F.coalesce("held.open", F.lit(False))
        can = F.col("to.entity_id").isNotNull() & F.col("to.property").isNotNull() if {"entity_id", "property"} <= {*sets} else F.lit(False)
        differs = F.lit(False)
        for c in {*sets} & {*met.schema["held"].dataType.names}:
            differs = differs | ~F.coalesce(F.col(f"to.{c}"), F.col(f"held.{c}")).eqNullSafe(F.col(f"held.{c}"))
        reason = F.when(closes & ~open_, "NO_OPEN_VERSION").when(~closes & (F.col("_times") > 1), "NAMED_TWICE")
        reason = reason.when(F.col("held").isNotNull() & ~open_ & ~F.lit(reopen), "NO_OPEN_VERSION").when(~open_ & ~can, "NOT_FOUND")
        kind = F.when(F.col("reason").isNotNull(), "refused").when(closes, "invalidate").when(~open_, "create").when(differs, "update")
        told = met.withColumn("_times", F.count_if(~closes).over(own)).withColumn("reason", reason).withColumn("kind", kind).where("kind IS NOT NULL")
        both = told.withColumns({"_updates": F.max(F.col("kind") == "update").over(own), "_shut": F.max(F.col("kind") == "invalidate").over(own)})
        made = F.when(F.col("kind") == "update", _name("__v_", F.col("held.id"), now.cast("string"))).when(F.col("kind") == "create", _name("__v_", now.cast("string")))
        told = stored(both.withColumn("made", made).drop("_times"))
        parts = self._touched(told.where("kind <> 'refused'"))
        if parts:
            self._write(self._next(told, parts, sets, now), "overwrite")

        def audit(kind: str, fact: Column) -> DataFrame:
            rows = told.where(F.col("kind") == kind).withColumn("fact_id", fact)
            return rows.select(_name("__audit_", F.col("fact_id"), F.lit(kind)).alias("version_id"), "fact_id", "logical_id", F.lit(kind).alias("change_type"), F.col("author").cast("string").alias("author_id"), now.alias("created_at"))

        closed = F.when(F.col("_updates"), _name("__v_", F.col("held.id"), now.cast("string"))).otherwise(F.col("held.id"))
        rows = audit("update", F.col("made")).union(audit("create", F.col("made"))).union(audit("invalidate", closed))
        rows.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/versions")
        return told.drop("_updates", "_shut", "made")

    def _next(self, told: DataFrame, parts: list[int], sets: list[str], now: Column) -> DataFrame:
        """The next facts of ``parts``."""
        facts = self.read(parts)
        hits = told.where("kind = 'update' OR kind = 'invalidate' AND NOT _updates")
        hits = hits.select(F.col("logical_id").alias("_of"), F.col("held.id").alias("_id"), (F.col("kind") == "update").alias("_sets"), "to", "made", F.col("_shut").alias("_shuts"))
        hits = hits.hint("shuffle_hash")  # facts are sorted once, when they are written
        met = facts.join(hits, (F.col("logical_id") == F.col("_of")) & (F.col("id") == F.col("_id")), "left")

        def row(**new: Column) -> Column:
            return F.struct(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in facts.schema])

        given = {c: F.coalesce(F.col(f"to.{c}"), F.col(c)) for c in sets if c != "status"}
        status = F.coalesce("to.status", F.lit("valid")) if "status" in sets else F.lit("valid")
        closed = row(valid_to=now, status=F.lit("obsolete"))
        after = row(**given, id=F.col("made"), valid_from=now, valid_to=F.when(F.col("_shuts"), now), status=F.when(F.col("_shuts"), "obsolete").otherwise(status))
        next_ = met.select(F.inline(F.when(F.col("_of").isNull(), F.array(row())).when(F.col("_sets"), F.array(closed, after)).otherwise(F.array(closed))))
        none = {f.name: F.lit(None) for f in facts.schema if f.name != "logical_id"}
        fresh = {c: F.col(f"to.{c}") for c in sets} | {"id": F.col("made"), "valid_from": now, "status": status}
        return next_.union(told.where("kind = 'create'").select(F.inline(F.array(row(**none | fresh)))))

    def change(self, changes: DataFrame, now: Column, reopen: bool = False) -> DataFrame:
        """Close the latest open version of each logical id and let one with the new values follow; returns the
        refused changes (logical_id, reason).

        changes: logical_id, some of SETTABLE and author_id. Nothing is done where no value differs. An unknown logical id is
        inserted where entity_id and property are given. A logical id named twice, one without an open version and an unknown
        one that cannot be inserted are refused. With ``reopen`` one without an open version is inserted as if it were unknown.
        """
        has = self.read().columns
        sets = [c for c in SETTABLE if c in changes.columns and c in has] or ["status"]
        to = F.struct(*[(F.col(c) if c in changes.columns else F.lit(None).cast("string")).alias(c) for c in sets])
        author = F.col("author_id") if "author_id" in changes.columns else F.lit(None).cast("string")
        asks = stored(changes.select("logical_id", to.alias("to"), author.alias("author"), F.lit(False).alias("closes")))
        return self.carry_out(self.met(asks, sets), now, reopen).where("kind = 'refused'").select("logical_id", "reason").distinct()

    def invalidate(self, logical_ids: DataFrame, now: Column) -> DataFrame:
        """Close the latest open versions; returns the refused logical ids."""
        asks = stored(logical_ids.select("logical_id").distinct())
        none = F.lit(None).cast("string")
        met = self.met(asks, []).withColumns({"to": F.struct(none.alias("status")), "author": none, "closes": F.lit(True)})
        return self.carry_out(met, now).where("kind = 'refused'").select("logical_id", "reason")
