"""Entities and sources by name: found, or made with a deterministic id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made_id(prefix: str, name: Column, length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(name, 256), 1, length))


def upsert_or_select(known: DataFrame, asked: DataFrame, name: str, prefix: str) -> DataFrame:
    """Name, id, created: the known row of each asked name, or a new one; names asked twice are one."""
    met = asked.select(name).where(F.col(name).isNotNull()).distinct().join(known.select(name, "id"), name, "left")
    return met.select(name, F.coalesce("id", made_id(prefix, F.col(name))).alias("id"), F.col("id").isNull().alias("created"))


def duplicates(rows: DataFrame, content: str, key: str) -> DataFrame:
    """Digest, n, first_id of every content that more than one row has."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def unseen(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows (key, digest) that a cache of the same columns does not have: new keys and changed contents."""
    return rows.join(cache, [key, "digest"], "left_anti")


def inserted(entities: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities with the new rows, and the rows refused (id, reason): ids that exist, or come twice in the batch."""
    first = rows.dropDuplicates(["id"])
    new = first.join(entities.select("id"), "id", "left_anti")
    exists = first.join(entities.select("id"), "id", "left_semi").select("id", F.lit("exists").alias("reason"))
    twice = rows.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("reason"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in entities.schema if f.name not in rows.columns]
    return entities.unionByName(new.select("*", *missing).select(entities.columns)), exists.union(twice)


def sources_upserted(sources: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources (id, uri, ingested_at, ...) with the batch merged in by id.

    Of a source that is known the columns that the batch sets are replaced, others stay; the latest ingestion counts.
    """
    columns = [c for c in sources.columns if c != "id"]
    latest = batch.groupBy("id").agg(*[F.max_by(c, F.struct(F.col("ingested_at").isNotNull(), "ingested_at")).alias(f"_{c}") for c in columns if c in batch.columns])
    met = sources.join(latest, "id", "full")
    out = {c: F.coalesce(f"_{c}", c) if c in batch.columns else F.col(c) for c in columns}
    if "ingested_at" in out:
        out["ingested_at"] = F.greatest("ingested_at", "_ingested_at")
    return met.select("id", *[v.alias(c) for c, v in out.items()])


def listed(rows: DataFrame) -> DataFrame:
    """Visible rows by id; filter them first."""
    return rows.orderBy("id")


def sample(rows: DataFrame, name: str, n: int) -> DataFrame:
    """The first ``n`` rows by name, the same ones at every run."""
    return rows.orderBy(name).limit(n)
