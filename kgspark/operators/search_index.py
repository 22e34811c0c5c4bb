"""Ranked search over an inverted index that is kept as a partitioned table.

``built`` writes postings (token, key, tf, length) under their token's partition and sorted by token, so that a search
reads the partitions of its own words alone, and of these the row groups with the words. A word that is in very many texts
is dealt over several files, as postings are dealt by range of (partition, token, key). The score is BM25 (K1, B); what it
needs of the whole corpus (texts, mean length, document frequencies) is written once beside the postings.

Words are lower-cased runs of letters and digits. Several kinds of rows (entities, facts, documents, terms) share an index;
each kind has statistics of its own. Null and blank texts have
no postings and count as texts of length 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import counted
from kgspark.operators.template import once
from kgspark.sources.shared import stored

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
WORD = "[\\p{L}\\p{N}]+"
PARTITIONS = 64


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def partition(token: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(partitions)).cast("int")


def counts(rows: DataFrame) -> DataFrame:
    """kind, key, token, tf, length of ``rows`` (kind, key, w: its words), and a row without a token for each text.

    Words are counted inside the row, so nothing moves.
    """

    def told(w: Column) -> Column:
        length = F.coalesce(F.size(w), F.lit(0))
        whole = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).alias("tf"), length.alias("length"))
        each = F.when(w.isNull(), F.array().cast("array<struct<token:string,tf:int,length:int>>")).otherwise(F.transform(counted(w), lambda c: F.struct(c["token"].alias("token"), c["tf"].cast("int").alias("tf"), length.alias("length"))))
        return F.concat(F.array(whole), each)

    return rows.select("kind", F.col("key").cast("string").alias("key"), F.inline(once(F.col("w"), told)))


def placed(spark: SparkSession, query: str, split: Callable[[Column], Column], partitions: int) -> dict[str, int]:
    """The different tokens of a question, with the partition of each."""
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(split(F.col("q")))).alias("token"))
    return {r.token: r.part for r in asked.select("token", partition(F.col("token"), partitions).alias("part")).collect()}


@dataclass
class SearchIndex:
    """An index under ``path``, which all executors share."""

    spark: SparkSession
    path: str
    partitions: int = PARTITIONS

    @classmethod
    def built(cls, rows: DataFrame, path: str, partitions: int = PARTITIONS) -> SearchIndex:
        """Write the index of ``rows`` (kind, key, text)."""
        index = cls(rows.sparkSession, path, partitions)
        made = counts(rows.select("kind", "key", words(F.col("text")).alias("w")))
        made.write.mode("overwrite").parquet(f"{path}/counts")  # words are found and counted once; all below read them
        made = rows.sparkSession.read.schema(made.schema).parquet(f"{path}/counts")
        sizes = made.where("token IS NULL").groupBy("kind").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        posted = made.where("token IS NOT NULL").withColumn("part", partition(F.col("token"), partitions))
        df = posted.groupBy("part", "kind", "token").agg(F.count("*").alias("df")).select("kind", "token", "df", "part")
        df.repartition("part").sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/frequencies")
        held = posted.select("kind", "key", "token", "tf", "length", "part")
        held.repartitionByRange("part", "token", "key").sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        return index

    def _table(self, name: str, tokens: dict[str, int]) -> DataFrame:
        """Rows of the tokens, from their partitions."""
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows.where(F.col("part").isin([*set(tokens.values())]) & F.col("token").isin([*tokens]))

    def hits(self, query: str, kinds: list[str] | None = None) -> DataFrame:
        """kind, key, score, matched (words found) of every row that has a word of the query."""
        tokens = placed(self.spark, query, words, self.partitions)
        if not tokens:
            return self.spark.createDataFrame([], "kind string, key string, score double, matched long")
        found, sizes, df = self._table("postings", tokens), self.spark.read.parquet(f"{self.path}/sizes"), self._table("frequencies", tokens)
        if kinds is not None:
            found = found.where(F.col("kind").isin(kinds))
        # One row for each kind and word of the query.
        weights = df.join(F.broadcast(sizes), "kind").select("kind", "token", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        met = found.join(F.broadcast(weights), ["kind", "token"])
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return met.groupBy("kind", "key").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))

    def ranked(self, query: str, limit: int | None = None, kinds: list[str] | None = None, seen: dict[str, DataFrame] | None = None) -> DataFrame:
        """``hits`` by falling score, then kind and key. ``seen``: for a kind, the rows (key) that may be shown at all."""
        rows = self.hits(query, kinds)
        for kind, allowed in (seen or {}).items():
            own = allowed.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"))
            rows = rows.where(F.col("kind") != kind).unionByName(rows.where(F.col("kind") == kind).join(own, ["kind", "key"], "left_semi"))
        rows = rows.orderBy(F.desc("score"), "kind", "key")
        return rows if limit is None else rows.limit(limit)


    def candidates(self, phrases: DataFrame) -> DataFrame:
        """kind, key of the rows that hold the rarest word of a phrase (phrase): no others can hold all of it.

        Only the partitions of the phrases' words are read, and a phrase with a word that no row has gives none.
        """
        tokens = F.explode(F.array_distinct(words(F.col("phrase")))).alias("token")
        asked = stored(phrases.select("phrase", tokens).withColumn("part", partition(F.col("token"), self.partitions)))

        def read(name: str, of: DataFrame) -> DataFrame:
            parts = [r.part for r in of.select("part").distinct().collect()]  # as many as the index has at most
            return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("part").isin(parts))

        df = read("frequencies", asked).groupBy("part", "token").agg(F.sum("df").alias("df"))
        rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "part")).alias("x")
        rare = stored(asked.join(df, ["part", "token"], "left").groupBy("phrase").agg(rarest).select("x.token", "x.part").distinct())
        return read("postings", rare).join(rare, ["part", "token"], "left_semi").select("kind", "key").distinct()
