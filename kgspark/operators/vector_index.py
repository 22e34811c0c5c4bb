"""Nearest vectors from a stored table, by cells (IVF) or exactly.

Vectors are normalized and dealt to the nearest of some cell centres; the table is partitioned by cell, and a search reads
the cells nearest to its query only. Centres are fitted by k-means on at most SAMPLE vectors (a documented bound; every
vector is indexed). There are about as many cells as the square root of the rows, from 1 to CELLS. A search over all cells is
exact; with ``probe`` cells, recall is what ``recall`` measures against it. (On the given vectors, which have no clusters: 0.94 from
half of the cells, 0.98 to 1 from two thirds.)

Rows of one vector can be indexed as one row and its ``copies``: vectors are then stored, and multiplied by queries, once.

A cell that holds very many vectors is dealt over several files. Null, empty and zero vectors are in no cell and never found;
so are vectors of another length than most have.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kgspark.operators import retrieval
from kgspark.operators.retrieval import dot, normalized
from kgspark.sources.shared import stored

SAMPLE, CELLS = 20_000, 4096
#: Distances that a task holds at a time.
HELD = 1 << 22


def _dealt(centres: list[list[float]], most: int):
    """Mapper that adds ``cells``, the places of the ``most`` nearest centres, to rows with ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centres)
        own, step = (c * c).sum(axis=-1), max(1, HELD // max(1, len(c)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cells = np.argsort(own - 2 * (v @ c.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * cells.shape[1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, cells.ravel())], names=[*part.schema.names, "cells"])

    return run


@dataclass
class VectorIndex:
    """An index under ``path``, which all executors share; ``centres`` are bounded by CELLS."""

    spark: SparkSession
    path: str
    centres: list[list[float]]
    key: str = "bigint"
    copied: bool = False

    @classmethod
    def built(cls, rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, copies: DataFrame | None = None) -> VectorIndex:
        """Write the index of ``rows`` (key, v) and of their ``copies`` (key, of): keys of the vector of the smaller key ``of``."""
        spark = rows.sparkSession
        unit = stored(normalized(rows).select("key", "v"))
        lengths = unit.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
        n = lengths["count"] if lengths else 0
        # The rows of the smallest hashes: as many as the bound, the same ones in every run.
        fitted = unit.where(F.size("v") == (lengths.width if n else 0)).orderBy(F.xxhash64("key"), "key").limit(sample)
        cells = max(1, min(CELLS, cells or math.isqrt(n)))
        centres: list[list[float]] = []
        if n and cells == 1:
            centres = [list(fitted.first().v)]  # any will do; KMeans takes two at least
        elif n:
            model = KMeans(k=cells, seed=7, maxIter=10, featuresCol="x").fit(fitted.select(array_to_vector("v").alias("x")))
            centres = [[float(x) for x in c] for c in model.clusterCenters()]
        index = cls(spark, path, centres, rows.schema["key"].dataType.simpleString(), copies is not None)
        if copies is not None:
            copies.select("key", "of").write.mode("overwrite").parquet(f"{path}/copies")
        spark.createDataFrame([(json.dumps(centres), index.key, index.copied)], "centres string, key string, copied boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index._written(unit, "overwrite")
        return index

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> VectorIndex:
        held = spark.read.parquet(f"{path}/centres").first()
        return cls(spark, path, json.loads(held.centres), held.key, held.asDict().get("copied", False))

    def _written(self, unit: DataFrame, mode: str) -> None:
        held = self._in_cells(unit, 1).withColumnRenamed("cells", "cell").withColumn("cell", F.get("cell", F.lit(0)))
        held.repartitionByRange("cell", "key").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def _in_cells(self, unit: DataFrame, most: int) -> DataFrame:
        """``unit`` with ``cells``: the ``most`` nearest centres; those of another length go."""
        width = len(self.centres[0]) if self.centres else 0
        return unit.where(F.size("v") == width).mapInArrow(_dealt(self.centres, most), T.StructType([*unit.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))]))

    def add(self, rows: DataFrame) -> None:
        """Index further rows by the same centres; rows whose key is known are the caller's to leave out."""
        self._written(normalized(rows), "append")

    def _different(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key}, v array<double>, cell int").parquet(f"{self.path}/cells")

    def _copies(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key}, of {self.key}").parquet(f"{self.path}/copies")

    def stored(self) -> DataFrame:
        rows = self._different()
        if not self.copied:
            return rows
        return rows.union(self._copies().join(rows.withColumnRenamed("key", "of"), "of").select("key", "v", "cell"))

    def keys(self) -> DataFrame:
        """key, of: the keys of all rows, with the one that their vector is stored under."""
        own = self._different().select("key", F.col("key").alias("of"))
        return own.union(self._copies()) if self.copied else own

    def nearest_to_stored(self, keys: DataFrame, k: int) -> DataFrame:
        """query_id, key, score, rank, as ``nearest`` gives them, of the stored rows with ``keys`` (key, of); copies are asked
        for once."""
        asked = self._different().join(keys.select(F.col("of").alias("key")).distinct(), "key", "left_semi")
        found = self.nearest(asked.select(F.col("key").alias("query_id"), "v"), k).withColumnRenamed("query_id", "of")
        return keys.withColumnRenamed("key", "query_id").join(found, "of").select("query_id", "key", "score", "rank")

    def _with_copies(self, found: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of all rows from those of the different vectors (query_id, key, score): as a vector's first key is its
        smallest, a row is among the first ``k`` only if its vector is, and as one of its ``k`` smallest keys."""
        nth = F.row_number().over(Window.partitionBy("of").orderBy("key"))
        first = self._copies().withColumn("_n", nth).where(F.col("_n") < k).select("key", "of")
        own = found.select("query_id", "key", "score")
        both = own.union(own.withColumnRenamed("key", "of").join(first, "of").select("query_id", "key", "score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return both.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)

    def nearest(self, queries: DataFrame, k: int, probe: int | None = None) -> DataFrame:
        """query_id, key, score (cosine, six places), rank for ``queries`` (query_id, v); ``probe`` None: all cells, exact.

        Queries meet the rows of the cells they probe, cells of more than BLOCK rows in blocks; an exact search takes blocks
        of all rows.
        """
        if probe is None or probe >= len(self.centres):
            width = len(self.centres[0]) if self.centres else 0
            found = retrieval.everywhere(normalized(queries).where(F.size("v") == width), self._different(), k)
            return self._with_copies(found, k).select("query_id", "key", "score", "rank") if self.copied else found
        rows = self.stored()
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / retrieval.BLOCK).cast("int").alias("blocks"))  # CELLS at most
        number = lambda part: F.struct(F.col("cell"), part.alias("part"))
        asked = self._in_cells(normalized(queries).select("query_id", "v"), probe).select("query_id", "v", F.explode("cells").alias("cell"))
        asked = asked.join(F.broadcast(sizes), "cell").select("query_id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "cell")
        dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
        block = F.xxhash64(number(F.col("part")))
        return retrieval.nearest(asked.withColumn("block", block), dealt.withColumn("block", block), k)

    def nearest_to(self, query: list[float], k: int, probe: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """key, score for one query: its cells are known before the plan is made, so only their partitions are read.

        ``allowed``: the keys that may be found at all.
        """
        norm = math.sqrt(sum(x * x for x in query))
        q = [x / norm for x in query] if norm else query
        rows = self.stored()
        if probe is not None and probe < len(self.centres):
            far = sorted((sum(c * c for c in centre) - 2 * sum(a * b for a, b in zip(centre, q, strict=True)), i) for i, centre in enumerate(self.centres))
            rows = rows.where(F.col("cell").isin([i for _, i in far[:probe]]))
        if allowed is not None:
            rows = rows.join(allowed, "key", "left_semi")
        score = F.round(dot(F.col("v"), F.array(*map(F.lit, q))), 6)
        return rows.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def recall(self, queries: DataFrame, k: int, probe: int) -> DataFrame:
        """recall, n: the share of the exact k best that ``probe`` cells give, and how many these are."""
        exact = self.nearest(queries, k).select("query_id", "key", F.lit(1).alias("there"))
        near = self.nearest(queries, k, probe).select("query_id", "key", F.lit(1).alias("found"))
        return exact.join(near, ["query_id", "key"], "left").agg(F.round(F.count("found") / F.count("there"), 6).alias("recall"), F.count("there").alias("n"))
