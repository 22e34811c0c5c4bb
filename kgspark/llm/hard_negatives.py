"""11. Hard-negative mining: orthogonal PCA rotation, partial products over leading components, exact integer products.

All vectors are rotated into the principal axes of all rows, so inner products stay as they are and most of every vector's
length lies in its leading components. An anchor is held against a row by a partial product over these; what the others can
add is at most the product of both residual norms (Cauchy-Schwarz), plus slack for rounding. Pairs that cannot reach the
anchor's k-th best row so far, or cannot lie in any of its windows of scores, are discarded early, after an eighth, a
quarter, a half of the components; each pair that is left is verified with the integer product of the vectors themselves.

Two searches of this kind are made: the first positives of each anchor among rows of its label, and, for each positive, the
first rows of other labels in the window of scores that it gives. In both, anchors (a stated query set) in blocks of about
ANCHORS meet rows in blocks: a cell holds its anchors and streams its rows, and keeps the best k rows for each window only.
Rows are copied once for each block of anchors, anchors once for each block of rows; no block depends on label or vector,
so hot labels and copies of a vector are spread.

Defined results: rows without label or vector, or with a null or non-finite component, take no part; the shorter of two
vectors counts as filled up with zeros; ties go to the smaller vec_id, null last; rows of the anchor's own vec_id are
neither its positives nor its negatives; repeated rows are rows of their own, also as anchors, with results of their own;
an empty table gives no rows. Components times 256 must fit a long; scores beyond a long stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import released, stored, table

#: Anchors in a block, rows in a block, and the tile of both that is worked on at a time.
ANCHORS, ROWS, TILE = 8192, 65_536, (512, 2048)
#: With fewer pairs left than one in FEW, they are gathered instead of multiplied as a matrix.
FEW = 16
FOUND = "anchor long, w int, score long, vec_id long"


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q (integer components) of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q"))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The principal axes of all rows, as columns; orthogonal."""
    filled = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
    pc = PCA(k=width, inputCol="x", outputCol="y").fit(rows.select(array_to_vector(filled.cast("array<double>")).alias("x"))).pc.toArray()
    return np.linalg.qr(pc)[0] if np.isfinite(pc).all() else np.eye(width)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The vectors as int64 rows, filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == width).all():
        return flat.reshape(-1, width)
    made = np.zeros((len(n), width), np.int64)
    made[np.arange(width) < n[:, None]] = flat
    return made


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows: exact, in Python's integers where they may not fit."""
    size = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if size(a) * size(b) * a.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    exact = [sum(map(int.__mul__, x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array(exact, np.int64)  # OverflowError beyond a long


class _Cell:
    """A block of anchors, and the best ``k`` of the rows it has met, for each anchor and window of scores."""

    def __init__(self, axes: np.ndarray, k: int, same: bool):
        self.axes, self.k, self.same = axes, k, same
        width = len(axes)
        self.cuts = sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2), width})
        self.slack = 8 * width * width * np.finfo(np.float64).eps
        self.parts: list[tuple] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(tuple(batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("anchor", "vec_id", "label", "q", "lows", "highs")))

    def _turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated vectors, their residual norms after each cut, their whole norms."""
        y = q.astype(np.float64) @ self.axes
        square = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
        rest = np.stack([np.sqrt(square[:, c]) if c < y.shape[1] else np.zeros(len(y)) for c in self.cuts], 1)
        return y, rest, np.sqrt(square[:, 0])

    def ready(self) -> None:
        anchor, vec_id, label, q, lows, highs = (pa.concat_arrays(x) for x in zip(*self.parts, strict=True))
        self.anchor, self.label = anchor.to_numpy(), label.to_numpy()
        self.id, self.no_id = _ids(vec_id)
        self.q = _matrix(q, len(self.axes))
        self.y, self.rest, self.norm = self._turned(self.q)
        windows = max(1, int(np.diff(lows.offsets.to_numpy()).max(initial=0)))
        self.low, self.high = np.full((len(anchor), windows), np.iinfo(np.int64).max), np.full((len(anchor), windows), np.iinfo(np.int64).min)
        there = np.arange(windows) < np.diff(lows.offsets.to_numpy())[:, None]
        self.low[there], self.high[there] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
        self.best = np.full((len(anchor), windows), np.iinfo(np.int64).min)  # the k-th best score so far
        self.pool = [np.zeros(0, np.int64) for _ in range(5)]  # anchor's place, window, score, missing id, id
        self.new: list[list[np.ndarray]] = []
        self.held = 0

    def meet(self, batch: pa.RecordBatch) -> None:
        label, (ids, no_id) = batch.column("label").to_numpy(), _ids(batch.column("vec_id"))
        q = _matrix(batch.column("q"), len(self.axes))
        y, rest, norm = self._turned(q)
        for first in range(0, len(self.anchor), TILE[0]):
            i, j = self._left(slice(first, first + TILE[0]), y, rest, norm, label)
            own = (self.id[i] == ids[j]) & (self.no_id[i] == no_id[j])
            i, j = i[~own], j[~own]
            for at in range(0, len(i), 65_536):
                self._verified(i[at : at + 65_536], j[at : at + 65_536], q, ids, no_id)
        if self.held > max(10_000, len(self.pool[0]) // 2) or not len(self.pool[0]):
            self._cut()

    def _left(self, tile: slice, y: np.ndarray, rest: np.ndarray, norm: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of anchors of the tile and rows that the bounds leave."""
        ya, ra, na = self.y[tile], self.rest[tile], self.norm[tile]
        need = np.maximum(self.low[tile], self.best[tile]).min(1).astype(np.float64)
        top = self.high[tile].max(1).astype(np.float64)
        alive = (self.label[tile][:, None] == label) == self.same
        alive &= (need <= top)[:, None]
        slack = self.slack * na  # also of the bounds' own conversion, which is relative to them
        done, p = 0, np.zeros(alive.shape)
        for at, cut in enumerate(self.cuts):
            p += ya[:, done:cut] @ y[:, done:cut].T
            spare = ra[:, at][:, None] * rest[:, at] + slack[:, None] * norm
            alive &= (p + spare >= (need - abs(need) * 1e-15)[:, None]) & (p - spare <= (top + abs(top) * 1e-15)[:, None])
            done = cut
            if np.count_nonzero(alive) * FEW < alive.size:
                break
        i, j = np.nonzero(alive)
        p = p[i, j]
        for at, cut in enumerate(self.cuts):
            if cut > done and len(i):
                keep = np.zeros(len(i), bool)
                for b in range(0, len(i), 65_536):
                    s = slice(b, b + 65_536)
                    p[s] += np.einsum("ij,ij->i", ya[i[s], done:cut], y[j[s], done:cut])
                    spare = ra[i[s], at] * rest[j[s], at] + slack[i[s]] * norm[j[s]]
                    n, t = need[i[s]], top[i[s]]
                    keep[s] = (p[s] + spare >= n - abs(n) * 1e-15) & (p[s] - spare <= t + abs(t) * 1e-15)
                i, j, p, done = i[keep], j[keep], p[keep], cut
        return i + tile.start, j

    def _verified(self, i: np.ndarray, j: np.ndarray, q: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score = _products(self.q[i], q[j])
        for w in range(self.low.shape[1]):
            ok = (score >= np.maximum(self.low[i, w], self.best[i, w])) & (score <= self.high[i, w])
            self.new.append([i[ok], np.full(int(ok.sum()), w), score[ok], no_id[j[ok]], ids[j[ok]]])
            self.held += int(ok.sum())

    def _cut(self) -> None:
        """Keep the best k of each anchor and window."""
        at, w, score, no_id, ids = (np.concatenate(x) for x in zip(self.pool, *self.new, strict=True))
        order = np.lexsort((ids, no_id, -score, w, at))
        at, w, score, no_id, ids = (x[order] for x in (at, w, score, no_id, ids))
        first = np.r_[True, (at[1:] != at[:-1]) | (w[1:] != w[:-1])][: len(at)]
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        kth = rank == self.k - 1
        self.best[at[kth], w[kth]] = score[kth]
        self.pool = [x[rank < self.k] for x in (at, w, score, no_id, ids)]
        self.new, self.held = [], 0

    def found(self) -> pa.RecordBatch:
        self._cut()
        at, w, score, no_id, ids = self.pool
        columns = [pa.array(self.anchor[at]), pa.array(w.astype(np.int32)), pa.array(score), pa.array(ids, mask=no_id.astype(bool))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "w", "score", "vec_id"])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _searched(axes, k: int, same: bool):
    """Mapper over rows in the order of (cell, anchors first): the best rows of every anchor and window of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number, ready = None, None, False
        for batch in batches:
            names = batch.column("cell").to_numpy()
            rows = batch.column("anchor").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((names[1:] != names[:-1]) | (rows[1:] != rows[:-1])) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(names)], strict=True):
                if a == b:
                    continue
                if names[a] != number:
                    if ready:
                        yield cell.found()
                    cell, number, ready = _Cell(axes.value, k, same), names[a], False
                if not rows[a]:
                    cell.add(batch.slice(a, b - a))
                    continue
                if not cell.parts:
                    continue
                if not ready:
                    cell.ready()
                    ready = True
                for at in range(a, b, TILE[1]):
                    cell.meet(batch.slice(at, min(TILE[1], b - at)))
        if ready:
            yield cell.found()
        released()

    return run


def nearest(rows: DataFrame, anchors: DataFrame, axes, k: int, same: bool, n_rows: int, n_anchors: int, block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """anchor, w, score, vec_id, rank: the first ``k`` rows for each anchor and window (``lows`` to ``highs``).

    ``rows``: vec_id, label, q. ``anchors``: anchor, vec_id, label, q, lows, highs. Only rows of the anchor's label are
    searched, or, where not ``same``, only those of others.
    """
    spark = rows.sparkSession
    wide = -(-n_anchors // block[0])
    deep = max(-(-n_rows // block[1]), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // wide))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("lows", "array<long>"), ("highs", "array<long>"))]
    part = F.pmod(F.monotonically_increasing_id(), F.lit(deep))
    blocks, parts = F.sequence(F.lit(0), F.lit(wide - 1)), F.sequence(F.lit(0), F.lit(deep - 1))
    dealt = rows.withColumn("part", part).withColumn("block", F.explode(blocks))
    dealt = dealt.select((F.col("block") * deep + F.col("part")).cast("long").alias("cell"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label", "q", *none)
    asking = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(wide))).withColumn("part", F.explode(parts))
    asking = asking.select((F.col("block") * deep + F.col("part")).cast("long").alias("cell"), "anchor", "vec_id", "label", "q", "lows", "highs")
    cells = dealt.unionByName(asking).repartition("cell").sortWithinPartitions("cell", F.col("anchor").isNull())
    best = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    found = cells.mapInArrow(_searched(axes, k, same), FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``anchors``, which are some of ``rows``."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    keyed = stored(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "q"), "anchors")
    n_anchors = keyed.count()
    if size.n < 2 or not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, size.width)
    axes = spark.sparkContext.broadcast(rotation(rows, width))

    least, most = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1)
    open_ = keyed.withColumn("lows", F.array(least)).withColumn("highs", F.array(most))
    first = stored(nearest(rows, open_, axes, positives, True, size.n, n_anchors, block).select("anchor", F.col("rank").alias("w"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")

    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    bounds = first.withColumn("bound", F.struct("w", F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi")))
    bounds = bounds.groupBy("anchor").agg(F.array_sort(F.collect_list("bound")).alias("bounds"))  # ``positives`` at most
    asking = keyed.join(bounds, "anchor").select("anchor", "vec_id", "label", "q", F.col("bounds.lo").alias("lows"), F.col("bounds.hi").alias("highs"))
    second = nearest(rows, asking, axes, negatives, False, size.n, n_anchors, block)
    second = second.select("anchor", (F.col("w") + 1).alias("w"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = keyed.select("anchor", F.col("vec_id").alias("anchor_id"))
    return second.join(first, ["anchor", "w"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM whole AS a JOIN whole AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s USING (anchor_id)
WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
