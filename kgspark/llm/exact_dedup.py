"""13. Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Texts are equal when they are identical after lower-casing A-Z. They are read once, for their SHA-256. The first pass over
the hashes sets HASHES cells of a Bloom filter for each row, and notes which cells were set more than once: every task
gives the cells it has set once and more often, in slices of SLICE cells, and slices are added up. The second pass tests
each row against the cells set more than once: a row with a cell of its own has a text of its own and passes straight
through; the others, all repeated texts and a few chance meetings, are grouped by hash. Equal rows are counted before they
move, and texts of a large share of all rows meet their group by broadcast, so that no task gets a whole group of copies.

The filter has about CELLS_A_ROW cells for each row, and no more than ``most`` (2^29: 64 MB are broadcast). Beyond
``most`` / CELLS_A_ROW rows chance meetings grow and with them the rows that shuffle (40 bytes each); results are the same.

Defined results: a null text counts as empty; a null doc_id is smaller than any other, so its row stays only where its
text has no doc_id at all; of repeated rows (equal text and doc_id) one stays; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, joined, released, slices, stored, table

CELLS_A_ROW, HASHES = 16, 2
SLICE = 1 << 16
MOST = 1 << 29
#: Rows whose cells a task holds before it gives them out.
ROWS = 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 23, 4096):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            made = [hashlib.sha256(t.translate(LOWER)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "sha"])
    released()


def _cells(shas: pa.Array, bits: int) -> np.ndarray:
    """The cells of each hash, one row for each of HASHES."""
    parts = np.frombuffer(b"".join(shas.to_pylist()), ">u8").reshape(-1, 4)
    return (parts[:, :HASHES].T.astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _set(bits: int, spread: int):
    """Mapper: for each slice of the filter the cells that this task set once, and those it set more often."""

    def given(held: list[np.ndarray]) -> pa.RecordBatch:
        cells, times = np.unique(np.concatenate(held), return_counts=True)
        number, begins = np.unique(cells // SLICE, return_index=True)
        ends = np.r_[begins[1:], len(cells)]
        places, again = (cells % SLICE).astype(np.uint16), times > 1
        once, more = [], []
        for a, b in zip(begins, ends, strict=True):
            once.append(places[a:b][~again[a:b]].tobytes())
            more.append(places[a:b][again[a:b]].tobytes())
        share = [TaskContext.get().partitionId() % spread] * len(number)
        columns = [pa.array(number), pa.array(share, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "share", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(_cells(batch.column("sha"), bits).ravel())
                rows += batch.num_rows
            if rows >= ROWS:
                yield given(held)
                held, rows = [], 0
        if rows:
            yield given(held)

    return run


def _added(dense: bool):
    """Grouped: the sum of a slice's parts, as bit maps; parts are lists of cells, or bit maps (``dense``)."""

    def bitmap(blob: bytes) -> np.ndarray:
        if dense:
            return np.frombuffer(blob, np.uint8)
        cells = np.zeros(SLICE, bool)
        cells[np.frombuffer(blob, np.uint16)] = True
        return np.packbits(cells, bitorder="little")

    def run(t: pa.Table) -> pa.Table:
        once = more = np.zeros(SLICE // 8, np.uint8)
        for a, b in zip(t.column("once").to_pylist(), t.column("more").to_pylist(), strict=True):
            a, b = bitmap(a), bitmap(b)
            more = more | b | (once & a)
            once = once | a
        return pa.table([t.column("slice").slice(0, 1), t.column("share").slice(0, 1), pa.array([once.tobytes()]), pa.array([more.tobytes()])], names=["slice", "share", "once", "more"])

    return run


def _repeated_cells(hashes: DataFrame, bits: int) -> bytes:
    """The filter of cells that were set more than once: 2^bits bits, whatever the rows."""
    kinds = "slice long, share int, once binary, more binary"
    spread = math.isqrt(hashes.rdd.getNumPartitions()) + 1  # the number alone
    parts = hashes.select("sha").mapInArrow(_set(bits, spread), kinds)
    sums = parts.groupBy("slice", "share").applyInArrow(_added(False), kinds).groupBy("slice").applyInArrow(_added(True), kinds)
    found = np.zeros(max(1, (1 << bits) // SLICE) * (SLICE // 8), np.uint8)
    for r in sums.select("slice", "more").toLocalIterator():
        found[r.slice * (SLICE // 8) : (r.slice + 1) * (SLICE // 8)] = np.frombuffer(r.more, np.uint8)
    return found.tobytes()


def _tested(bits: int, repeated, wanted: bool):
    """Mapper: rows all of whose cells were set more than once (``wanted``), or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(repeated.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                cells = _cells(batch.column("sha"), bits)
                maybe = ((found[cells >> 3] >> (cells & 7)) & 1).all(0)
                yield batch.filter(pa.array(maybe == wanted))

    return run


def exact_dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha (SHA-256 of the lower-cased text) of every row of ``docs``."""
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sha binary"
    hashes = stored(documents(docs).mapInArrow(_hashed, kinds), "hashes")
    rows = max(SLICE // CELLS_A_ROW, min(hashes.count(), most // CELLS_A_ROW))
    bits = (CELLS_A_ROW * rows - 1).bit_length()
    repeated = spark.sparkContext.broadcast(_repeated_cells(hashes, bits))
    maybe = hashes.mapInArrow(_tested(bits, repeated, True), kinds)
    rest = hashes.mapInArrow(_tested(bits, repeated, False), kinds)

    one = stored(maybe.groupBy("sha", "doc_id").agg(F.count("*").alias("copies")), "one")  # repeated rows are counted before they move
    groups = one.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("n"))
    met = joined(one, stored(groups, "groups"), "sha").select("*", F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth", "_"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    repeats = met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")
    return rest.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha").union(repeats)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM hashed
WINDOW same AS (PARTITION BY text_sha256)
"""
