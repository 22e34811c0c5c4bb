"""3. Best-fit packing by minimum bin slack.

Every document is tokenized and ended by id 0; documents longer than a sequence are cut into full pieces. Packing then
depends on the lengths alone, and there are at most ``capacity`` different ones: their histogram, of a size that does
not grow with the data, goes to the driver. For each bin a bitset subset-sum finds the fullest combination of available
lengths beside the longest one left. The same combination stays the fullest while enough of its lengths are left, so it
is removed as many times as they last, and one row of the plan stands for all these bins. Pieces find their bin by their
rank among the pieces of their length, which is counted in salted shares, so no length (a third of the rows may have
the same) meets in one task.

Defined results: a null or empty text is the single id 0; a null doc_id and repeated rows are packed as rows of their
own; an empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import WordEncoder, documents, slices, stored, table, tokenizer_path

CAPACITY = 2048
#: No share of a length has more rows than this, or than a thousandth of all rows if that is less.
SHARE = 200_000
PLAN = "length int, low long, high long, first_sequence long, copies int, first_offset int"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = encoder.encode(text.encode()) + b"\0\0\0\0"
                    n = len(ids) >> 2
                    if n <= capacity:
                        rows.append((i, 0, 0, n, zlib.crc32(ids)))
                        continue
                    for k, start in enumerate(range(0, n, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((i, k, start, len(own) >> 2, zlib.crc32(own)))
                if rows:
                    of, *cols = zip(*rows, strict=True)
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"],
                    )

    return docs.mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: {length: copies}."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room or not counts[n]:
            continue
        left, take = min(counts[n], room // n), 1
        while left:  # 1, 2, 4, ... copies at a time reach every number of copies
            take = min(take, left)
            steps.append((n, take, reach))
            reach = (reach | reach << n * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            used[n] = used.get(n, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: the pieces of ``length`` ranked low to high - 1 lie ``copies`` to a sequence from first_sequence on."""
    counts = dict(histogram)
    lengths = sorted(counts, reverse=True)
    done = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for longest in lengths:
        while counts[longest]:
            counts[longest] -= 1
            bin_ = fullest(counts, lengths, capacity - longest)
            counts[longest] += 1
            bin_[longest] = bin_.get(longest, 0) + 1
            times = min(counts[n] // k for n, k in bin_.items())
            offset = 0
            for n, k in sorted(bin_.items(), reverse=True):
                rows.append((n, done[n], done[n] + times * k, sequence, k, offset))
                done[n] += times * k
                counts[n] -= times * k
                offset += n * k
            sequence += times
        lengths = [n for n in lengths if counts[n]]
    return rows


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document lies."""
    spark = docs.sparkSession
    # Rows are numbered in the table, so that repeated ones are spread over shares too.
    cut = stored(pieces(documents(docs), path or tokenizer_path(), capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    most = max(64, min(SHARE, sum(histogram.values()) // 1000))
    shares = F.broadcast(spark.createDataFrame([(n, -(-c // most)) for n, c in histogram.items()], "length long, shares int"))
    salted = cut.join(shares, "length").withColumn("share", F.expr("pmod(xxhash64(row), shares)"))
    by = Window.partitionBy("length").orderBy("share")
    before = salted.groupBy("length", "share").count().select("length", "share", (F.sum("count").over(by) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("row")
    ranked = (
        salted.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "share"])
        .withColumn("rank", F.col("before") + F.col("nth"))
    )
    rows = F.broadcast(spark.createDataFrame(plan(histogram, capacity), PLAN).withColumnRenamed("length", "planned"))
    return ranked.join(rows, (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - low) div copies")).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.expr("(rank - low) % copies") * F.col("length")).cast("long").alias("offset"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
