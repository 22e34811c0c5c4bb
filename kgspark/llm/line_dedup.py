"""8. Line deduplication by winnowing over line hashes.

The unit is a stretch: from some line on, the fewest lines that have LEAST words together (lines without words are left
out). Of all stretches that begin within WINDOW words the one with the smallest hash is selected. Two places that share a
run of GUARANTEE words or more, in whole lines however long, therefore select a common stretch:

1. selected stretches are counted by hash, and those with several places go back to their documents;
2. around such a place the match is extended both ways: every stretch that begins or ends there, as far as the next
   selected stretch of a shared run can be, is held against all others by hash;
3. a stretch that also stands at an earlier place (smaller doc_id, then further up) goes, with its lines.

So all lines of a repeated run of GUARANTEE words go from its later places, whichever documents share which part of it, and
no line goes that is not part of LEAST words which stand earlier. No list of places is ever gathered: of each hash only the
first place and a count are kept, and the hash of a line that a third of all documents have is broadcast to its places.

Defined results: a null or empty text stays empty; a null doc_id comes after all others; rows with equal doc_id and text
are one document and share its result; where a document repeats lines closer than a stretch is long, the lines before the
first repeat stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, joined, slices, squeezed, stored, table, unsqueezed

LEAST, WINDOW = 20, 15
GUARANTEE = 2 * WINDOW + LEAST - 2


def worded(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Of the lines with words: number, 128-bit hash, count of words."""
    at, lines, counts = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        if n := len(line.split()):
            at.append(i)
            lines.append(xxhash.xxh3_128_digest(line))
            counts.append(n)
    return at, lines, counts


def stretches(counts: list[int]) -> list[int]:
    """The end of the stretch from each line on, as far as the rest has enough words."""
    ends: list[int] = []
    end = total = 0
    for n in counts:
        while end < len(counts) and total < LEAST:
            total += counts[end]
            end += 1
        if total < LEAST:
            break
        ends.append(end)
        total -= n
    return ends


def digest(lines: list[bytes], begin: int, end: int) -> bytes:
    return xxhash.xxh3_128_digest(b"".join(lines[begin:end]))


def selected(lines: list[bytes], counts: list[int]) -> list[tuple[int, bytes]]:
    """The winnowed stretches: place of the first line, hash."""
    hashes = [digest(lines, i, end) for i, end in enumerate(stretches(counts))]
    chosen: dict[int, bytes] = {}
    end = total = 0
    for i in range(len(hashes)):
        while end < len(hashes) and (end == i or total + counts[end] <= WINDOW):
            total += counts[end]
            end += 1
        h = min(hashes[i:end])
        chosen[hashes.index(h, i, end)] = h
        total -= counts[i]
    return sorted(chosen.items())


def extended(counts: list[int], places: list[int]) -> set[tuple[int, int]]:
    """All stretches, forwards and backwards, that begin or end within reach of these places."""
    sums = np.r_[0, np.cumsum(counts)]
    p = np.array(places)
    begins = np.maximum(np.searchsorted(sums, sums[p] - WINDOW - LEAST, "right") - 1, 0)
    ends = np.minimum(np.searchsorted(sums, sums[p + 1] + WINDOW + LEAST, "left"), len(counts))
    zone = np.zeros(len(sums), np.int32)
    np.add.at(zone, begins, 1)
    np.add.at(zone, ends, -1)
    inside = np.flatnonzero(np.cumsum(zone)[:-1] > 0).tolist()
    ahead = stretches(counts)
    back = [len(counts) - e for e in reversed(stretches(counts[::-1]))]  # of the last len(back) lines
    skip = len(counts) - len(back)
    found = {(i, ahead[i]) for i in inside if i < len(ahead)}
    found |= {(back[i - skip], i + 1) for i in inside if i >= skip}
    return found


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                at, lines, counts = worded(text)
                chosen = selected(lines, counts)
                rows.append((*(np.array(x, np.int32).tobytes() for x in (at, counts)), b"".join(lines), [p for p, _ in chosen], [h for _, h in chosen]))
            types = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("last", "id", "k")), *made], names=["last", "id", "k", "at", "counts", "lines", "place", "hash"])


def _extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, place and line numbers of the stretches around places that others have."""
    for batch in batches:
        for part in slices(batch, "lines"):
            of, hashes, begins, ends = [], [], [], []
            for i, (at, counts, joint, places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("at", "counts", "lines", "met")), strict=True)):
                number = np.frombuffer(at, np.int32)
                lines = [joint[x : x + 16] for x in range(0, len(joint), 16)]
                for begin, end in extended(np.frombuffer(counts, np.int32).tolist(), places):
                    of.append(i)
                    hashes.append(digest(lines, begin, end))
                    begins.append(number[begin])
                    ends.append(number[end - 1] + 1)
            row = pa.array(of, pa.int32())
            made = [pa.array(hashes, pa.binary()), *(part.column(c).take(row) for c in ("last", "id", "k")), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["hash", "last", "id", "k", "begin", "end"])


def _without(n: int):
    """Mapper over compressed texts and their runs: the first ``n`` columns, the text left, counts of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                rows = []
                for b, runs in zip(unsqueezed(part.column("text")), part.column("runs").to_pylist(), strict=True):
                    lines = b.split(b"\n")
                    gone = {i for r in runs or () for i in range(r["begin"], r["end"])}
                    text = b"\n".join([line for i, line in enumerate(lines) if i not in gone]) if gone else b
                    rows.append((text.decode(), len(lines), len(gone)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *map(pa.array, zip(*rows, strict=True))], names=[*part.schema.names[:n], "text", "n_lines", "n_removed"])

    return run


def _keyed(docs: DataFrame, *keep: str) -> DataFrame:
    return documents(docs, *keep).withColumn("k", F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """k (the key of doc_id and text), runs: array<struct<begin, end>> of line numbers, of documents that lose lines."""
    place = f"last boolean, id {docs.schema['doc_id'].dataType.simpleString()}, k binary"
    shape = f"{place}, at binary, counts binary, lines binary, place array<int>, hash array<binary>"
    rows = _keyed(docs).select(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "k", "text")
    lines = stored(rows.mapInArrow(_fingerprints, shape), "lines")
    found = lines.select("last", "id", "k", F.explode(F.arrays_zip("place", "hash")).alias("x")).select("last", "id", "k", "x.place", "x.hash")
    several = _several(found, "place").drop("first")
    met = joined(found.select("k", "place", "hash"), several, "hash").groupBy("k").agg(F.collect_set("place").alias("met"))
    around = lines.drop("place", "hash").join(met, "k").select("last", "id", "k", "at", "counts", "lines", "met")
    extended_ = stored(around.mapInArrow(_extensions, f"hash binary, {place}, begin int, end int"), "stretches")
    later = joined(extended_, _several(extended_, "begin"), "hash").where(F.struct("last", "id", "k", "begin") > F.col("first"))
    return later.groupBy("k").agg(F.collect_set(F.struct("begin", "end")).alias("runs"))


def line_dedup(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, text without repeated runs, n_lines, n_removed for every row."""
    texts = squeezed(_keyed(docs, *keep)).join(repeated_runs(docs), "k", "left").select("doc_id", *keep, "text", "runs")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return texts.mapInArrow(_without(1 + len(keep)), f"{kept}, text string, n_lines long, n_removed long")


def _several(rows: DataFrame, at: str) -> DataFrame:
    """Of the hashes with several places: hash, n, first."""
    where = F.struct("last", "id", "k", at)
    places = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(where).alias("first"), F.max(where).alias("final"))
    return stored(places.where("first <> final").select("hash", "n", "first"), "places")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
