"""7. N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts are compared as sets of word shingles. One pass over all documents counts shingles in a table of BUCKETS hash
counts, whose size does not grow with the data; ordering every set by (count, hash) puts rare shingles first, the same way
in every set, so two similar sets share a shingle of their prefixes. Equal texts are one class from the start and are
never paired. Prefix shingles are joined by hash; of each pair that meets, the length filter, the positional filter and
the suffix filter (counts of the set's shingles in PARTS hash ranges bound the overlap) must pass, and each pair left is
verified once on the shingles of both texts themselves, not on hashes.

A shingle in a large group of near copies must not give all its pairs. In groups of more than SMALL classes each class
first meets the NEAREST classes by their range counts and the group's centre only; what that links is one component, and
afterwards only pairs across components are joined, so no link between components is lost. There the shorter text needs
the shingle in its index prefix (which is about half as long as the prefix the longer one is searched by), and lengths
must fit, so that texts which share a template and do not link give no pairs. Shingles whose bucket counts far more texts
than most are dealt in shares from the start, and groups of both steps in salted blocks: no task gets a whole group.

Shingles meet by 64-bit hashes of words' hashes: two that collide cost a verification. Within a text, a collision
would make its set smaller by one; that has a chance of about n * n / 2**65 for n shingles.

Defined results: null, empty and blank texts have empty sets and link with nothing, not even each other; equal texts
link; null doc_ids are never the smallest of a component; repeated rows repeat their result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import documents, joined, slices, squeezed, stored, table, unsqueezed
from kgspark.llm.components import components
from kgspark.llm.shingles import shared, shingle_sets

BUCKETS, PARTS = 1 << 20, 64
SLICES = 16
SMALL, NEAREST, BLOCK = 16, 4, 1024
#: Rows of one prefix shingle that go together, at most about; shares are made of buckets with CROWDED times the mean count.
SHARE, CROWDED = 50_000, 8


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices without texts this task has had."""
    seen: set[bytes] = set()
    for batch in batches:
        keys = batch.column("k").to_pylist()
        fresh = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                fresh.append(i)
        yield from slices(batch.take(pa.array(fresh, pa.int32())), "text")


def _surveyed(words: int, spread: int):
    """Mapper: one row for each different text (k, n, counts by range) and the task's bucket counts (slice, share, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(BUCKETS, np.uint32)
        names = ["k", "n", "ranges", "slice", "share", "counts"]
        for part in _unseen(batches):
            s, doc = shingle_sets([t.encode() for t in part.column("text").to_pylist()], words)
            n = np.bincount(doc, minlength=part.num_rows)
            ranges = np.bincount(doc * PARTS + (s & np.uint64(PARTS - 1)).astype(np.int64), minlength=part.num_rows * PARTS).reshape(-1, PARTS)
            ranges[n > 65535] = 65535  # too many to count: such a set is never filtered out
            blobs = [r.tobytes() for r in ranges.astype(np.uint16)]
            buckets += np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(n), pa.array(blobs, pa.binary()), *none], names=names)
        share = TaskContext.get().partitionId() % spread
        cut = [b.tobytes() for b in np.split(buckets.astype(np.uint64), SLICES)]
        none = [pa.nulls(SLICES, t) for t in (pa.binary(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array([share] * SLICES, pa.int32()), pa.array(cut, pa.binary())], names=names)

    return run


def _summed(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.uint64) for b in t.column("counts").to_pylist())
    return pa.table([t.column("slice").slice(0, 1), pa.array([total.tobytes()])], names=["slice", "counts"])


def _prefixes(words: int, num: int, den: int, counts, most: int):
    """Mapper: hash, share, shares, k, n, place of every prefix shingle of every different text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(counts.value, np.uint64)
        shares = 1 + common.astype(np.int64) // max(most, int(CROWDED * common.mean()))
        for part in _unseen(batches):
            s, doc = shingle_sets([t.encode() for t in part.column("text").to_pylist()], words)
            order = np.lexsort((s, common[(s >> np.uint64(44)).astype(np.int64)], doc))
            s, doc = s[order], doc[order]
            n = np.bincount(doc, minlength=part.num_rows)
            place = np.arange(len(s)) - (np.cumsum(n) - n)[doc]
            keep = place <= (n - -(-num * n // den))[doc]
            of = doc[keep]
            many = shares[(s[keep] >> np.uint64(44)).astype(np.int64)]
            own = np.array([int.from_bytes(k[:6], "little") for k in part.column("k").to_pylist()], np.int64)
            columns = [s[keep].view(np.int64), (own[of] % many).astype(np.int32), many.astype(np.int32), n[of], place[keep]]
            made = [*map(pa.array, columns), part.column("k").take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(made, names=["hash", "share", "shares", "n", "place", "k"])

    return run


def _passes(num: int, den: int, n: np.ndarray, place: np.ndarray, ranges: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs pass the length, positional and suffix filters."""
    na, nb = n[a], n[b]
    ok = (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & ((1 + np.minimum(na - place[a], nb - place[b]) - 1) * (num + den) >= num * (na + nb))
    at = np.flatnonzero(ok)
    for x in np.array_split(at, len(at) // 100_000 + 1):
        ok[x] = np.minimum(ranges[a[x]], ranges[b[x]]).sum(1, dtype=np.int64) * (num + den) >= num * (na[x] + nb[x])
    return ok


def _met(num: int, den: int, small: int, most: int):
    """Mapper over prefix rows in the order of (hash, share): pairs to verify first.

    Groups of more than ``small`` rows give near and central pairs only, here and where they are cut into blocks of about
    ``most`` rows; ``jaccard_classes`` joins their components afterwards.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        h, share, n, place = (t.column(c).to_numpy() for c in ("hash", "share", "n", "place"))
        ranges = np.frombuffer(b"".join(t.column("ranges").to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int32)
        begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (share[1:] != share[:-1])])
        sizes = np.diff(np.r_[begins, len(h)])
        left, right = [], []
        for size in np.unique(sizes[sizes <= small]):
            x, y = np.triu_indices(size, 1)
            at = begins[sizes == size][:, None]
            a, b = (at + x).ravel(), (at + y).ravel()
            ok = _passes(num, den, n, place, ranges, a, b)
            left.append(a[ok])
            right.append(b[ok])
        for first, size in zip(begins[sizes > small], sizes[sizes > small], strict=True):
            for at in range(first, first + size, BLOCK):
                m = np.arange(at, min(at + BLOCK, first + size))
                r = ranges[m]
                far = np.stack([np.abs(r - x).sum(1) for x in r])
                np.fill_diagonal(far, 1 << 30)
                near = np.argsort(far, 1, kind="stable")[:, :NEAREST]
                middle = int(np.abs(r - np.median(r, 0)).sum(1).argmin())
                a = np.r_[np.repeat(np.arange(len(m)), near.shape[1]), np.arange(len(m))]
                b = np.r_[near.ravel(), np.full(len(m), middle)]
                a, b = m[a[a != b]], m[b[a != b]]
                ok = _passes(num, den, n, place, ranges, a, b)
                left.append(a[ok])
                right.append(b[ok])
        k = t.column("k").combine_chunks()
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
        return pa.RecordBatch.from_arrays([k.take(pa.array(a)), k.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most:
                t = pa.Table.from_batches(held)
                h = t.column("hash").to_numpy()
                cut = int(np.searchsorted(h, h[-1], "left")) or (rows >= 4 * most) * rows  # a huge group goes in blocks
                if cut:
                    yield pairs(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), rows - cut
        if rows:
            yield pairs(pa.Table.from_batches(held))

    return run


def _verified(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 1 << 18, 128):
                na, nb, both = shared(unsqueezed(part.column("ta")), unsqueezed(part.column("tb")), words)
                ok = both * den >= num * (na + nb - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok)], names=["a", "b", "linked"])

    return run


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, small: int = SMALL, most: int = SHARE) -> DataFrame:
    """doc_id, k (a text's key), n_shingles, comp (the key of its component; null where it links with nothing else)."""
    spark = docs.sparkSession
    num, den = percent, 100
    docs = documents(docs).withColumn("k", F.unhex(F.md5("text")))
    spread = math.isqrt(docs.rdd.getNumPartitions()) + 1  # the number alone
    survey = stored(docs.select("k", "text").mapInArrow(_surveyed(words, spread), "k binary, n long, ranges binary, slice int, share int, counts binary"), "survey")
    kinds = "slice int, counts binary"
    sums = survey.where("slice is not null").select("slice", "share", "counts").groupBy("slice", "share").applyInArrow(_summed, kinds).groupBy("slice").applyInArrow(_summed, kinds)
    counts = spark.sparkContext.broadcast(b"".join(bytes(r.counts) for r in sorted(sums.collect())))  # BUCKETS numbers
    classes = survey.where("k is not null and n > 0").groupBy("k").agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))

    shape = "hash long not null, share int not null, shares int not null, n long not null, place long not null, k binary not null"
    dealt = docs.select("k", "text").mapInArrow(_prefixes(words, num, den, counts, most), shape).repartition("hash", "share")
    # The aggregation and the join both name every column, so that they read one shuffle; results do not rest on that.
    parts = dealt.groupBy("hash", "share").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("shares").alias("shares"), F.sum(F.col("n") % 2 + F.col("place") % 2).alias("_"))
    whole = Window.partitionBy("hash")
    parts = parts.where("(lo <> hi or shares > 1) and _ >= 0").select("hash", "share", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"))
    several = parts.where("lo <> hi").select("hash", "share")
    met = dealt.join(several, ["hash", "share"]).groupBy("hash", "share", "k").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.max("shares").alias("shares"))
    met = stored(met.join(classes.select("k", "ranges"), "k"), "met")
    pairs = met.repartition("hash", "share").sortWithinPartitions("hash", "share", F.xxhash64("k")).mapInArrow(_met(num, den, small, most), "a binary, b binary")

    texts = squeezed(docs.select("k", "text")).groupBy("k").agg(F.first("text").alias("z"))

    def verified(pairs: DataFrame) -> DataFrame:
        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sides = once.join(texts.select(F.col("k").alias("a"), F.col("z").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("z").alias("tb")), "b")
        return stored(sides.select("a", "b", "ta", "tb").mapInArrow(_verified(words, num, den), "a binary, b binary, linked boolean"), "verified")

    first = verified(pairs)
    label = components(first.where("linked"))
    # Groups that have not given all their pairs: large ones and those dealt in shares.
    big = met.groupBy("hash").agg(F.count("*").alias("n"), F.min("share").alias("lo"), F.max("share").alias("hi")).where((F.col("n") > small) | (F.col("lo") < F.col("hi")))
    big = stored(big.select("hash", "n"), "big")
    if not big.isEmpty():
        held = joined(met.drop("share", "shares").withColumnRenamed("n", "size"), big, "hash")
        known = held.join(label.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        known = stored(known.select("hash", "k", F.col("size").alias("n"), "place", "ranges", "comp"), "known")
        cross = known.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
        cross = stored(cross.select("hash", "n"), "cross")
        if not cross.isEmpty():
            across = joined(known.withColumnRenamed("n", "size"), cross, "hash").withColumnRenamed("size", "n")
            more = _across(across, num, den).join(first.select("a", "b"), ["a", "b"], "left_anti")
            label = components(first.where("linked").select("a", "b").union(verified(more).where("linked").select("a", "b")))
    found = classes.join(label.withColumnRenamed("node", "k"), "k", "left").select("k", F.col("n").alias("n_shingles"), F.coalesce("comp", "k").alias("comp"))
    copies = docs.groupBy("k").agg(F.count("*").alias("n"))
    one = stored(copies.join(found, "k"), "classes")  # exact copies are a hot key
    return joined(docs.select("doc_id", "k"), one, "k", how="left").select("doc_id", "k", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), "comp")


def _across(known: DataFrame, num: int, den: int, block: int = 2048) -> DataFrame:
    """Pairs of classes of two components that share a prefix shingle and pass the filters.

    The shorter text (by shingles, then key) has it in its index prefix; the longer one is at most den / num times as long,
    so it stands in the same length bucket or the next one. The longer ones of a bucket go in blocks of about ``block``.
    """
    width = math.log(den / num) if num < den else 1e-9
    known = stored(known.withColumn("bucket", F.floor(F.log("n") / width + 1e-6).cast("long")).withColumn("r", _unpacked("ranges")).drop("ranges"), "lengths")
    cells = known.groupBy("hash", "bucket").agg(F.count("*").alias("n"))
    cells = stored(cells.select("hash", "bucket", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    longer = joined(known.withColumnRenamed("n", "size"), cells, "hash", "bucket")
    longer = longer.withColumn("block", F.pmod(F.xxhash64("k"), "blocks").cast("int")).drop("blocks").withColumnRenamed("size", "n")
    index = known.where((F.col("n") - F.col("place")) * (num + den) >= 2 * num * F.col("n"))
    index = index.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    # As many rows of ``index`` may meet a cell as there are, so its count of them decides what is hot.
    seen = stored(index.groupBy("hash", "bucket").agg(F.count("*").alias("n")).join(cells.drop("n"), ["hash", "bucket"]), "seen")
    shorter = joined(index.withColumnRenamed("n", "size"), seen, "hash", "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumnRenamed("size", "n")
    a, b, c = shorter.alias("a"), longer.alias("b"), F.col
    need = num * (c("a.n") + c("b.n"))
    left = F.least(c("a.n") - c("a.place"), c("b.n") - c("b.place"))
    close = (c("a.n") * den >= c("b.n") * num) & (left * (num + den) >= need)
    order = (c("a.n") < c("b.n")) | ((c("a.n") == c("b.n")) & (c("a.k") < c("b.k")))
    overlap = F.aggregate(F.zip_with("a.r", "b.r", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    same = (c("a.hash") == c("b.hash")) & (c("a.bucket") == c("b.bucket")) & (c("a.block") == c("b.block"))
    met = a.join(b, same & order & (c("a.comp") != c("b.comp")) & close & (overlap * (num + den) >= need))
    return met.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b")).distinct()


def _unpacked(ranges: str) -> Column:
    """The range counts as array<int>."""
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.conv(F.hex(F.concat(F.substring(ranges, i * 2 + 2, F.lit(1)), F.substring(ranges, i * 2 + 1, F.lit(1)))), 16, 10).cast("int"))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, small: int = SMALL, most: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, a document's own included."""
    found = stored(jaccard_classes(docs, words, percent, small, most), "found")
    least = stored(found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
    return joined(found, least, "comp", how="left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)
