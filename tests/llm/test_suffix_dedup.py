from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from kgspark.llm import suffix_dedup
from kgspark.llm import suffix_dedup as s

LAST = s.LAST


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by a table of all windows."""
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - s.SPAN + 1):
            w = b[i : i + s.SPAN]
            first[w] = min(first.get(w, LAST), LAST if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - s.SPAN + 1):
            if first[b[i : i + s.SPAN]] < (LAST if doc_id is None else doc_id):
                gone[i : i + s.SPAN] = b"\1" * s.SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id or 0, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), kept))
    return sorted(out)


def got(df, hot=s.HOT):
    return sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.removed(df, hot).collect())


@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_equals_brute_force(docs, hot):
    assert got(docs, hot) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_random_overlaps(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab \né") for _ in range(rng.randint(20, 90))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_classes_are_those_of_sorted_windows():
    rng = np.random.default_rng(1)
    lens = rng.integers(s.SPAN, 70, 200)
    rows = np.zeros((200, 70), np.uint8)
    for r, n in zip(rows, lens, strict=True):
        r[:n] = rng.integers(97, 99, n)
        r[: min(n, 55)] = rows[0][: min(n, 55)] if rng.random() < 0.5 else r[: min(n, 55)]
    ids = rng.permutation(200)
    first, least = s.suffix_classes(rows, lens, ids)
    want = {}
    for r, n, i in zip(rows, lens, ids, strict=True):
        for a in range(n - s.SPAN + 1):
            w = r[a : a + s.SPAN].tobytes()
            want[w] = min(want.get(w, 999), i)
    for r, n, at in zip(rows, lens, first, strict=True):
        assert [want[r[a : a + s.SPAN].tobytes()] for a in range(n - s.SPAN + 1)] == least[at : at + n - s.SPAN + 1].tolist()


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(nothing) == []


def test_contexts_of_a_hot_key_are_not_held():
    read = 0

    def batches():
        nonlocal read
        for i in range(50):
            read += 1
            n = 1000
            yield pa.RecordBatch.from_pydict(
                {"key": [7] * n, "bytes": [b"x" * 60] * n, "id": list(range(n)), "k1": [i] * n, "start": [0] * n, "hot": [True] * n},
                schema=pa.schema([("key", pa.int64()), ("bytes", pa.binary()), *((c, pa.int64()) for c in ("id", "k1", "start")), ("hot", pa.bool_())]),
            )

    out = s._sorted(batches())
    assert next(out).num_rows == 1000 and read == 1
    assert sum(b.num_rows for b in out) == 49_000


def test_texts_that_share_a_hash_get_other_seeds(spark, monkeypatch):
    """A hash of two values only: no seed tells three texts apart by it, and with it and their ids only some do."""
    from pyspark.sql import functions as F

    real, seeds = F.xxhash64, []

    def weak(*columns):
        if columns[-1] == "text" and len(columns) == 2:
            seeds.append(columns[0])
            return F.pmod(real(*columns), F.lit(2 if len(seeds) % 2 else 1 << 40))
        return real(*columns)

    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "a", 4)], "doc_id long, text string, own long")
    monkeypatch.setattr(suffix_dedup.F, "xxhash64", weak)
    named = suffix_dedup._named(df)
    assert len(seeds) == 10  # four seeds ask for k1 alone; the fifth for k1 and the smallest id
    assert named.select("k1", "k2").distinct().count() == 3
