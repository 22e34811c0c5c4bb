from __future__ import annotations

import math
import random

import numpy as np
import pytest

from kgspark.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """All rows of the query's result, by plain loops over integers."""
    whole = []
    for vec_id, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        whole.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    found = []
    for a, label, q in whole:
        if a is None or a % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(q, r, strict=False)), b, other) for b, other, r in whole if b != a), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            found += [(a, p, i, b, ps, s) for i, (s, b, _) in enumerate(fit, 1)]
    return sorted(found, key=repr)


def got(df, **kw):
    rows = hard.vectors(df)
    rows = rows.selectExpr("vec_id", "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", "q")
    return sorted((tuple(r) for r in hard.hard_negatives(rows, rows.where("vec_id % 100 = 0"), **kw).collect()), key=repr)


def random_rows(seed, n, width=24, labels=3, every=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    return [(i * every, (centres[i % labels] + rng.normal(size=width)).astype(np.float32).tolist(), i % labels) for i in range(n)]


@pytest.mark.parametrize("block", [(8192, 65_536), (7, 50)])
def test_equals_brute_force(spark, block):
    rows = random_rows(1, 700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(df, block=block) == brute(rows)


def test_the_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert sorted((tuple(r) for r in hard.op11_hard_negatives(spark, sf).collect()), key=repr) == want


def test_a_hot_vector_and_ties(spark):
    rng = random.Random(2)
    rows = random_rows(3, 300, 8)
    rows += [(10_000 + i, rows[0][1], rng.randrange(3)) for i in range(2000)] + [(50_000 + 100 * i, rows[1][1], 1) for i in range(20)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_nulls_lengths_and_rows_that_take_no_part(spark):
    rows = random_rows(4, 120, 6, every=10)
    rows += [(101, None, 1), (102, [1.0] * 6, None), (103, [None] + [1.0] * 5, 1), (104, [float("nan")] * 6, 1), (105, [float("inf")] + [0.5] * 5, 1), (200, None, 1)]
    rows += [(None, [0.9] * 6, 1), (None, [0.9] * 6, 2), (106, [], 1), (300_000, [], 0), (107, [0.5, 0.25], 0), (108, [0.0] * 6, 2), (300_100, [0.0] * 6, 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS anchor", "'x' AS cell", "'x' AS w", "'x' AS q", "'x' AS rank")
    assert got(df) == brute(rows)


def test_repeated_anchors_have_results_of_their_own(spark):
    rows = random_rows(6, 60, 6, every=10)
    once, twice = got(spark.createDataFrame(rows, SCHEMA)), got(spark.createDataFrame([*rows, rows[0]], SCHEMA))
    assert sorted([r for r in twice if r[0] == 0], key=repr) == sorted([r for r in once if r[0] == 0] * 2, key=repr)


def test_an_empty_table_and_a_single_row(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i * 20, [float(np.float32(rng.uniform(-1, 1) * 2.0**20)) for _ in range(5)], i % 2) for i in range(80)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_the_bounds_discard_pairs_before_all_components():
    """Leading components decide: few pairs are left for the integer products."""
    rng = np.random.default_rng(5)
    q = np.rint(rng.normal(size=(2000, 32)) * 200 * 0.7 ** np.arange(32)).astype(np.int64)
    cell = hard._Cell(np.eye(32), 5, True)
    import pyarrow as pa

    def batch(ids, extra):
        columns = {"vec_id": pa.array(ids), "label": pa.array([1] * len(ids)), "q": pa.array(q[ids].tolist(), pa.list_(pa.int64()))} | extra
        return pa.RecordBatch.from_pydict(columns)

    ids = list(range(50))
    cell.add(batch(ids, {"anchor": pa.array(ids), "lows": pa.array([[-(1 << 63)]] * 50), "highs": pa.array([[(1 << 63) - 1]] * 50)}))
    cell.ready()
    seen = []
    real = cell._verified
    cell._verified = lambda i, *a: seen.append(len(i)) or real(i, *a)
    for at in range(0, 2000, 100):
        cell.meet(batch(list(range(at, at + 100)), {}))
    found = cell.found()
    assert sum(seen) < 0.2 * 50 * 2000
    want = np.sort(np.where(np.eye(50, 2000, dtype=bool), -(1 << 60), q[:50] @ q.T), 1)[:, ::-1][:, :5]
    assert sorted(zip(found["anchor"].to_pylist(), found["score"].to_pylist(), strict=True)) == sorted((i, int(s)) for i in range(50) for s in want[i])
