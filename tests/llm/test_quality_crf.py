from __future__ import annotations

import itertools

import numpy as np

from kgspark.llm import quality_crf as q


def test_marginals_are_those_of_all_labelings():
    rng = np.random.default_rng(2)
    doc = np.array([0] * 5 + [1] + [2] * 3)
    score, move = rng.normal(size=9), rng.normal(size=(2, 2))
    good, pairs = q.marginals(score, move, doc)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, want, moves = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            p = np.exp(sum(score[i] * v for i, v in zip(at, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y)))
            total += p
            want += p * np.array(y)
            for a, b in itertools.pairwise(y):
                moves[a, b] += p
        assert np.allclose(good[at], want / total)
        assert np.allclose(pairs[at].sum(0), moves / total)


def test_the_gradient_is_that_of_the_likelihood_over_all_labelings():
    rng = np.random.default_rng(4)
    doc = np.array([0] * 4 + [1] * 2 + [2])
    bins = rng.integers(0, q.BINS, (7, q.N)).astype(np.uint8)
    cols, label = q._columns(bins, doc), rng.integers(0, 2, 7).astype(float)
    w, move = rng.normal(size=q.WIDTH) / 5, rng.normal(size=(2, 2))

    def likelihood(w, move):
        score, out = w[cols].sum(1), 0.0
        for d in range(3):
            at = np.flatnonzero(doc == d)
            value = lambda y: sum(score[i] * v for i, v in zip(at, y, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(y))
            out += value(label[at].astype(int)) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=len(at))))
        return out

    by_w, by_move = q.gradient(w, move, cols, doc, q.seen(cols, doc, label))
    step = 1e-5
    for i in np.unique(cols)[::5]:
        e = np.zeros(q.WIDTH)
        e[i] = step
        assert np.isclose((likelihood(w + e, move) - likelihood(w - e, move)) / (2 * step), by_w[i], atol=1e-6)
    for a, b in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = step
        assert np.isclose((likelihood(w, move + e) - likelihood(w, move - e)) / (2 * step), by_move[a, b], atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op9_quality_crf(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(labels) > 50
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) >= 0.95


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (6, 1), (9, 0), (None, 1), (4, 0), (77, 0)], "doc_id long, quality int")
    model = q.train(odd, labels)
    rows = q.scored(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in rows)
    assert q.scored(nothing, model).collect() == []
    assert q.train(nothing, labels) is None
    assert {r.score for r in q.scored(odd, None).collect()} == {0.5}
