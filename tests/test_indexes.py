"""Ranked search and vector search read stored partitions only, and equal plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.engine import KnowledgeEngine
from kgspark.operators import retrieval
from kgspark.operators.search_index import SearchIndex
from kgspark.operators.vector_index import VectorIndex
from kgspark.operators.visibility import Principal


def bm25(rows, query):
    words = {(k, i): re.findall(r"[^\W_]+", (t or "").lower()) for k, i, t in rows}
    found = {}
    for kind in {k for k, _ in words}:
        own = {i: w for (k, i), w in words.items() if k == kind}
        mean = sum(map(len, own.values())) / len(own)
        for token in set(re.findall(r"[^\W_]+", query.lower())):
            df = sum(token in w for w in own.values())
            idf = math.log(1 + (len(own) - df + 0.5) / (df + 0.5))
            for i, w in own.items():
                tf = w.count(token)
                if tf:
                    found[kind, i] = found.get((kind, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {k: pytest.approx(s, abs=2e-6) for k, s in found.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = ["the", "the", "the", "ring", "Ärger", "bolt", "x1", "die", "über", "rest"]
    rows = [(rng.choice(["document", "term"]), f"d{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30)))) for i in range(200)]
    return [*rows, ("document", "n", None), ("document", "e", ""), ("term", "p", "Ring-the; (ring)!")]


def test_scores_equal_a_loop_and_only_the_words_partitions_are_read(spark, tmp_path, texts):
    index = SearchIndex.built(spark.createDataFrame(texts, "kind string, key string, text string"), f"file://{tmp_path}/ix", 16)
    for query in ("The RING?", "ärger", "nowhere", "", "x1 die x1"):
        got = {(r.kind, r.key): r.score for r in index.hits(query).collect()}
        assert got == bm25(texts, query)
    ranked = [(-r.score, r.kind, r.key) for r in index.ranked("the ring bolt").collect()]
    assert ranked == sorted(ranked)
    plan = index.hits("ring")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (IN|=)", plan) and "In(token" in plan or "EqualTo(token" in plan
    allowed = spark.createDataFrame([("d1",), ("d2",)], "key string")
    assert {r.key for r in index.ranked("the", seen={"document": allowed}, kinds=["document"]).collect()} <= {"d1", "d2"}


def unit(rng, n, width):
    v = rng.normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    v = unit(np.random.default_rng(3), 400, 12)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(60)]
    rows += [(5000, None), (5001, [0.0] * 12), (5002, [1.0]), (5003, [float("nan")] * 12)]
    path = f"file://{tmp_path_factory.mktemp('ix')}"
    return rows, VectorIndex.built(spark.createDataFrame(rows, "key long, v array<double>").repartition(4), path), path


def best(rows, q, k):
    scored = sorted(((-round(float(np.dot(v, q) / np.linalg.norm(v)), 6), key) for key, v in rows if v and len(v) == 12 and np.linalg.norm(v) > 0))
    return [(key, -s) for s, key in scored[:k]]


def test_all_cells_give_the_exact_result_with_ties(spark, vectors, monkeypatch):
    rows, index, _ = vectors
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "STEP", 16)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (0, 5, 9)], "query_id long, v array<double>")
    got = {}
    for r in index.nearest(asked, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, pytest.approx(r.score, abs=2e-6)))
    assert got == {i: best(rows, rows[i][1], 8) for i in (0, 5, 9)}
    assert index.stored().count() == 460


def test_a_single_question_reads_its_cells_only(vectors, spark):
    rows, index, path = vectors
    again = VectorIndex.opened(spark, path)
    assert len(again.centres) == len(index.centres) == 21
    got = again.nearest_to(rows[7][1], 3)
    assert [r.key for r in got.collect()] == [k for k, _ in best(rows, rows[7][1], 3)]
    plan = again.nearest_to(rows[7][1], 3, probe=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan)
    only = spark.createDataFrame([(3,), (4,)], "key long")
    assert {r.key for r in again.nearest_to(rows[7][1], 3, allowed=only).collect()} == {3, 4}
    r = index.recall(spark.createDataFrame([(i, rows[i][1]) for i in range(0, 400, 20)], "query_id long, v array<double>"), 5, 21).first()
    assert (r.recall, r.n) == (1.0, 100)


def test_added_rows_are_found(spark, tmp_path):
    v = unit(np.random.default_rng(5), 50, 4)
    frame = lambda at: spark.createDataFrame([(i, v[i].tolist()) for i in at], "key long, v array<double>")
    index = VectorIndex.built(frame(range(40)), f"file://{tmp_path}/ix")
    index.add(frame(range(40, 50)))
    assert [r.key for r in index.nearest_to(v[45].tolist(), 1).collect()] == [45]
    empty = VectorIndex.built(frame([]), f"file://{tmp_path}/none")
    assert empty.nearest_to([1.0] * 4, 3).collect() == []


def test_the_engine_s_retrieval_reads_stored_vectors(spark):
    vis = "is_public boolean, roles array<string>, teams array<string>, tenant string"
    docs = [(i, f"Title {i}", f"word{i} common text about thing{i % 3}", "en", "L1", "native", i % 2 == 0, None, None, None) for i in range(30)]
    documents = spark.createDataFrame(docs, f"id long, title string, text string, lang string, verification_level string, translation_state string, {vis}")
    entities = spark.createDataFrame([(1, "Ring", "tool", True, None, None, None), (2, "Ring hidden", "tool", False, None, None, None)], f"id long, label string, type string, {vis}")
    facts = spark.createDataFrame([("f1", "f1", 1, "p", "ring of gold", None, "valid", None, None, None, None)], f"id string, logical_id string, entity_id long, property string, value string, valid_to timestamp_ntz, status string, {vis}")
    engine = KnowledgeEngine(entities, facts, None, documents=documents)
    viewer = Principal("u", ("viewer",))
    engine.index_documents()
    found = engine.retrieve(viewer, "word4 thing1", "en", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "/cells" in plan and "sha2" not in plan  # no document is embedded for a question
    top = found.collect()
    assert top[0].id == 4 and all(r.id % 2 == 0 for r in top) and top[0].reason.startswith("cosine=")
    assert {(r.kind, r.key) for r in engine.search_ranked(viewer, "tool ring").collect()} == {("entity", "1"), ("fact", "f1")}
    assert [r.key for r in engine.search_ranked(viewer, "gold").collect()] == ["f1"]


def test_language_boost_and_reason(spark):
    rows = [(1, "en", "fr", ["b", "a", "", None, "b"]), (2, "fr", None, None), (3, "en", "", []), (4, "de", "en", ["z"])]
    docs = spark.createDataFrame(rows, "id int, lang string, source_lang string, terms array<string>").selectExpr("*", "'T' AS title", "'L2' AS verification_level", "0.5D AS cosine")
    boost = lambda lang: {r.id: re.search("boost_lang=([0-9.]+)", r.reason)[1] for r in retrieval.boosted(docs, "q", lang).collect()}
    assert boost("fr") == {1: "0.10", 2: "0.00", 3: "0.00", 4: "0.00"}
    for name in ("en", "ENG", "english"):
        assert {k: v for k, v in boost(name).items() if k != 4} == {1: "0.10", 2: "0.00", 3: "0.10"}
    assert set(boost("").values()) == {"0.00"}
    reasons = {r.id: r.reason for r in retrieval.boosted(docs, "q", "fr").collect()}
    assert reasons[1] == "cosine=0.5000 boost_lang=0.10 boost_verification=0.05 boost_title=0.00 final=0.5775 terms=a, b"
    assert reasons[2].endswith("terms=-") and reasons[3].endswith("terms=-")


def test_rows_of_shared_words_meet_as_sets(spark):
    """As many rows as there are: 4,000 of three sets of words, ranked as all pairs would be."""
    from kgspark.operators import retrieval

    sets = {0: ["a", "x"], 1: ["b", "x"], 2: ["c"]}
    rows = spark.createDataFrame([(i, sets[i % 3]) for i in range(4000)], "id long, words array<string>")
    got = retrieval.shared_words(rows.where("id IN (1, 2, 3999)"), rows, 3)
    by = {(r.query_id, r.rank): (r.target_id, r.score) for r in got.collect()}
    assert by == {(1, 1): (1, 2), (1, 2): (4, 2), (1, 3): (7, 2), (2, 1): (2, 1), (2, 2): (5, 1), (2, 3): (8, 1), (3999, 1): (0, 2), (3999, 2): (3, 2), (3999, 3): (6, 2)}


def test_passages_inside_words_and_odd_blanks(spark):
    """A passage may begin and end inside a word, have several blanks in a row, or be a word or nothing."""
    from kgspark.operators import retrieval

    docs = spark.createDataFrame([(1, "xone two  three\tfour five six sevenx"), (2, "a(one) b"), (3, None), (4, "")], "doc_id long, text string")
    texts = {1: "one two  three\tfour five six seven", 2: "one", 3: "one two  three", 4: "two three", 5: "", 6: None, 7: "x", 8: "a(one) b", 9: "two  three\tfour five six eight"}
    passages = spark.createDataFrame(list(texts.items()), "item_id long, passage string")
    got = sorted((r.item_id, r.doc_id) for r in retrieval.holding(passages, docs).distinct().collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (5, 1), (5, 2), (5, 4), (7, 1), (8, 2)]


def test_scores_take_bounded_memory(spark):
    """12,000 queries against 4,096 rows are 393 MB of scores at once; a few queries at a time give the same best rows."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from kgspark.operators import retrieval

    def batch(n: int, asks: bool) -> pa.RecordBatch:
        v = np.random.default_rng(n).normal(size=(n, 8))
        key, none = pa.array(np.arange(n)), pa.nulls(n, pa.int64())
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 8, v.ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), key if asks else none, none if asks else key, lists, pa.array([asks] * n)], names=["block", "query_id", "key", "v", "asks"])

    asked, rows = batch(12_000, True), batch(4096, False)
    tracemalloc.start()
    out = pa.Table.from_batches([*retrieval._best(1)(iter([asked, rows]))]).sort_by("query_id")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    q, r = [b.column("v").flatten().to_numpy().reshape(-1, 8) for b in (asked, rows)]
    assert out.column("key").to_pylist() == np.argmax(np.round(q @ r.T, 6), axis=1).tolist()


def test_copies_are_stored_once_and_all_found(spark, tmp_path):
    v = unit(np.random.default_rng(8), 12, 12).tolist()
    rows = [(i, v[i % 12]) for i in range(90)]
    own, others = rows[:12], [(i, i % 12) for i in range(12, 90)]
    VectorIndex.built(spark.createDataFrame(own, "key long, v array<double>"), f"file://{tmp_path}/ix", copies=spark.createDataFrame(others, "key long, of long"))
    index = VectorIndex.opened(spark, f"file://{tmp_path}/ix")
    assert index.stored().count() == 90 and spark.read.parquet(f"file://{tmp_path}/ix/cells").count() == 12
    for k in (1, 3, 20):
        got = {}
        for r in index.nearest_to_stored(index.keys().where("key % 10 = 0"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.key, pytest.approx(r.score, abs=2e-6)))
        assert got == {i: best(rows, rows[i][1], k) for i in range(0, 90, 10)}
    assert [r.key for r in index.nearest_to(v[5], 3).collect()] == [5, 17, 29]
    assert {r.key for r in index.nearest(spark.createDataFrame([(1, v[5])], "query_id long, v array<double>"), 3, 2).collect()} == {5, 17, 29}


def test_equal_names_are_embedded_and_kept_once(spark, tmp_path):
    from pathlib import Path

    from kgspark.plans.catalog import QUERIES
    from kgspark.sources.shared import shared_dir

    spark.createDataFrame([(i, f"red {'nut' if i % 2 else 'bolt'}") for i in range(300)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    folders = lambda: {*Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).glob("vectors-*")}
    were = folders()
    got = {}
    for r in QUERIES["retrieve_stored"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.score))
    assert got == {q: [(i, 1.0) for i in range(0, 10, 2)] for q in (0, 100, 200)}
    (made,) = folders() - were
    assert spark.read.parquet(f"file://{made}/cells").count() == 2
