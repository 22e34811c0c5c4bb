"""Rows in their order, and small aggregates, at their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.operators import entities, evaluation, mining, packs, retrieval, sequences


def test_carried_in_sequence_and_paired(spark):
    rows = [("a", 0, "h1", "u"), ("a", 1, None, "v"), ("a", 3, "h2", "u"), ("b", 0, None, "v"), ("b", 0, None, "w")]
    df = spark.createDataFrame(rows, "doc string, nth int, head string, side string")
    got = df.where("doc = 'a'").select("nth", sequences.carried(F.col("head"), "doc", "nth").alias("h"), sequences.in_sequence("doc", "nth").alias("ok")).collect()
    assert [tuple(r) for r in sorted(got)] == [(0, "h1", True), (1, "h1", True), (3, "h2", False)]
    assert sorted(r[0] for r in df.where("doc = 'b'").select(sequences.in_sequence("doc", "nth")).collect()) == [False, True]
    pairs = sequences.paired(df.where("side = 'u'"), df.where("side <> 'u'"), "doc", "side", "nth").collect()
    assert [tuple(r) for r in pairs] == [("a", 0, 1, 1)]


def test_terms_of_several_words_are_contained(spark):
    names = spark.createDataFrame([("1", "red bell pepper"), ("2", "pepperoni"), ("3", "pepper"), ("4", None)], "id string, name string")
    terms = spark.createDataFrame([("t1", "bell pepper"), ("t2", "pepper")], "id string, term string")
    assert sorted(map(tuple, mining.contained(names, terms).collect())) == [("1", "t1"), ("1", "t2")]
    rows = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("y", None)], "term string, alias string")
    assert sorted((r.term, r.frequency, r.aliases) for r in mining.merged(rows, "term", "alias").collect()) == [("x", 3, ["a", "b"]), ("y", 1, [])]


def test_changes_between_versions(spark):
    old = spark.createDataFrame([("same", "1"), ("null", None), ("gone", None), ("new value", "1"), ("to null", "1")], "k string, v string")
    new = spark.createDataFrame([("same", "1"), ("null", None), ("here", None), ("new value", "2"), ("to null", None)], "k string, v string")
    assert dict(map(tuple, packs.changelog(old, new, "k", "v").collect())) == {"gone": "removed", "here": "added", "new value": "changed", "to null": "changed"}
    cache = spark.createDataFrame([("a", "1"), ("b", "0")], "k string, digest string")
    assert sorted(r.k for r in entities.unseen(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, digest string"), cache, "k").collect()) == ["b", "c"]


def test_coverage_without_rows_or_resolved_ones(spark):
    df = spark.createDataFrame([(None,), (1,), (0,), (None,)], "q int")
    of = lambda rows: tuple(evaluation.coverage(rows, F.col("q").isNotNull(), F.col("q") == 1).first())
    assert of(df) == (2, 4, 0.5, 0.5) and of(df.where("q IS NULL")) == (0, 2, 0.0, 1.0) and of(df.limit(0)) == (0, 0, None, 1.0)


def test_norms_are_computed_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, []), (4, [0.0]), (5, [float("nan")]), (6, [float("inf")]), (7, [1.0, None])], "key int, v array<double>")
    unit = retrieval.normalized(df)
    assert [(r.key, r.v) for r in unit.where("key < 7").collect()] == [(1, [0.6, 0.8])]
    plan = unit._jdf.queryExecution().optimizedPlan().toString().split("Filter")[0]
    assert plan.count("SQRT") == 1  # outside the lambda over the components


def test_tasks_of_documents_by_entity_follow_the_input(spark, sf, monkeypatch):
    from kgspark.plans import retrieval_queries

    few = retrieval_queries.documents_by_entity(spark, sf)
    monkeypatch.setattr(retrieval_queries, "TASK_ROWS", 100)
    many = retrieval_queries.documents_by_entity(spark, sf)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert n > 4 and many._jdf.queryExecution().optimizedPlan().toString().count(f"{n}") >= 2
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
