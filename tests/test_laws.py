"""Laws of the fact store, visibility and propagation, on small tables."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from kgspark.operators import conflicts, facts, relations, truth
from kgspark.operators.visibility import Principal, visible_rows, with_parent
from kgspark.sources import graph as g



def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def fact(spark, sf):
    return g.facts(spark, sf).persist()


def intervals(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.logical_id, []).append((r.valid_from, r.valid_to, r.status))
    return by


def test_versions_never_overlap(fact):
    change = facts.current(fact).where("entity_id % 2 = 0").select("logical_id", F.lit("new").alias("value"))
    for table in (fact, facts.update(fact, change, now())):
        for rows in intervals(table).values():
            rows.sort()
            assert sum(to is None for _, to, _ in rows) == 1
            assert all(a[1] == b[0] for a, b in itertools.pairwise(rows))
            assert all((to is None) == (status == "valid") for _, to, status in rows)


def test_updates_are_idempotent_and_nulls_are_values(spark, fact):
    change = facts.current(fact).limit(5).select("logical_id", F.lit("new").alias("value"))
    once = facts.update(fact, change, now())
    assert once.count() == fact.count() + 5
    assert facts.update(once, change, now()).count() == once.count()
    assert facts.update(fact, change.withColumn("value", F.lit(None).cast("string")), now()).count() == fact.count() + 5


def test_invalidation_leaves_no_open_version(fact):
    ids = fact.where("entity_id = 3").select("logical_id")
    left = facts.invalidate(fact, ids, now())
    assert left.count() == fact.count()
    assert left.where("entity_id = 3 AND valid_to IS NULL").count() == 0


def test_as_of_gives_one_version_at_most(fact):
    at = facts.as_of(fact, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    assert at.groupBy("logical_id").count().where("count > 1").count() == 0


def test_visibility_is_monotonic(spark, sf, fact):
    rows = with_parent(fact, g.entities(spark, sf))
    seen = {}
    for name, p in {
        "nobody": Principal(tenant="t1"),
        "viewer": Principal("u", ("viewer",), (), "t1"),
        "member": Principal("u", ("viewer",), ("team_2",), "t1"),
        "admin": Principal("a", ("admin",)),
    }.items():
        seen[name] = {r.id for r in visible_rows(rows, p).select("id").collect()}
    assert seen["nobody"] <= seen["viewer"] <= seen["member"] < seen["admin"]
    assert len(seen["admin"]) == fact.count()


def test_explicit_values_are_not_inherited(spark):
    e = spark.createDataFrame([("e", True, ["viewer"], ["x"], "t1")], "id string, is_public boolean, roles array<string>, teams array<string>, tenant string")
    f = spark.createDataFrame([("f1", "e", None), ("f2", "e", False), ("f3", "gone", True)], "id string, entity_id string, is_public boolean")
    got = {r.id: r.is_public for r in with_parent(f, e).collect()}
    assert got == {"f1": True, "f2": False, "f3": True}
    other = visible_rows(with_parent(f, e), Principal("u", (), (), "t2"))
    assert {r.id for r in other.collect()} == {"f3"}


def test_propagation_is_monotonic_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("c", "a")], "child string, parent string")
    roots = spark.createDataFrame([("a",)], "logical_id string")
    got = {n: {r.logical_id: r.depth for r in truth.propagate(roots, edges, n).collect()} for n in range(4)}
    assert got == {0: {}, 1: {"b": 1, "c": 1}, 2: {"b": 1, "c": 1, "d": 2}, 3: {"b": 1, "c": 1, "d": 2}}
    with pytest.raises(ValueError):
        truth.propagate(roots, edges, 11)


def test_conflicts_are_reported_once(spark, fact, sf):
    found = conflicts.pairs(conflicts.candidates(fact, g.sources(spark, sf))).persist()
    assert found.where("source_id_a >= source_id_b OR value_a = value_b").count() == 0
    assert conflicts.unreported(found, found.withColumn("status", F.lit("pending"))).count() == 0
    assert conflicts.unreported(found, found.withColumn("status", F.lit("rejected"))).count() == found.count()


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, relations.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
