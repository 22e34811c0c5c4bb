from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kgspark.operators import accounts, conflicts, curator, entities, retrieval
from kgspark.operators.visibility import Principal, patched, visible_rows, with_parent


def test_all_four_dimensions_inherit_one_by_one(spark):
    e = spark.createDataFrame([(1, False, ["viewer"], ["x"], "t1")], "id int, is_public boolean, roles array<string>, teams array<string>, tenant string")
    schema = "id int, entity_id int, is_public boolean, roles array<string>, teams array<string>, tenant string"
    rows = [(1, 1, None, None, None, None), (2, 1, True, [], None, None), (3, 1, None, [], ["y"], "t2"), (4, 9, True, None, None, None), (5, 1, False, [], [], None)]
    got = {r.id: (r.is_public, r.roles, r.teams, r.tenant) for r in with_parent(spark.createDataFrame(rows, schema), e).collect()}
    assert got == {1: (False, ["viewer"], ["x"], "t1"), 2: (True, [], ["x"], "t1"), 3: (False, [], ["y"], "t2"), 4: (True, None, None, None), 5: (False, [], [], "t1")}
    seen = visible_rows(with_parent(spark.createDataFrame(rows, schema), e), Principal("u", ("viewer",), (), "t1"))
    assert sorted(r.id for r in seen.collect()) == [1, 2, 4]


def test_a_patch_can_unset(spark):
    e = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "id int, label string, tenant string")
    p = spark.createDataFrame([(1, None, None, ["tenant"]), (2, "c", "u", None)], "id int, label string, tenant string, unset array<string>")
    assert sorted(map(tuple, patched(e, p, "id", "label", "tenant").collect())) == [(1, "a", None), (2, "c", "u")]


FACT = "id string, entity_id string, property string, value string, source_id string, confidence string, status string, valid_to timestamp_ntz"


def fact(i, value, source, confidence="EXTRACTED", status="valid"):
    return (f"f{i}", "e", "p", value, source, confidence, status, None)


@pytest.mark.parametrize(
    ("a", "b", "times", "want"),
    [
        ("EXTRACTED", "INFERRED", (1, 9), ("a", "higher confidence (EXTRACTED > INFERRED)")),
        ("AMBIGUOUS", "INFERRED", (9, 1), ("b", "higher confidence (INFERRED > AMBIGUOUS)")),
        ("EXTRACTED", "EXTRACTED", (9, 1), ("a", "more recent source")),
        ("EXTRACTED", "EXTRACTED", (5, None), ("a", "more recent source")),
        ("EXTRACTED", "EXTRACTED", (None, 5), ("b", "more recent source")),
        ("EXTRACTED", "EXTRACTED", (None, None), ("b", "sources equally recent (tie-break b)")),
    ],
)
def test_the_suggested_side_and_its_reason(spark, a, b, times, want):
    facts = spark.createDataFrame([fact(1, "x", "s1", a), fact(2, "y", "s2", b)], FACT)
    sources = spark.createDataFrame([(s, None if t is None else dt.datetime(2024, 1, t)) for s, t in zip(("s1", "s2"), times, strict=True)], "id string, ingested_at timestamp_ntz")
    r = conflicts.pairs(conflicts.candidates(facts, sources)).first()
    assert (r.suggestion, r.reason) == want


def test_a_pair_of_other_sources_is_new(spark):
    facts = spark.createDataFrame([fact(1, "x", "s1"), fact(2, "y", "s2"), fact(3, "y", "s3"), fact(4, "z", "s4", status="under_review")], FACT)
    found = conflicts.pairs(conflicts.candidates(facts, spark.createDataFrame([], "id string, ingested_at timestamp_ntz")))
    assert found.count() == 2
    known = spark.createDataFrame([("e", "p", "y", "x", "s2", "s1", "pending"), ("e", "p", "x", "y", "s1", "s3", "approved")], "entity_id string, property string, value_a string, value_b string, source_id_a string, source_id_b string, status string")
    assert [(r.source_id_a, r.source_id_b) for r in conflicts.unreported(found, known).collect()] == [("s1", "s3")]


ALIASES = [("mandorle", "ING-1"), ("Mandorle dolci", "ING-2"), ("oro", "STA-1")]


def test_the_longest_whole_alias_is_extended(spark):
    aliases = spark.createDataFrame(ALIASES, "alias string, entry_id string")
    terms = spark.createDataFrame([("mandorle dolci sbucciate",), ("MANDORLE",), ("pomodoro",), ("foglia oro",)], "term string")
    assert sorted((r.term, r.alias, r.entry_id) for r in curator.modifiers(terms, aliases).collect()) == [("foglia oro", "oro", "STA-1"), ("mandorle dolci sbucciate", "mandorle dolci", "ING-2")]


def test_proposals_extend_or_add_and_only_approved_ones_apply(spark):
    aliases = spark.createDataFrame(ALIASES, "alias string, entry_id string")
    entries = spark.createDataFrame([("ING-1", "ingredienti"), ("ING-2", "ingredienti"), ("STA-1", "stati"), ("ING-SALE", "ingredienti"), ("ING-SALE-2", "ingredienti")], "entry_id string, namespace string")
    found = spark.createDataFrame([("i1", "foglia oro", ""), ("i2", "sale", ""), ("i3", "pepe", "")], "issue_id string, term string, note string")
    made = curator.proposals(found, entries, aliases)
    assert {r.term: (r.kind, r.entry_id, r.namespace) for r in made.collect()} == {"foglia oro": ("add_alias", "STA-1", "stati"), "sale": ("add_entry", "ING-SALE-3", "ingredienti"), "pepe": ("add_entry", "ING-PEPE", "ingredienti")}
    decided = made.withColumn("status", F.when(F.col("term") == "pepe", "approved").otherwise("pending"))
    assert curator.applied(aliases, decided).count() == 4


def test_entities_are_inserted_once_and_sources_merged(spark):
    e = spark.createDataFrame([(1, "a")], "id int, label string")
    after, refused = entities.inserted(e, spark.createDataFrame([(1, "x"), (2, "b"), (2, "c")], "id int, label string"))
    assert sorted(r.id for r in after.collect()) == [1, 2]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(1, "exists"), (2, "repeated")]
    t = lambda d: dt.datetime(2024, 1, d)
    held = spark.createDataFrame([("s1", "a.md", t(5)), ("s2", "b.md", t(1))], "id string, uri string, ingested_at timestamp_ntz")
    batch = spark.createDataFrame([("s1", None, t(3)), ("s3", "c.md", t(2)), ("s3", "d.md", t(4))], "id string, uri string, ingested_at timestamp_ntz")
    assert sorted(map(tuple, entities.sources_upserted(held, batch).collect())) == [("s1", "a.md", t(5)), ("s2", "b.md", t(1)), ("s3", "d.md", t(4))]


def test_roles_come_from_users_and_teams_and_changes_are_audited(spark):
    own = spark.createDataFrame([(1, "viewer"), (2, "editor")], "user_id int, role string")
    teams, roles = spark.createDataFrame([(1, "x"), (1, "y"), (3, "x")], "user_id int, team string"), spark.createDataFrame([("x", "viewer"), ("y", "curator")], "team string, role string")
    assert sorted(map(tuple, accounts.effective_roles(own, roles, teams).collect())) == [(1, "curator"), (1, "viewer"), (2, "editor"), (3, "viewer")]
    users = spark.createDataFrame([(1, True), (2, True), (3, False)], "user_id int, active boolean")
    assert {r.user_id: (r.roles, r.teams) for r in accounts.with_roles(accounts.active(users), own, teams).collect()} == {1: (["viewer"], ["x", "y"]), 2: (["editor"], [])}
    after, audit = accounts.changed(users, spark.createDataFrame([(1, False), (3, False), (9, True)], "user_id int, active boolean"), "admin", F.lit("2030-01-01").cast("timestamp_ntz"))
    assert {r.user_id: r.active for r in after.collect()} == {1: False, 2: True, 3: False}
    assert [(r.entity_id, r.old_value, r.new_value) for r in audit.collect()] == [("1", '{"active":true}', '{"active":false}')]


def test_vectors_are_made_for_new_and_changed_texts_only(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "four")], "id int, text string")
    idf = spark.createDataFrame([], "token string, idf double")
    none = spark.createDataFrame([], "id int, digest string, buckets array<struct<bucket:int,weight:double>>")
    store = retrieval.backfilled(none, docs, idf)
    assert store.count() == 3 and all(len(r.buckets) > 0 for r in store.collect())
    assert retrieval.to_embed(docs, store).count() == 0
    changed = docs.where("id <> 3").withColumn("text", F.when(F.col("id") == 2, "five six").otherwise(F.col("text")))
    assert [r.id for r in retrieval.to_embed(changed, store).collect()] == [2]
    assert retrieval.backfilled(store, changed, idf).count() == 3
