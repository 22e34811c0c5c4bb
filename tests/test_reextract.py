"""A changed glossary touches the documents that hold its words, and these alone."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kgspark.operators import curator, facts, fact_store, reextract

ALIAS = "alias string, entry_id string"


def at(day):
    return F.lit(f"2030-01-{day:02} 00:00:00").cast("timestamp_ntz")


def entry(item, aliases):
    """The longest alias that an item holds as whole words, by a loop."""
    words = (item or "").lower().split()
    held = [(-len(a), a, e) for a, e in aliases if any(words[i : i + len(a.split())] == a.split() for i in range(len(words)))]
    return min(held)[2] if held else None


def test_approval_rollback_and_approval_again(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"d{n}", p, " ".join(rng.choices(["Red", "bell", "pepper", "salt", "oil"], k=rng.randint(1, 4)))) for n in range(40) for p in range(3)]
    rows += [("n", 0, None), ("n", 1, ""), ("d0", 0, rows[0][2]), ("far", 0, "flour"), ("far", 1, "rye flour")]
    items = spark.createDataFrame(rows, "document_id string, pos int, item string")
    old = [("pepper", "ING-PEPPER"), ("salt", "ING-SALT"), ("flour", "ING-FLOUR")]
    before = spark.createDataFrame(old, ALIAS)
    store = fact_store.FactStore.created(reextract.first_facts(items, before, at(1)), f"file://{tmp_path}/s", 8)
    index = reextract.indexed(items, f"file://{tmp_path}/ix")
    proposed = spark.createDataFrame([("bell pepper", "ING-BELL", "approved"), ("oil", "ING-OIL", "pending")], "term string, entry_id string, status string")
    after = curator.applied(before, proposed)

    def held():
        return {r.entity_id: r.value for r in facts.current(store.read()).collect()}

    def want(aliases):
        return {f"{d}:item:{p}": entry(t, aliases) for d, p, t in rows if entry(t, aliases)}

    assert held() == want(old)
    report = {r.document_id: r for r in reextract.reextract(store, index, items, before, after, at(2), "c").collect()}
    new = [*old, ("bell pepper", "ING-BELL")]
    assert held() == want(new)
    touched = {d for d, _, t in rows if "bell" in (t or "").split()} | {d for d, _, t in rows if "pepper" in (t or "").split()}
    assert set(report) <= touched and "far" not in report
    changed = {k for k in want(old).keys() | want(new).keys() if want(old).get(k) != want(new).get(k)}
    assert sum(r.n_created + r.n_versions for r in report.values()) == len(changed) and not any(r.n_refused or r.n_invalidated for r in report.values())
    n = store.read().count()
    assert n == len(want(old)) + len(changed)
    # The same call again finds nothing that is left to do.
    again = reextract.reextract(store, index, items, before, after, at(3)).collect()
    assert not any(r.n_created or r.n_versions or r.n_invalidated for r in again) and store.read().count() == n
    reextract.reextract(store, index, items, after, before, at(4)).collect()
    assert held() == want(old)
    # An alias that goes leaves closed facts, which come back as versions of their own.
    none = before.where("alias <> 'salt'")
    reextract.reextract(store, index, items, before, none, at(5)).collect()
    assert held() == want([a for a in old if a[0] != "salt"])
    reextract.reextract(store, index, items, none, before, at(6)).collect()
    assert held() == want(old)
    assert {r.change_type for r in store.versions().collect()} == {"create", "update", "invalidate"}


def test_partitions_without_a_difference_keep_their_files(spark, tmp_path):
    items = spark.createDataFrame([(f"d{i}", 0, "salt" if i else "sea salt") for i in range(60)], "document_id string, pos int, item string")
    before = spark.createDataFrame([("salt", "ING-SALT")], ALIAS)
    store = fact_store.FactStore.created(reextract.first_facts(items, before, at(1)), f"file://{tmp_path}/s", 8)
    index = reextract.indexed(items, f"file://{tmp_path}/ix")
    names = lambda: {f.relative_to(tmp_path) for f in (tmp_path / "s/facts").rglob("*.parquet")}
    was = names()
    after = before.union(spark.createDataFrame([("sea salt", "ING-SEA")], ALIAS))
    report = reextract.reextract(store, index, items, before, after, at(2)).collect()
    assert [(r.document_id, r.n_versions) for r in report] == [("d0", 1)]
    assert len({f.parts[2] for f in was ^ names()}) == 1


def test_two_texts_at_one_place_are_refused(spark, tmp_path):
    items = spark.createDataFrame([("d", 0, "oil"), ("d", 0, "salt"), ("e", 0, "salt")], "document_id string, pos int, item string")
    before = spark.createDataFrame([("salt", "S")], ALIAS)
    store = fact_store.FactStore.created(reextract.first_facts(items.where("document_id = 'e'"), before, at(1)), f"file://{tmp_path}/s", 4)
    after = before.union(spark.createDataFrame([("oil", "O")], ALIAS))
    (r,) = reextract.reextract(store, reextract.indexed(items, f"file://{tmp_path}/ix"), items, before, after, at(2)).collect()
    assert (r.document_id, r.n_refused, r.n_created) == ("d", 2, 0) and store.read().count() == 1


def test_a_phrase_with_an_unknown_word_has_no_candidates(spark, tmp_path):
    items = spark.createDataFrame([("d", 0, "fine sea salt"), ("e", 0, "salt")], "document_id string, pos int, item string")
    index = reextract.indexed(items, f"file://{tmp_path}/ix")
    keys = lambda *phrases: sorted(r.key for r in index.candidates(spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect())
    assert keys("sea salt") == ["d"] and keys("salt") == ["d", "e"] and keys("sea weed") == [] and keys("", "!") == []
    assert reextract.difference(spark.createDataFrame([("A ", "1"), ("b", "2")], ALIAS), spark.createDataFrame([("a", "1"), ("b", "3")], ALIAS)).collect()[0].alias == "b"


def test_what_is_indexed_and_staged_follows_what_differs(spark, tmp_path):
    """Equal items are indexed once, and a write stages no facts that stay as they are."""
    from pathlib import Path

    from kgspark.sources.shared import shared_dir

    items = spark.createDataFrame([(f"d{i}", 0, "salt" if i else "sea salt") for i in range(400)], "document_id string, pos int, item string")
    before = spark.createDataFrame([("salt", "ING-SALT")], ALIAS)
    store = fact_store.FactStore.created(reextract.first_facts(items, before, at(1)), f"file://{tmp_path}/s", 1)
    index = reextract.indexed(items, f"file://{tmp_path}/ix")
    assert spark.read.parquet(f"file://{tmp_path}/ix/counts").count() == 5
    tables = lambda: {*Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).glob("table-*")}
    were = tables()
    after = before.union(spark.createDataFrame([("sea salt", "ING-SEA")], ALIAS))
    report = reextract.reextract(store, index, items, before, after, at(2)).collect()
    assert [(r.document_id, r.n_versions) for r in report] == [("d0", 1)] and store.read().count() == 401
    assert sum(spark.read.parquet(f"file://{t}").count() for t in tables() - were) < 40


def test_a_place_that_is_set_and_emptied_at_once_is_closed(spark, tmp_path):
    items = spark.createDataFrame([("d", 0, "salt"), ("d", 0, "water"), ("e", 0, "salt")], "document_id string, pos int, item string")
    before, after = [spark.createDataFrame([("salt", e)], ALIAS) for e in "ST"]
    store = fact_store.FactStore.created(reextract.first_facts(items, before, at(1)), f"file://{tmp_path}/s", 4)
    report = reextract.reextract(store, reextract.indexed(items, f"file://{tmp_path}/ix"), items, before, after, at(2)).collect()
    assert {r.document_id: (r.n_versions, r.n_invalidated) for r in report} == {"d": (1, 1), "e": (1, 0)}
    assert sorted((r.entity_id, r.value, r.status) for r in store.read().collect()) == [("d:item:0", "S", "obsolete"), ("d:item:0", "T", "obsolete"), ("e:item:0", "S", "obsolete"), ("e:item:0", "T", "valid")]
    ids = {r.id: r.value for r in store.read().collect()}
    assert sorted((r.change_type, ids[r.fact_id]) for r in store.versions().collect()) == [("invalidate", "T"), ("update", "T"), ("update", "T")]
