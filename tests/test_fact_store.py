"""Writes of touched partitions, interval joins and conflict classes against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import conflicts, fact_store, facts, intervals

FACT = "id string, logical_id string, entity_id string, property string, value string, source_id string, confidence string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"
CHANGE = "logical_id string, value string, status string, entity_id string, property string, author_id string"


def now(day=1):
    return F.lit(f"2030-01-{day:02} 00:00:00").cast("timestamp_ntz")


def fact(n, value, **kw):
    row = dict(id=f"{n}@1", logical_id=n, entity_id="e", property="p", value=value, source_id="s", confidence="EXTRACTED", status="valid", valid_from=dt.datetime(2024, 1, 1), valid_to=None) | kw
    return tuple(row[f.split()[0]] for f in FACT.split(", "))


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_one_change_rewrites_one_partition(spark, tmp_path):
    rows = [fact(f"f{i}", str(i)) for i in range(200)]
    store = fact_store.FactStore.created(spark.createDataFrame(rows, FACT), f"file://{tmp_path}/s", 8)
    before = files(tmp_path / "s/facts")
    refused = store.change(spark.createDataFrame([("f7", "new", None, None, None, "u1")], CHANGE), now())
    after = files(tmp_path / "s/facts")
    changed = {f.split("/")[0] for f in before.keys() ^ after.keys()}
    assert len(changed) == 1 and len({f.split("/")[0] for f in before}) == 8
    assert refused.count() == 0 and store.read().count() == 201
    versions = {r.value: (r.status, r.valid_to, r.valid_from) for r in store.read().where("logical_id = 'f7'").collect()}
    assert versions == {"7": ("obsolete", dt.datetime(2030, 1, 1), dt.datetime(2024, 1, 1)), "new": ("valid", None, dt.datetime(2030, 1, 1))}
    (audit,) = store.versions().collect()
    assert (audit.logical_id, audit.change_type, audit.author_id) == ("f7", "update", "u1")
    assert audit.fact_id == facts.current(store.read()).where("logical_id = 'f7'").first().id


def test_inserts_refusals_and_several_open_versions(spark, tmp_path):
    rows = [fact("a", "1"), fact("b", "2"), fact("b", "3", id="b@2", valid_from=dt.datetime(2025, 1, 1)), fact("c", "4", valid_to=dt.datetime(2025, 1, 1), status="obsolete")]
    store = fact_store.FactStore.created(spark.createDataFrame(rows, FACT), f"file://{tmp_path}/s", 4)
    say = [("a", "1", None, None, None, None), ("b", "9", "under_review", None, None, None), ("c", "9", None, None, None, None), ("d", "9", None, "e2", "q", "u"), ("x", "9", None, None, None, None), ("y", "1", None, "e", "p", None), ("y", "2", None, "e", "p", None)]
    refused = {r.logical_id: r.reason for r in store.change(spark.createDataFrame(say, CHANGE), now()).collect()}
    assert refused == {"c": "NO_OPEN_VERSION", "x": "NOT_FOUND", "y": "NAMED_TWICE"}
    open_ = sorted((r.logical_id, r.value, r.status, r.entity_id, r.source_id) for r in facts.current(store.read()).collect())
    assert open_ == [("a", "1", "valid", "e", "s"), ("b", "2", "valid", "e", "s"), ("b", "9", "under_review", "e", "s"), ("d", "9", "valid", "e2", None)]
    assert sorted((r.logical_id, r.change_type) for r in store.versions().collect()) == [("b", "update"), ("d", "create")]
    gone = store.invalidate(spark.createDataFrame([("b",), ("c",), ("zz",)], "logical_id string"), now(2))
    assert sorted(r.logical_id for r in gone.collect()) == ["c", "zz"]
    assert sorted((r.logical_id, r.value) for r in facts.current(store.read()).collect()) == [("a", "1"), ("b", "2"), ("d", "9")]


@pytest.mark.parametrize("width", [1, 3600])
def test_intervals_equal_a_loop(spark, width):
    rng = random.Random(3)
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    points = [(i, rng.choice("ab"), t(rng.randrange(50_000))) for i in range(300)] + [(900, "a", None), (901, None, t(5))]
    spans = [(i, rng.choice("ab"), t(s := rng.randrange(50_000)), t(s + int(10 ** rng.uniform(0, 4.6)))) for i in range(80)]
    spans += [(100, "a", t(49_000), None), (101, "b", None, t(9)), (102, "a", t(5), t(5)), (103, "a", t(9), t(1))]
    p, s = spark.createDataFrame(points, "i int, k string, at timestamp"), spark.createDataFrame(spans, "j int, k string, lo timestamp, hi timestamp")
    got = sorted((r.i, r.j) for r in intervals.interval_join(p, s, ["k"], "at", "lo", "hi", width).collect())
    assert got == sorted((i, j) for i, k, at in points for j, k2, lo, hi in spans if at and lo and k == k2 and lo <= at and (hi is None or at < hi))
    plan = intervals.interval_join(p, s, ["k"], "at", "lo", "hi", width)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan[plan.index("Join Inner") :].splitlines()[0]
    assert intervals.interval_join(p.limit(0), s, ["k"], "at", "lo", "hi").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_classes_decide_as_all_pairs_do(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{i}", f"{i}", rng.choice(["e1", "e2", "e3"]), "p", rng.choice("vwx"), rng.choice("stuz"), rng.choice(["EXTRACTED", "INFERRED", "AMBIGUOUS", "?"]), "valid", None, None) for i in range(40)]
    sources = spark.createDataFrame([(s, dt.datetime(2024, 1, 1 + i % 2)) for i, s in enumerate("stu")], "id string, ingested_at timestamp_ntz")
    held = spark.createDataFrame(rows, FACT).dropDuplicates(["entity_id", "property", "value", "source_id"])
    candidates = conflicts.candidates(held, sources)
    lost = {(r.entity_id, r.value, r.source_id) for r in conflicts.losers(conflicts.pairs(candidates)).collect()}
    found = conflicts.classes(candidates).collect()
    assert {(r.entity_id, r.value, r.source_id) for r in found if r.loses} == lost
    sides = {(r.entity_id, r[f"value_{s}"], r[f"source_id_{s}"]) for r in conflicts.pairs(candidates).collect() for s in "ab"}
    assert {(r.entity_id, r.value, r.source_id) for r in found} == sides and len(found) == len(sides)
