from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.operators import normalize as n

UNITS = ("dl", "g", "cup")
MD = """---
title: Pan of rice
id: doc-1
lang: en
servings: 4
---
## Items
- 2.5 dl water
- 300 g rice
- 1 salt
## Steps
1. Boil the water for 10 min.
2. Add rice and Salt.
"""


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, md string")


def value(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def test_round_trip(spark):
    doc = n.parse(F.col("md"), UNITS)
    r = frame(spark, MD).select(doc.alias("doc"), n.render(doc).alias("back")).first()
    assert r.back == MD
    assert [tuple(x) for x in r.doc["items"]] == [("2.5", "dl", "water"), ("300", "g", "rice"), ("1", None, "salt")]


def test_graph_rows_recompose(spark):
    docs = frame(spark, MD, MD.replace("300 g", "301 g")).withColumn("doc", n.parse(F.col("md"), UNITS))
    again = n.recompose(n.subgraph(docs, "k", "doc"), "k").select("k", n.render(F.col("doc")).alias("back"))
    assert {r.k: r.back for r in again.collect()} == {r.k: r.md for r in docs.collect()}


def test_canonical_form_and_its_log(spark):
    docs = frame(spark, MD).withColumn("a", n.parse(F.col("md"), UNITS))
    docs = docs.withColumn("b", n.canonical(F.col("a"), {"dl": ("ml", "100", 0)}, {"rice": "white rice"})).persist()
    log = n.change_log(docs, "k", "a", "b")
    assert sorted((r.field, r.pos, r.before_text, r.after_text) for r in log.collect()) == [("items.item", 1, "rice", "white rice"), ("items.qty", 0, "2.5", "250"), ("items.unit", 0, "dl", "ml")]
    assert n.replay(docs, "k", "a", log).first()["items"] == docs.first()["b"]["items"]


def test_numbers_survive_masking(spark):
    masked = n.mask_numbers(F.col("t"))
    assert value(spark, masked, "2 eggs, 3.5 dl") == "{N1} eggs, {N2} dl"
    back = n.reinject_numbers(masked, F.array(F.lit("2"), F.lit("3.5")))
    assert value(spark, back, "2 eggs, 3.5 dl") == "2 eggs, 3.5 dl"
    assert value(spark, n.reinject_numbers(F.col("t"), F.array(F.lit("2"))), "{N2} eggs") is None
    assert value(spark, n.reinject_numbers(F.col("t"), F.array(F.lit("2"))), "eggs") is None


@pytest.mark.parametrize(("given", "want"), [("Red Onion and onions", "cipolla rossa and onions"), ("onion, ONION", "cipolla, cipolla"), ("", "")])
def test_longest_whole_words_are_replaced_once(spark, given, want):
    assert value(spark, n.substitute(F.col("t"), {"onion": "cipolla", "red onion": "cipolla rossa"}), given) == want


@pytest.mark.parametrize(
    ("bad", "issues"),
    [
        (MD, []),
        (MD.replace("300", "30"), ["P2_NUMBER_INVARIANT"]),
        (MD.replace("- 1 salt\n", ""), ["INGREDIENT_COUNT_MISMATCH", "P2_NUMBER_INVARIANT"]),
        (MD + "3. Serve.\n", ["STEP_COUNT_MISMATCH"]),
        (MD.replace("servings: 4", "servings: 5"), ["SERVINGS_MISMATCH"]),
    ],
)
def test_corruptions_are_caught(spark, bad, issues):
    df = spark.createDataFrame([(MD, bad)], "a string, b string")
    assert df.select(n.verify_counts(n.parse(F.col("a"), UNITS), n.parse(F.col("b"), UNITS)).alias("x")).first().x == issues


def test_sections_escalate_below_their_threshold(spark):
    other = MD.replace("Boil the water for 10 min.", "Qqq.").replace("Add rice and Salt.", "Www eee rrr ttt.")
    df = spark.createDataFrame([(MD, other)], "a string, b string")
    rows = df.select(n.verify_sections(n.parse(F.col("a"), UNITS), n.parse(F.col("b"), UNITS)).alias("x")).first().x
    assert [(r.section, r.escalate) for r in rows] == [("title", False), ("items", False), ("steps", True)]


def test_round_trips_move_nothing_after_the_documents_are_made(spark, sf):
    """Graph rows lie where their documents do: no table is staged and nothing is dealt by the rows' ids."""
    from pathlib import Path

    from kgspark.plans.catalog import QUERIES
    from kgspark.sources.shared import shared_dir

    tables = lambda: {*Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).glob("table-*")}
    were = tables()
    plan = QUERIES["roundtrip_ratio"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert tables() == were and dealt and all("l_orderkey" in line or "l_partkey" in line for line in dealt)


def test_graph_rows_of_odd_documents(spark):
    """Facts come back to their own items whatever the order of rows; a document without items and steps has no entity."""
    md = MD.replace("300 g", "301 g")
    docs = frame(spark, MD, md, "---\ntitle: x\n---\n").withColumn("doc", n.parse(F.col("md"), UNITS))
    rows = n.graph_rows(docs, "k", "doc", beside="md")
    kinds = {r.kind for r in rows.collect()}
    assert kinds == {"document", "item", "step", "fact"}
    shuffled = rows.repartition(5, F.rand(3)).orderBy(F.desc("id"), "kind")
    again = {r.k: (r.label, r.back) for r in n.recomposed(shuffled, "k").select("k", "label", n.render(F.col("doc")).alias("back")).collect()}
    assert len(again) == 2 and all(a == b for a, b in again.values())
