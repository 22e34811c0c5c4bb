from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kgspark.functions import public
from kgspark.operators import designer


def loop(rows, existing):
    """Plain ids first, then the first free numbers in order."""
    plains = {p for p, _ in rows}
    used, found = set(existing) | plains, {}
    seen = set(existing)
    for plain, nth in sorted(rows, key=lambda r: r[1]):
        if plain not in seen:
            found[nth] = plain
            seen.add(plain)
            continue
        n = 2
        while f"{plain}-{n}" in used:
            n += 1
        found[nth] = f"{plain}-{n}"
        used.add(found[nth])
    return found


@pytest.mark.parametrize("existing", [[], ["I-A", "I-A-2", "I-A-4", "I-B-02", "I-B-2-2", "I-A-x", "I-B-7"]])
def test_ids_are_the_first_free_ones(spark, existing):
    plains = ["I-A", "I-A", "I-B", "I-A-3", "I-A", "I-B", "I-A-3", "I-B-2", "I-A", "I-B", "I-A", "I-C"]
    rows = [(p, i) for i, p in enumerate(plains)]
    held = spark.createDataFrame([(e,) for e in existing], "id string")
    got = {r.nth: r.id for r in designer.allocated(spark.createDataFrame(rows, "plain string, nth int"), held).collect()}
    assert got == loop(rows, existing)
    assert len(set(got.values()) | set(existing)) == len(rows) + len(existing)


def test_a_draft_has_labels_aliases_and_units(spark):
    rows = [("ingredienti", 1, "Olive oil", ["olio d’oliva", " ", "olio"], "x:1"), ("ingredienti", 2, "olive OIL", None, None), ("tecnica", 1, "—", [], None), ("tecnica", 2, "Boil", ["  "], None)]
    df = spark.createDataFrame(rows, "vocabulary string, nth int, term string, source_terms array<string>, ontology_uri string")
    got = {r.id: (r.labels_it, r.aliases, r.ontology_uri) for r in designer.draft(df, spark.createDataFrame([], "id string")).collect()}
    assert got == {"ING-OLIVE-OIL": ("olio d’oliva", ["olio"], "x:1"), "ING-OLIVE-OIL-2": ("olive OIL", [], None), "TEC-TERM": ("—", [], None), "TEC-BOIL": ("Boil", [], None)}
    rules = {r.rule_id: (r.to_unit, r.factor, r.rounding) for r in designer.units(spark).collect()}
    assert len(rules) == 18 and rules["UNIT-DL"] == ("ml", 100.0, 0) and rules["UNIT-C"] == ("°C", 1.0, None)


def test_times_become_text_at_any_depth(spark):
    t, u = dt.datetime(2024, 5, 6, 7, 8, 9), dt.datetime(2024, 5, 6, 7, 8, 9, 120)
    row = (1, [t, None], {"k": (u, [dt.date(2024, 1, 2)])}, None)
    df = spark.createDataFrame([row], "id int, a array<timestamp_ntz>, m map<string, struct<t: timestamp_ntz, d: array<date>>>, s struct<t: timestamp_ntz>")
    r = public.safe_rows(df).first()
    assert (r.a, r.m["k"].t, r.m["k"].d, r.s) == ([t.isoformat(), None], u.isoformat(), ["2024-01-02"], None)
    at = spark.sql("SELECT timestamp '2024-05-06 07:08:09Z' AS at")
    assert public.safe_rows(at).first().at.startswith("2024-05-06T07:08:09")
    c = spark.createDataFrame([(7, "e", 5, t)], "id int, entity_id string, resolved_by int, created_at timestamp_ntz")
    out = public.public_conflicts(c)
    assert out.columns == public.CONFLICT and (out.first().resolved_by, out.first().created_at, out.first().status) == ("5", t.isoformat(), None)
    assert public.hits(c.select(F.col("entity_id").alias("title"))).columns == public.HIT
