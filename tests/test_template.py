from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.operators import normalize, packs, template

UNITS = ("g", "dl", "cup", "cups")
IT = """---
title: Riso
id: doc-1
lang: it
servings: 4
time_min: 20
difficulty: facile
---
## Ingredienti
- 300 g riso
- 2.5 dl acqua
- 1 sale

## Procedimento
1. Bollire per 10 min.
2. Servire.
"""
EN = IT.replace("lang: it", "lang: en\nsource_lang: it").replace("facile", "easy").replace("Ingredienti", "Ingredients").replace("Procedimento", "Method")


def value(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).first().x


def found(spark, md, shape=template.SOURCE):
    return [(e.code, e.line) for e in value(spark, template.errors(F.col("t"), shape, UNITS), md)]


@pytest.mark.parametrize(
    ("bad", "want"),
    [
        (IT, []),
        (IT + "\n\n", []),
        (None, [("NO_FRONT_MATTER", 1)]),
        ("", [("NO_FRONT_MATTER", 1)]),
        (IT[4:], [("NO_FRONT_MATTER", 1)]),
        ("---\ntitle: x\n", [("FRONT_MATTER_OPEN", 1)]),
        (IT.replace("time_min: 20\n", ""), [("MISSING_KEY", 1)]),
        (IT.replace("servings: 4", "servings: four"), [("NOT_AN_INTEGER", 1)]),
        (IT.replace("facile", "easy"), [("UNKNOWN_DIFFICULTY", 1)]),
        (IT.replace("## Ingredienti", "## Cose"), [("MISSING_SECTION", None)]),
        (IT.replace("Ingredienti", "X").replace("Procedimento", "Ingredienti").replace("## X", "## Procedimento"), [("SECTION_ORDER", 1)]),
        (IT.replace("- 300 g riso", "300 g riso"), [("ITEM_EXPECTED", 2)]),
        (IT.replace("- 300 g riso", "- riso"), [("QUANTITY_EXPECTED", 2)]),
        (IT.replace("- 300 g riso", "- 300 g"), [("ITEM_EMPTY", 2)]),
        (IT.replace("- 300 g riso", "- 300 grande riso"), []),
        (IT.replace("2. Servire.", "3. Servire."), [("STEP_NUMBER", 8)]),
        (IT.replace("2. Servire.", "Servire."), [("STEP_EXPECTED", 8)]),
        (IT.split("1. Bollire")[0], [("NO_STEPS", 6)]),
    ],
)
def test_errors_have_their_code_and_line(spark, bad, want):
    assert found(spark, bad) == want


def test_translations_need_their_own_template(spark):
    assert found(spark, EN, template.TRANSLATED) == []
    assert ("MISSING_KEY", 1) in found(spark, IT, template.TRANSLATED)


@pytest.mark.parametrize(
    ("other", "want"),
    [
        (EN, []),
        (EN.replace("id: doc-1", "id: doc-2"), ["ID_MISMATCH"]),
        (EN.replace("lang: en", "lang: fr", 1), ["LANG_MISMATCH"]),
        (EN.replace("source_lang: it", "source_lang: de"), ["SOURCE_LANG_MISMATCH"]),
        (EN.replace("time_min: 20", "time_min: 25"), ["TIME_MIN_MISMATCH"]),
        (EN.replace("easy", "hard"), ["DIFFICULTY_MISMATCH"]),
        (EN.replace("2. Servire.\n", ""), ["STEP_COUNT_MISMATCH"]),
        (EN.replace("10 min", "12 min"), ["P2_NUMBER_INVARIANT"]),
        (EN.replace("## Method", "## Steps"), ["TRANSLATED_PARSE"]),
    ],
)
def test_translations_are_held_against_their_source(spark, other, want):
    df = spark.createDataFrame([(IT, other)], "a string, b string")
    assert df.select(template.verify(F.col("a"), F.col("b"), UNITS).alias("x")).first().x == want


PACK = packs.Pack(
    "p", "1", entries=({"namespace": "ingredienti", "id": "I1", "labels_en": "rice", "labels_it": "riso", "aliases": ["Riso Bianco"]},),
    units=(packs.UnitRule("U1", "dl", "ml", "100", 0), packs.UnitRule("U2", "tazza", "cup", "1"), packs.UnitRule("U3", "cup", "l", "0.25")), plurals={"cup": "cups"},
)


def doc(spark, md):
    return spark.createDataFrame([(md,)], "t string").withColumn("doc", normalize.parse(F.col("t"), UNITS))


def test_units_and_terms_go_by_the_pack(spark):
    md = EN.replace("300 g riso", "300 g di RISO BIANCO (fino)").replace("2.5 dl acqua", "2.5 dl acqua").replace("1 sale", "2 cups riso nero")
    r = doc(spark, md).select(packs.canonical(F.col("doc"), PACK).alias("x")).first().x
    assert [tuple(i) for i in r["items"]] == [("300", "g", "rice"), ("250", "ml", "acqua"), ("2", "cup", "riso nero")]  # the first rule that knows cups
    assert [(c.field, c.after_text, c.rule_id) for c in r.log] == [("items[0].item", "rice", "GLOSSARY"), ("items[1].qty", "250", "U1"), ("items[1].unit", "ml", "U1"), ("items[2].unit", "cup", "U2")]
    assert r.unresolved == ["acqua", "riso nero"]


def test_doses_are_metric_and_for_ten(spark):
    md = EN.replace("300 g riso", "2 cup riso").replace("1 sale", "1 tazza sale").replace("servings: 4", "servings: 3")
    known = ("g", "dl", "cup", "tazza")
    r = spark.createDataFrame([(md,)], "t string").select(packs.doses(normalize.parse(F.col("t"), known)).alias("x")).first().x
    assert [tuple(i) for i in r["items"]] == [("1666.67", "ml", "riso"), ("8.33", "dl", "acqua"), ("3.33", "tazza", "sale")]
    assert [c.rule_id for c in r.log] == ["DOSE-CUP", "DOSE-SCALE", "DOSE-UNKNOWN", "DOSE-SCALE", "DOSE-UNKNOWN", "DOSE-SCALE"]


def test_packs_are_validated_whole(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "glossari").mkdir()
    assert packs.validate(tmp_path) == ["pack.yaml: missing"]
    (tmp_path / "pack.yaml").write_text("name: p\nversion: 1.0.0\nglossaries: [ingredienti, stati]\nunits_source: units.yaml\n")
    (tmp_path / "template.md").write_text("x")
    (tmp_path / "glossari/ingredienti.yaml").write_text("entries:\n- {id: A, labels_en: rice, labels_it: riso}\n- {id: A, labels_en: '', labels_it: x}\n")
    (tmp_path / "units.yaml").write_text("- {rule_id: R, from_unit: dl, to_unit: ml, factor: 100}\n- {rule_id: R, from_unit: a, to_unit: b, factor: 0}\n")
    errors = packs.validate(tmp_path)
    assert len(errors) == 5 and any("stati.yaml: missing" in e for e in errors)
    with pytest.raises(ValueError, match="duplicate rule_id"):
        packs.load(tmp_path)
    (tmp_path / "glossari/ingredienti.yaml").write_text("- {id: A, labels_en: rice, labels_it: riso, is_public: true}\n")
    (tmp_path / "glossari/stati.yaml").write_text("[]")
    (tmp_path / "units.yaml").write_text("- {rule_id: R, from_unit: dl, to_unit: ml, factor: 100, rounding: 0}\n")
    pack = packs.load(tmp_path)
    assert packs.known_units(pack) == ("dl", "ml")
    assert [(r.id, r.label_it, r.is_public) for r in packs.terms(spark, pack).collect()] == [("ingredienti:A", "riso", True)]


def parts(spark, md):
    doc = spark.createDataFrame([(md,)], "t string").select(normalize.parse(F.col("t"), UNITS).alias("d")).first().d
    return doc.fm, [tuple(i) for i in doc["items"]], doc.steps


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_and_tabs_change_nothing(spark, end):
    md = IT.replace("\n", end).replace(f"- 2", "\t- 2")
    assert found(spark, md) == found(spark, IT) == []
    assert parts(spark, md) == parts(spark, IT)


def test_yaml_values_comments_and_repeated_keys(spark):
    md = '---\n# head\ntitle: "Riso: \\"buono\\"" # note\nid: \'l\'\'orto\'\nlang: it # x\nservings: 4 # four\ntime_min: "30"\ndifficulty: "facile"\ntitle2: ~\nid: due\ntags:\n  - a: b\n---\n'
    fm = spark.createDataFrame([(md,)], "t string").select(template.front_matter(F.col("t")).alias("m")).first().m
    assert fm == {"title": 'Riso: "buono"', "id": "due", "lang": "it", "servings": "4", "time_min": "30", "difficulty": "facile", "title2": None, "tags": None}
    body = IT[IT.index("## Ingredienti") :]
    assert found(spark, md + body) == [("NOT_AN_INTEGER", 1)]  # a quoted number is a text
    assert parts(spark, md + body)[0]["id"] == "due"  # a repeated key does not stop the job


def test_items_and_steps_count_in_their_sections_only(spark):
    md = IT.replace("## Ingredienti\n", "- 9 g nulla\n1. Nulla.\n## Ingredienti\n1. Nulla.\n").replace("## Procedimento\n", "## Procedimento\n- 7 g nulla\n")
    assert parts(spark, md)[1:] == parts(spark, IT)[1:]
    assert parts(spark, "- 9 g nulla\n1. Nulla.\n") == ({}, [], [])
    none = spark.createDataFrame([(None,)], "t string").select(normalize.parse(F.col("t"), UNITS).alias("d")).first().d
    assert (none.fm, none["items"], none.steps) == ({}, None, None)
