"""What an expression over a document mentions is computed once; lambdas would compute it for each mention."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.operators import normalize, template

UNITS = ("dl", "g")
MD = "---\ntitle: Pan\nid: p1\nlang: it\nservings: 2\ntime_min: 5\ndifficulty: facile\n---\n## Ingredienti\n- 3 g salt\n## Procedimento\n1. Wait 7 min.\n"


@pytest.mark.parametrize(
    ("made", "pattern", "most"),
    [
        (lambda md: template.verify(md, md, UNITS), "\\A---[ \\t]*\\n", 4),
        (lambda md: normalize.parse(md, UNITS), "\\A---[ \\t]*\\n", 1),
        (lambda md: normalize.translate(md, {"wait": "aspetta"}), "(?!0+(?!", 5),
    ],
    ids=["verify", "parse", "translate"],
)
def test_patterns_are_matched_a_bounded_number_of_times(spark, made, pattern, most):
    df = spark.createDataFrame([(MD,)], "md string").select(made(F.col("md")).alias("x"))
    assert 1 <= df._jdf.queryExecution().analyzed().toString().count(pattern) <= most


def test_front_matter_of_odd_pairs(spark):
    md = "---\na: 1\n# b: 2\n c: 3\na: '2'\nd:4\ne: \"x # y\" # z\nf: ~\n---\nbody"
    row = spark.createDataFrame([(md,)], "md string").select(template.front_matter(F.col("md")).alias("x")).first()
    assert row.x == {"a": "2", "e": "x # y", "f": None}


def test_strict_and_parsed_documents_are_not_written(spark, sf, monkeypatch):
    """Their rows are computed in one pass, so no texts go to the shared folder."""
    from kgspark.plans import document_queries

    def refused(df):
        raise AssertionError("a table was written")

    monkeypatch.setattr(document_queries, "stored", refused)
    assert document_queries.parse_strict(spark, sf).count() == document_queries.parse_documents(spark, sf).count() > 0


def test_odd_lines_of_documents(spark):
    md = "\ufeff---\r\na: b: c\r\n---\r\n## Items\r\n- 1 g\u2028\r\n- 2 g x\u2028y\r\n- 3  salt\u0085\r\n * 4 g no\r\n## Steps\r\n1. a\r\n2.b\r\n03.  c\r\n## Items\r\n- 4.50 dl m\r\n"
    row = spark.createDataFrame([(md,)], "md string").select(normalize.parse(F.col("md"), UNITS).alias("x")).first()
    assert row.x.fm == {"a": "b: c"}
    assert [tuple(i) for i in row.x["items"]] == [("4.50", "dl", "m")]
    assert row.x.steps == ["a", " c"]
    begun = md.rsplit("## Items", 1)[0]
    row = spark.createDataFrame([(begun,)], "md string").select(normalize.parse(F.col("md"), UNITS).alias("x")).first()
    assert [tuple(i) for i in row.x["items"]] == [("1", None, "g"), ("3", None, "salt")]


def test_change_log_moves_no_rows(spark):
    docs = spark.createDataFrame([(1, MD)], "k int, md string").select("k", normalize.parse(F.col("md"), UNITS).alias("a"))
    log = normalize.change_log(docs.withColumn("b", F.col("a")), "k", "a", "b")
    assert "Exchange" not in log._jdf.queryExecution().executedPlan().toString()
    assert log.count() == 0


def test_an_index_finds_words_once(spark, tmp_path):
    from kgspark.operators import search_index

    rows = spark.createDataFrame([("a", "1", "x y x"), ("a", "2", None), ("b", "3", "")], "kind string, key string, text string")
    index = search_index.SearchIndex.built(rows, str(tmp_path / "index"))
    stored = spark.read.parquet(f"{index.path}/counts")
    assert {tuple(r) for r in stored.collect()} == {("a", "1", None, 0, 3), ("a", "1", "x", 2, 3), ("a", "1", "y", 1, 3), ("a", "2", None, 0, 0), ("b", "3", None, 0, 0)}
    assert {(r.kind, r.n, r["mean"]) for r in spark.read.parquet(f"{index.path}/sizes").collect()} == {("a", 2, 1.5), ("b", 1, 0.0)}
