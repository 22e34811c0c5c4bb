from __future__ import annotations

import duckdb

from kgspark.llm import quality_rules as q
from kgspark.llm.quality_rules import quality_rules


def test_query_equals_its_sql(spark, sf):
    got = q.op1_quality_rules(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(q.SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert (got == want).all(axis=None)


def test_lines_that_fail_go(spark):
    good = "This is a sentence with a number of words in it, and it ends as it should. It has a second one."
    lines = {
        "Home | About | News | Contact | Login": True,
        "word*** other&&& third### fourth$$$": True,
        "ALL OF THIS IS SHOUTED AT YOU!!": True,
        "same same same same other other other other": True,
        "one two three four five six seven eight nine": True,
        "We use cookies to improve the site.": True,
        "A short title": False,
        good: False,
    }
    rows = quality_rules(spark.createDataFrame([(i, f"{good} {good[:40]}.\n{line}") for i, line in enumerate(lines)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_lines_lost for r in rows} == {i: int(bad) for i, bad in enumerate(lines.values())}


def test_repeated_windows_count_their_words_once(spark):
    text = "a b c d e x a b c d e y a b c d e"
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (17, 15, True)


def test_odd_rows(odd, nothing):
    rows = quality_rules(odd).collect()
    assert len(rows) == odd.count()
    empty = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept and r.n_repeat_words == 0 for r in empty)
    assert quality_rules(nothing).collect() == []
