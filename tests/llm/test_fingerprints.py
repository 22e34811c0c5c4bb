from __future__ import annotations

import hashlib
import re

import pytest

from kgspark.llm import fingerprints as f


def leaves(text: str) -> set[str]:
    return {x for line in text.split("\n") for x in re.findall(f.LEAF, line, re.ASCII)}


def likeness(a: str, b: str) -> float:
    a, b = leaves(a), leaves(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_edited_texts_and_likeness(spark, sf, texts, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        rows = {r.doc_id: r for r in f.op2_merkle_fingerprints(spark, sf).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    order = sorted(texts, reverse=True)
    prints = {}
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id], texts[order[(i + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, edited)) and r.near_next == pytest.approx(likeness(text, after))
        lines, other = text.split("\n"), edited.split("\n")
        assert (r.n_paragraphs, r.n_same_paragraphs) == (len(lines), sum(map(str.__eq__, lines, other)))
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for x in prints.values() for p in x}) == len(prints)


def test_branches_locate_edits(spark):
    a = "First paragraph here.\nSecond paragraph here.\n\nThird one, in a section of its own."
    b = a.replace("Second", "Other")
    trees = [r.tree for r in f.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [x.node == y.node for x, y in zip(*trees, strict=True)] == [False, True]
    assert [x.node == y.node for x, y in zip(trees[0][0].paragraphs, trees[1][0].paragraphs, strict=True)] == [True, False]


def test_white_space_counts(spark):
    rows = f.fingerprints(spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "a\nb"), (4, "a\n\nb")], "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == 4


def test_odd_rows(spark, odd, nothing):
    rows = f.edits(odd).collect()
    assert len(rows) == odd.count()
    assert f.edits(nothing).collect() == []
    one = f.edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited == "abab"
