from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from kgspark.llm.exact_dedup import exact_dedup, op13_exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text or "")].append(doc_id)
    found = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            found[(i, keep, len(ids), i == keep and first, sha)] += 1
            first = first and i != keep
    return found


def got(df, *args):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha.hex()) for r in exact_dedup(df, *args).collect())


@pytest.mark.parametrize("most", [1 << 29, 1 << 10])  # 2^16 cells at least; 1 << 10 asks for fewer
def test_equals_brute_force(docs, most):
    assert got(docs, most) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_nulls_ties_and_repeated_rows(odd):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_an_empty_table(nothing):
    df = exact_dedup(nothing)
    assert df.collect() == []
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "sha"]


def test_letters_beyond_ascii_keep_their_case(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "aB"), (5, "Ab"), (None, "AB"), (None, "x"), (None, "X")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert {r.doc_id: r.keep_id for r in exact_dedup(df).collect() if r.doc_id} == {1: 3, 2: 2, 3: 3, 4: 5, 5: 5}


def test_a_full_filter_and_a_hot_group(spark):
    """Twenty rows a cell: all rows shuffle, a third of them copies of one text; and the same row 3,000 times."""
    rng = random.Random(5)
    rows = [(i, "the Same text") for i in range(30_000)] + [(i, f"text {rng.randrange(60_000)}") for i in range(30_000, 90_000)] + [(7, "again")] * 3000
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    assert got(df, 1 << 12) == brute(rows)


def test_texts_of_their_own_do_not_reach_the_groups(spark, monkeypatch):
    """What is grouped is the repeated texts and few others."""
    from kgspark.llm import exact_dedup as module

    grouped = []
    monkeypatch.setattr(module, "stored", lambda df, name, real=module.stored: grouped.append((name, out := real(df, name))) or out)
    rows = [(i, f"text {i}") for i in range(20_000)] + [(20_000 + i, f"text {i}") for i in range(100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    n = {name: df.count() for name, df in grouped}
    assert n["hashes"] == 20_100
    assert 200 <= n["one"] <= 1200


def test_the_query_has_the_columns_of_its_contract(spark, sf):
    df = op13_exact_dedup(spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
