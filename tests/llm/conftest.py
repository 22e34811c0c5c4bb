from __future__ import annotations

import pytest

SENTENCE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree. "
LONG = "".join(f"Word{i} and more words follow number {i * 7919 % 1000}. " + ("\n" if i % 9 == 0 else "") for i in range(20_000))
CLASHING = "k string, id string, hash string, words string, tree string, length string, lines string, label string"
ROWS = [
    (1, SENTENCE * 3),
    (2, SENTENCE * 3),  # a tie: an exact copy
    (3, None),
    (4, ""),
    (5, " \t\n\n "),
    (6, LONG),
    (7, LONG + "An edit at the end."),
    (8, 'Here is token = "0123456789abcdef0123456789abcdef01234567" in prose, as findings have it.'),
    (8, 'Here is token = "0123456789abcdef0123456789abcdef01234567" in prose, as findings have it.'),  # a repeated row
    (None, "A text without an id has twelve words in it, and a full stop."),
    (9, "Released under the MIT License."),
    (10, "é 漢字 🙂 naïve\x1c\x85 <|endoftext|> it's don't Ünïcode"),
]


def table(spark, rows):
    clash = ", ".join(f"'x' AS {c.split()[0]}" for c in CLASHING.split(", "))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "CASE WHEN doc_id % 2 = 0 THEN 'src0' END AS source", "length(text) AS n_chars", *clash.split(", "))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    return table(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
