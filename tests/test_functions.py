from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.functions import language, numbers, text


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("This is the text of the day", "en"),
        ("le chat et la souris sont dans une maison", "fr"),
        ("der Hund und die Katze", "de"),
        ("el perro y los gatos con señal", "es"),
        ("perché è così, non lo so", "it"),
        ("xyzzy", "en"),
        ("", "en"),
        (None, "en"),
        ("in", "en"),  # a tie of English and German
    ],
)
def test_language(spark, given, want):
    assert one(spark, language.detect(F.col("t")), t=given) == want


def test_tokens_are_words_and_pairs(spark):
    assert one(spark, text.tokens(F.col("t")), t="L'été ÉTÉ x1") == ["l'été", "été", "x1", "l'été été", "été x1"]
    assert one(spark, text.tokens(F.col("t")), t="") == []


def test_clean_item(spark):
    assert one(spark, text.clean_item(F.col("t")), t="di olio (1.2 kg)  e sale d’Islanda") == "olio sale d'Islanda"


def test_numbers(spark):
    got = one(spark, numbers.numbers(F.col("t")), t="1. Add 200 g of flour 00\n2. Wait 3.5 h\nserves 4")
    assert got == ["200", "3.5", "4"]


@pytest.mark.parametrize(("given", "want"), [("2.5000", "2.5"), ("10.000", "10"), ("0.0625", "0.063"), ("100", "100")])
def test_quantity_text(spark, given, want):
    assert one(spark, numbers.quantity_text(F.col("t").cast("decimal(18,4)")), t=given) == want


def test_accept_language(spark):
    c = text.accept_language(F.col("a"), F.col("b"))
    assert one(spark, c, a="it", b="fr") == "it"
    assert one(spark, c, a=None, b="fr-CH;q=0.9, en;q=0.8") == "fr-CH"
    assert one(spark, c, a="", b=None) is None


def test_title_overlap(spark):
    assert one(spark, text.title_overlap(F.col("q"), F.col("t")), q="the red ring", t="A RED thing") == pytest.approx(1 / 3)
    assert one(spark, text.title_overlap(F.col("q"), F.col("t")), q="", t="x") == 0.0
