"""Language detection by function words and accented characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.text import folded

#: The function words of each language, in the order in which ties are resolved after English.
MARKERS = {
    "en": "the and is are of to in for with this that from on at by a an be",
    "fr": "le la les et est sont de des du une un pour avec ce cette dans que qui sur pas au aux",
    "de": "der die das und ist sind von zu in für mit dies diese ein eine auf den dem nicht",
    "it": "il lo la e è sono di del della per con questo questa un una che non nel nella",
    "es": "el la los las y es son de del para con este esta un una que no en por",
}
#: Characters that count once each for a language.
ACCENTS = {"fr": "éèêëàâçôîïùûœ", "de": "äöüß", "es": "ñ¿¡", "it": "ìòù"}


def scores(text: Column) -> Column:
    """array<struct<score, nth, lang>>: larger is better, ties go to the larger ``nth`` (English, then marker order)."""
    every = sorted({m for words in MARKERS.values() for m in words.split()})

    def of(low: Column, marked: Column) -> Column:
        def score(lang: str) -> Column:
            n = F.size(F.filter(marked, lambda w: w.isin(*MARKERS[lang].split())))
            for c in ACCENTS.get(lang, ""):
                n = n + F.contains(low, F.lit(c)).cast("int")
            return n

        return F.array(*[F.struct(score(lang).alias("score"), F.lit(len(MARKERS) - i).alias("nth"), F.lit(lang).alias("lang")) for i, lang in enumerate(MARKERS)])

    def markers(low: Column) -> Column:
        return F.filter(F.regexp_extract_all(low, F.lit("\\p{L}+"), F.lit(0)), lambda w: w.isin(*every))

    # One element each, so that the text is folded once, and its markers are found once for all languages.
    return F.get(F.transform(F.array(folded(text)), lambda low: F.get(F.transform(F.array(markers(low)), lambda m: of(low, m)), F.lit(0))), F.lit(0))


def detect(text: Column) -> Column:
    """The detected language; English for empty texts and texts without any marker."""
    best = F.array_max(scores(text))
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "en").when(best["score"] == 0, "en").otherwise(best["lang"])
