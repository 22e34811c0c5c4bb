"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)?"
#: Connector words that are dropped from items (fixed values).
CONNECTORS = "di|e"


def folded(text: Column) -> Column:
    """Case folding: lower case, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def counted(tokens_: Column) -> Column:
    """array<struct<token, tf>> of an array's different values, by sorting it inside the row."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), lambda i: (F.size(s) > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))

        def lengths(at: Column) -> Column:
            return F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))

        return F.get(F.transform(F.array(begins), lengths), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(F.array_compact(tokens_))), runs), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words and adjacent pairs."""
    w = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.get(F.transform(F.array(w), lambda x: F.concat(x, adjacent(x))), F.lit(0))  # one element: words are found once


def adjacent(w: Column) -> Column:
    """Neighbours joined by a space."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def letters(text: Column) -> Column:
    """Words of letters only."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 where one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.least(F.size(x), F.size(y))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / n)


def stable_hash(token: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_sign(token: Column) -> Column:
    """1 or -1 by the second lowest bit of ``stable_hash``."""
    digit = F.conv(F.substring(F.sha2(token, 256), 16, 1), 16, 10).cast("int")
    return F.when(digit.bitwiseAND(2) == 2, 1).otherwise(-1)


def clean_item(item: Column) -> Column:
    """Without parentheses, connectors and repeated spaces."""
    out = F.regexp_replace(item, "\\([^)]*\\)", " ")
    out = F.regexp_replace(out, f"(?i)^(?:{CONNECTORS})\\s+", "")
    out = F.regexp_replace(out, f"(?i)\\s+(?:{CONNECTORS})\\s+", " ")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("’"), F.lit("'")), "\\s+", " "))


def slug(text: Column) -> Column:
    """T06."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def first_sentence(text: Column) -> Column:
    """Up to and with the first sentence mark."""
    return F.get(F.split(F.trim(text), "(?<=[.!?])[ \\t\\n\\f\\r]+", 2), F.lit(0))


def title_overlap(query: Column, title: Column) -> Column:
    """The share of the query's ASCII tokens that the title has."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)))
    t = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def display_name(label: Column) -> Column:
    """``.embed()`` -> ``embed``; ``extract.py`` -> ``extract``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(label), "\\(\\)$", ""), "^\\.+", ""), "\\.py$", "")


def accept_language(lang: Column, header: Column) -> Column:
    """F16: an explicit language, else the header's first one."""
    first = F.trim(F.split(F.split(header, ",")[0], ";")[0])
    return F.coalesce(F.nullif(lang, F.lit("")), F.nullif(first, F.lit("")))


def untranslated(lang: str, source_language: Column, state: Column) -> Column:
    """whether a response in ``lang`` must be flagged as not translated."""
    pending = F.coalesce(state, F.lit("native")) == "pending"
    if lang.lower() in ("en", "eng", "english"):
        return pending
    return pending & (F.lower(F.coalesce(source_language, F.lit(""))) != lang.lower())


def untranslated_document(lang: str, source_language: Column, state: Column) -> Column:
    """documents are flagged in every language but their own and, when ready, English."""
    own = F.lower(F.coalesce(source_language, F.lit(""))) == lang.lower()
    ready = F.coalesce(state, F.lit("native")).isin("native", "translated")
    return ~own & ~ready if lang.lower() in ("en", "eng", "english") else ~own
