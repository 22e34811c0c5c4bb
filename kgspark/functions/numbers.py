"""Numbers, units and quantities in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number of the content: no part of a word or identifier, and not zeros alone.
NUMBER = "(?<![\\p{L}\\p{N}_.])(?!0+(?![\\p{L}\\p{N}_.]))-?\\d+(?:\\.\\d+)?(?![\\p{L}\\p{N}_.])"
FRONT_MATTER = "(?s)\\A---\\s*\\n.*?\\n---\\s*\\n?"
#: Numbers with a unit of time, and temperatures.
MENTION = "(?i)-?\\d+(?:\\.\\d+)?\\s*(?:minuti|min\\b|ore|h\\b|secondi|sec\\b|s\\b)"
TEMPERATURE = "(?i)-?\\d+(?:\\.\\d+)?\\s*(?:°C|°c|gradi|degrees)\\b"


def numbers(text: Column) -> Column:
    """Content numbers in order; front matter, step ordinals, parts of identifiers and tokens of zeros do not count."""
    lines = F.transform(F.split(F.regexp_replace(text, FRONT_MATTER, ""), "\n"), lambda x: F.regexp_extract_all(F.regexp_replace(x, "^\\s*\\d+\\.\\s+", ""), F.lit(NUMBER), F.lit(0)))
    return F.flatten(lines)


def same_numbers(a: Column, b: Column) -> Column:
    """Multiset equality."""
    return F.array_sort(a) == F.array_sort(b)


def mentions(text: Column) -> Column:
    """array<struct(property, value)>: numbers with a unit of time, then temperatures, each in order."""

    def found(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("property"), x.alias("value")))

    return F.concat(found("time", MENTION), found("temperature", TEMPERATURE))


def convert(quantity: Column, factor: Column, places: Column | None) -> Column:
    """Exact decimal product, rounded half up where the rule says to how many places."""
    exact = quantity.cast("decimal(18,4)") * factor.cast("decimal(18,12)")
    return exact if places is None else F.round(exact, places)


def quantity_text(quantity: Column) -> Column:
    """At most three decimals, no trailing zeros."""
    text = F.round(quantity, 3).cast("decimal(38,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def convert_float(quantity: Column, factor: Column, places: int | None) -> Column:
    """The same in doubles, rounded half to even."""
    product = quantity.cast("double") * factor.cast("double")
    return product if places is None else F.bround(product, places)
