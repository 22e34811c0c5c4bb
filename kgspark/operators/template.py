"""Documents held strictly against their template, with coded errors and their lines.

``parse`` in ``normalize`` reads what it can; ``errors`` says what is wrong, in the order in which a strict reader meets it,
so the first one is the reader's error. Lines count from 1, those of the body from its own first line. A document without
errors is what ``normalize.parse`` makes of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.numbers import numbers


@dataclass(frozen=True)
class Template:
    """Headings of the two sections, keys of the front matter, whole-number keys and the levels of difficulty."""

    items: str
    steps: str
    keys: tuple[str, ...] = ("title", "id", "lang", "servings", "time_min", "difficulty")
    whole: tuple[str, ...] = ("servings", "time_min")
    levels: tuple[str, ...] = ()


#: The levels of a source document and what they are called in a translated one.
LEVELS = {"facile": "easy", "medio": "medium", "difficile": "hard"}
SOURCE = Template("## Ingredienti", "## Procedimento", levels=tuple(LEVELS))
TRANSLATED = Template("## Ingredients", "## Method", ("title", "id", "lang", "servings", "time_min", "difficulty", "source_lang"), levels=tuple(LEVELS.values()))
ERROR = "array<struct<code:string,line:int,what:string>>"


def once(value: Column, use) -> Column:
    """``use(value)``, the value computed once: what a lambda mentions twice, Spark computes twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _error(code: str, line: Column, what: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), line.cast("int").alias("line"), (F.lit(None) if what is None else what).cast("string").alias("what"))


def _only(bad: Column, *errors: Column) -> Column:
    return F.when(bad, F.array(*errors)).otherwise(F.array().cast(ERROR))


#: Blanks of a line, as strict readers strip them.
BLANK = " \t\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0"


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def plain_ends(md: Column) -> Column:
    """All line ends (CRLF, CR) as line feeds, without a byte order mark."""

    def of(t: Column) -> Column:
        odd = F.startswith(t, F.lit("\ufeff")) | F.contains(t, F.lit("\r"))  # few texts: the others are not searched
        return F.when(odd, F.regexp_replace(F.regexp_replace(t, "\\A\ufeff", ""), "\\r\\n?", "\n")).otherwise(t)

    return once(md, of)


def _lines(md: Column) -> Column:
    """Lines of a text between blanks, without an empty one after its last line end."""
    ended = lambda t: F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.transform(F.split(once(plain_ends(md), ended), "\n"), bare)


def last(lines: Column, *texts: str) -> Column:
    """The number (from 0) of the last line that is one of ``texts``; -1 where none is."""

    def of(x: Column) -> Column:
        at = [F.nullif(F.array_position(x, F.lit(t)), F.lit(0)) for t in texts]
        return F.coalesce((F.size(x) - (at[0] if len(at) == 1 else F.least(*at))).cast("int"), F.lit(-1))

    return once(F.reverse(lines), of)


def between(lines: Column, begin: Column, end: Column) -> Column:
    """The lines after ``begin`` (from 0) and before ``end``."""
    return F.slice(lines, begin + 2, F.greatest(end - begin - 1, F.lit(0)))


#: Front matter with its two marks, and the ``key: value`` lines in it.
HEAD = "(?s)\\A---[ \\t]*\\n(?:.*?\\n)??[ \\t]*---[ \\t]*(?:\\n|\\z)"
PAIR = "(?<=\\n)([^\\s#:][^:\\n]*):(?=\\s|\\z|[\\u0085\\u2028\\u2029](?:\\n|\\z))([^\\n]*)"


def head(text: Column) -> Column:
    """The front matter of a text with plain line ends; empty where there is none."""
    return once(text, lambda t: F.when(F.startswith(t, F.lit("---")), F.regexp_extract(t, HEAD, 0)).otherwise(F.when(t.isNotNull(), F.lit(""))))


def _raw_pairs(given: Column) -> Column:
    """map<string, string> of the ``key: value`` lines of a ``head``, values as written; NULL where it is empty.

    Of a key that is there twice the last value counts; comments and lines below a key (indented) are left out.
    """

    def latest(x: Column) -> Column:
        pairs = F.arrays_zip(x["key"], x["value"])
        kept = once(pairs, lambda p: F.filter(p, lambda q, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda r: r["key"] == q["key"])))
        single = F.size(F.array_compact(F.array_distinct(x["key"]))) == F.size(x["key"])
        return F.when(single, F.map_from_arrays(x["key"], x["value"])).otherwise(F.map_from_entries(kept))

    def of(h: Column) -> Column:
        return F.when(h != "", once(F.regexp_extract_all(h, F.lit(PAIR), F.lit(0)), split))

    def split(found: Column) -> Column:
        keys = F.transform(found, lambda p: _scalar(bare(F.substring_index(p, ":", 1))))  # a key has no colon
        values = F.transform(found, lambda p: bare(F.substr(p, F.length(F.substring_index(p, ":", 1)) + 2)))
        return once(F.struct(keys.alias("key"), values.alias("value")), latest)

    return once(given, of)


def _raw_front_matter(md: Column) -> Column:
    return _raw_pairs(head(plain_ends(md)))


def _scalar(raw: Column) -> Column:
    """The text of a YAML scalar without blanks around it: quotes and what they escape taken off, comments left out, null and ~ as NULL."""
    blank = ("", "~", "null", "Null", "NULL")

    def of(x: Column) -> Column:
        double = F.regexp_extract(x, '^"((?:[^"\\\\]|\\\\.)*)"\\s*(?:#.*)?$', 1)
        single = F.regexp_extract(x, "^'((?:[^']|'')*)'\\s*(?:#.*)?$", 1)
        plain = once(bare(F.regexp_replace(x, "(?:^|\\s)#.*$", "")), lambda t: F.when(~t.isin(*blank), t))
        unescaped = F.regexp_replace(F.replace(F.replace(double, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), '\\\\(.)', "$1")
        simple = ~(F.startswith(x, F.lit('"')) | F.startswith(x, F.lit("'")) | F.contains(x, F.lit("#")) | x.isin(*blank))
        return (
            F.when(simple, x)  # most values: nothing to match
            .when(F.rlike(x, F.lit('^"(?:[^"\\\\]|\\\\.)*"\\s*(?:#.*)?$')), unescaped)
            .when(F.rlike(x, F.lit("^'(?:[^']|'')*'\\s*(?:#.*)?$")), F.replace(single, F.lit("''"), F.lit("'")))
            .otherwise(plain)
        )

    return once(raw, of)


def scalars(given: Column) -> Column:
    """The pairs of a ``head``, values without their quotes; NULL where it is empty."""
    return F.transform_values(_raw_pairs(given), lambda k, v: _scalar(v))


def front_matter(md: Column) -> Column:
    """map<string, string> of the front matter, its values without their quotes; NULL where there is none."""
    return scalars(head(plain_ends(md)))


def _front_errors(fm: Column, template: Template) -> Column:
    has = lambda k: F.map_contains_key(fm, k)
    value = lambda k: F.element_at(fm, k)
    missing = [_only(~has(k), _error("MISSING_KEY", F.lit(1), F.lit(k))) for k in template.keys]
    whole = [_only(has(k) & ~F.rlike(F.regexp_replace(value(k), "\\s+#.*$", ""), F.lit("^[-+]?\\d+$")), _error("NOT_AN_INTEGER", F.lit(1), F.lit(k))) for k in template.whole]
    given = _scalar(value("difficulty"))
    level = _only(has("difficulty") & ~F.coalesce(given.isin(*template.levels), F.lit(False)), _error("UNKNOWN_DIFFICULTY", F.lit(1), given))
    return F.concat(*missing, *whole, level)


def _item_errors(text: Column, number: Column, units: tuple[str, ...]) -> Column:
    unit = "(?:(?:" + "|".join(map(re.escape, units)) + ")(?= |$) ?)?" if units else ""
    return F.when(~F.startswith(text, F.lit("- ")), F.array(_error("ITEM_EXPECTED", number, text))).otherwise(
        F.when(~F.rlike(text, F.lit("^- \\d+(?:\\.\\d+)?\\s+\\S")), F.array(_error("QUANTITY_EXPECTED", number, text))).otherwise(
            _only(F.rlike(text, F.lit(f"^- \\d+(?:\\.\\d+)?\\s+{unit}\\s*$")), _error("ITEM_EMPTY", number, text))
        )
    )


def _step_errors(text: Column, number: Column, nth: Column) -> Column:
    given = F.regexp_extract(text, "^(\\d+)\\.\\s", 1).try_cast("int")
    wrong = once(given, lambda n: _only(n != nth, _error("STEP_NUMBER", number, n.cast("string"))))
    return F.when(~F.rlike(text, F.lit("^\\d+\\.\\s+\\S")), F.array(_error("STEP_EXPECTED", number, text))).otherwise(wrong)


def _section(lines: Column, begin: Column, end: Column) -> Column:
    """array<struct(line, number)> of the lines with text after ``begin`` and before ``end``, numbered from 1."""
    rows = F.transform(between(lines, begin, end), lambda x, i: F.when(x != "", F.struct(x.alias("line"), (i + begin + 2).alias("number"))))
    return F.filter(rows, lambda r: r.isNotNull())


def _body_errors(lines: Column, template: Template, units: tuple[str, ...]) -> Column:
    def of(at: Column) -> Column:
        i, s, n = at["items"], at["steps"], F.size(lines)
        absent = F.concat(_only(i < 0, _error("MISSING_SECTION", F.lit(None), F.lit(template.items))), _only(s < 0, _error("MISSING_SECTION", F.lit(None), F.lit(template.steps))))
        order = F.array(_error("SECTION_ORDER", s + 1, F.lit(template.steps)))

        def in_items(items: Column) -> Column:
            return F.concat(F.flatten(F.transform(items, lambda r: _item_errors(r["line"], r["number"], units))), _only(F.size(items) == 0, _error("NO_ITEMS", i + 1)))

        def in_steps(steps: Column) -> Column:
            return F.concat(F.flatten(F.transform(steps, lambda r, k: _step_errors(r["line"], r["number"], k + 1))), _only(F.size(steps) == 0, _error("NO_STEPS", s + 1)))

        return F.when((i < 0) | (s < 0), absent).when(s < i, order).otherwise(F.concat(once(_section(lines, i, s), in_items), once(_section(lines, s, n), in_steps)))

    return once(F.struct(last(lines, template.items).alias("items"), last(lines, template.steps).alias("steps")), of)


def errors(md: Column, template: Template, units: tuple[str, ...]) -> Column:
    """array<struct<code, line, what>>; empty for a document that keeps to the template."""

    def of(x: Column) -> Column:
        lines = x["lines"]
        mark = F.nullif(F.array_position(F.slice(lines, F.lit(2), F.size(lines)), F.lit("---")), F.lit(0)).cast("int")
        begun = F.get(lines, F.lit(0)) == "---"

        def closed(mark: Column) -> Column:
            body = F.slice(lines, mark + 2, F.size(lines))
            good = F.concat(once(_raw_front_matter(x["md"]), lambda fm: _front_errors(fm, template)), once(body, lambda b: _body_errors(b, template, units)))
            return F.when(mark.isNull(), F.array(_error("FRONT_MATTER_OPEN", F.lit(1)))).otherwise(good)

        return F.when(~begun, F.array(_error("NO_FRONT_MATTER", F.lit(1)))).otherwise(once(mark, closed))

    given = lambda text: once(F.struct(text.alias("md"), _lines(text).alias("lines")), of)
    return once(md, lambda text: F.when(text.isNull(), F.array(_error("NO_FRONT_MATTER", F.lit(1)))).otherwise(given(text)))


def front_matter_issues(source: Column, other: Column) -> Column:
    """Codes of what differs between the front matter (maps) of a document and of its translation."""
    a, b = (lambda k: F.element_at(source, k)), (lambda k: F.element_at(other, k))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), a("difficulty"))

    def issue(code: str, left: Column, right: Column) -> Column:
        return F.when(~left.eqNullSafe(right), F.lit(code))

    return F.array_compact(
        F.array(
            issue("ID_MISMATCH", a("id"), b("id")),
            issue("LANG_MISMATCH", b("lang"), F.lit("en")),
            issue("SOURCE_LANG_MISMATCH", b("source_lang"), a("lang")),
            issue("SERVINGS_MISMATCH", a("servings"), b("servings")),
            issue("TIME_MIN_MISMATCH", a("time_min"), b("time_min")),
            issue("DIFFICULTY_MISMATCH", b("difficulty"), level),
        )
    )


def verify(source: Column, other: Column, units: tuple[str, ...]) -> Column:
    """Codes of all issues of a translated document against its source; empty where it passes.

    Counts and front matter are compared where both parse; numbers always.
    """

    def counted(md: Column, template: Template) -> Column:
        lines = _lines(F.regexp_replace(plain_ends(md), "(?s)\\A---.*?\\n---[ \\t]*(?:\\n|\\z)", ""))

        def of(x: Column) -> Column:
            marks = F.struct(last(x, template.items).alias("i"), last(x, template.steps).alias("s"))
            return once(marks, lambda m: F.struct(F.size(_section(x, m["i"], m["s"])).alias("items"), F.size(_section(x, m["s"], F.size(x))).alias("steps")))

        return once(lines, of)

    def differs(x: Column) -> Column:
        a, b = x["a"], x["b"]
        counts = F.array(F.when(a["items"] != b["items"], "INGREDIENT_COUNT_MISMATCH"), F.when(a["steps"] != b["steps"], "STEP_COUNT_MISMATCH"))
        return F.concat(front_matter_issues(x["fa"], x["fb"]), F.array_compact(counts))

    def parsed(good: Column) -> Column:
        sides = F.struct(counted(source, SOURCE).alias("a"), counted(other, TRANSLATED).alias("b"), front_matter(source).alias("fa"), front_matter(other).alias("fb"))
        return F.when(good, once(sides, differs)).otherwise(F.array().cast("array<string>"))

    bad = F.struct(F.size(errors(source, SOURCE, units)).alias("a"), F.size(errors(other, TRANSLATED, units)).alias("b"))
    parse = lambda x: F.array_compact(F.array(F.when(x["a"] > 0, "SOURCE_PARSE"), F.when(x["b"] > 0, "TRANSLATED_PARSE")))
    shape = once(bad, lambda x: F.concat(parse(x), parsed((x["a"] == 0) & (x["b"] == 0))))
    same = F.array_sort(numbers(source)) == F.array_sort(numbers(other))
    return F.concat(shape, F.array_compact(F.array(F.when(~same, "P2_NUMBER_INVARIANT"))))
