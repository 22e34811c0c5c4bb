"""Documents as markdown, their canonical form and its change log.

A document is front matter, a section of ``- quantity unit item`` lines and a section of numbered steps. Everything is a
column over one row; logs are one row for each change. Glossaries and unit rules are pack data of a few hundred entries,
given as Python mappings and compiled into the expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.numbers import NUMBER, numbers, quantity_text, same_numbers
from kgspark.functions.text import letters, overlap_coefficient
from kgspark.operators import template
from kgspark.operators.template import once

ITEMS, STEPS = "## Items", "## Steps"
KEYS = ("title", "id", "lang", "servings")
#: The least overlap of each section with its source.
THRESHOLDS = {"title": 0.4, "items": 0.5, "steps": 0.3}


def _spliced(text: Column, pattern: str, put, values: Column | None = None) -> Column:
    """The text with every match replaced by ``put(match, nth, values)``."""

    def joined(x: Column) -> Column:
        pieces = F.transform(x["rest"], lambda p, i: F.when(i < F.size(x["found"]), F.concat(p, put(F.get(x["found"], i), i, x["values"]))).otherwise(p))
        return F.array_join(pieces, "")

    def of(x: Column) -> Column:
        found, rest = F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.split(x, pattern)
        return once(F.struct(found.alias("found"), rest.alias("rest"), (F.lit(None) if values is None else values).alias("values")), joined)

    return once(text, of)


def mask_numbers(text: Column) -> Column:
    """Numbers become {N1}, {N2}, ...; step ordinals and zeros alone stay."""
    return _spliced(text, NUMBER, lambda m, i, v: F.concat(F.lit("{N"), (i + 1).cast("string"), F.lit("}")))


def reinject_numbers(text: Column, values: Column) -> Column:
    """Placeholders become the numbers again; NULL unless they are 1, 2, ... in order and as many."""

    def of(x: Column) -> Column:
        holes = F.regexp_extract_all(x["text"], F.lit("\\{N(\\d+)\\}"), F.lit(1))
        whole = F.transform(x["values"], lambda v, i: (i + 1).cast("string"))
        return F.when(holes == whole, _spliced(x["text"], "\\{N\\d+\\}", lambda m, i, v: F.get(v, i), x["values"]))

    return once(F.struct(text.alias("text"), values.alias("values")), of)


def substitute(text: Column, terms: dict[str, str]) -> Column:
    """Whole-word, case-insensitive replacement in a single pass, longest terms first."""
    if not terms:
        return text
    words = sorted(terms, key=lambda t: (-len(t), t))
    table = F.create_map(*[F.lit(x) for t in words for x in (t.lower(), terms[t])])
    pattern = "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, words)) + ")(?![\\p{L}\\p{N}])"
    return _spliced(text, pattern, lambda m, i, v: F.element_at(table, F.lower(m)))


def translate(text: Column, terms: dict[str, str]) -> Column:
    """A dictionary translation under the guard that no number changes, goes or comes; NULL where one would."""

    def of(x: Column) -> Column:
        out = reinject_numbers(substitute(mask_numbers(x), terms), F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)))
        return once(out, lambda y: F.when(same_numbers(numbers(x), numbers(y)), y))

    return once(text, of)


def parse(md: Column, units: tuple[str, ...]) -> Column:
    """struct(fm map, items array<struct(qty, unit, item)>, steps array<string>).

    It reads what it can: items of the section of items only, steps of the section of steps only, under the heading of any
    template; line ends and blanks may be of any kind. A null document has an empty map and null lists. ``template.errors`` says what a strict reader would object to.
    """
    known = "(?:(" + "|".join(map(re.escape, units)) + ")(?= ) )?"
    # The three parts of an item on lines of their own, as a line holds no line end: one match gives them all.
    line = f"^- (\\d+(?:\\.\\d+)?)\\s+{known}(.*)[\u0085\u2028\u2029]?\\z"

    def given(text: Column) -> Column:
        return once(F.struct(text.alias("text"), template.head(text).alias("head")), parted)

    def parted(x: Column) -> Column:
        fm = F.coalesce(template.scalars(x["head"]), F.create_map().cast("map<string,string>"))
        rest = F.substr(x["text"], F.length(x["head"]) + 1)
        return once(F.struct(fm.alias("fm"), F.transform(F.split(rest, "\n"), template.bare).alias("lines")), sections)

    def sections(x: Column) -> Column:
        body = x["lines"]

        def part(at: Column, other: Column) -> Column:
            end = F.when(at < 0, F.lit(0)).when(other > at, other).otherwise(F.size(body))
            return template.between(body, at, end)

        def between(at: Column) -> Column:
            i, s = at["i"], at["s"]
            items = F.transform(F.filter(part(i, s), lambda y: F.startswith(y, F.lit("- "))), lambda y: F.split(F.regexp_replace(y, line, "$1\n$2\n$3"), "\n"))
            items = F.transform(
                F.filter(items, lambda p: F.size(p) == 3),
                lambda p: F.struct(F.get(p, F.lit(0)).alias("qty"), F.nullif(F.get(p, F.lit(1)), F.lit("")).alias("unit"), F.get(p, F.lit(2)).alias("item")),
            )
            steps = F.filter(F.transform(part(s, i), lambda y: F.regexp_replace(y, "^\\d+\\. ", "\n")), lambda y: F.startswith(y, F.lit("\n")))
            return F.struct(x["fm"].alias("fm"), items.alias("items"), F.transform(steps, lambda y: F.substr(y, F.lit(2))).alias("steps"))

        marks = F.struct(
            template.last(body, ITEMS, template.SOURCE.items, template.TRANSLATED.items).alias("i"), template.last(body, STEPS, template.SOURCE.steps, template.TRANSLATED.steps).alias("s")
        )
        return once(marks, between)

    return once(template.plain_ends(md), given)


def translation_input(doc: Column, items: str = "## Ingredienti", steps: str = "## Procedimento") -> Column:
    """Title and sections without front matter or a line end after them, as a translator gets them."""
    rows = F.transform(doc["items"], lambda x: F.concat_ws(" ", F.lit("-"), x["qty"], x["unit"], x["item"]))
    numbered = F.transform(doc["steps"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    title = F.coalesce(F.element_at(doc["fm"], "title"), F.lit(""))
    return F.array_join(F.concat(F.array(title, F.lit(""), F.lit(items)), rows, F.array(F.lit(""), F.lit(steps)), numbered), "\n")


def render(doc: Column) -> Column:
    """The inverse of ``parse``, with fixed key order and one closing line end."""
    head = F.concat(*[F.concat(F.lit(f"{k}: "), F.element_at(doc["fm"], k), F.lit("\n")) for k in KEYS])
    items = F.transform(doc["items"], lambda x: F.concat_ws(" ", F.lit("-"), x["qty"], x["unit"], x["item"]))
    steps = F.transform(doc["steps"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.lit("---\n"), head, F.lit(f"---\n{ITEMS}\n"), F.array_join(items, "\n"), F.lit(f"\n{STEPS}\n"), F.array_join(steps, "\n"), F.lit("\n"))


def canonical(doc: Column, rules: dict[str, tuple[str, str, int | None]], terms: dict[str, str]) -> Column:
    """Items with unit rules (unit -> target, factor, places) applied exactly and terms replaced as a whole phrase."""
    table = F.create_map(*[F.lit(x) for t, v in terms.items() for x in (t.lower(), v)])

    def item(x: Column) -> Column:
        qty, unit = x["qty"], x["unit"]
        exact = qty.cast("decimal(18,4)")
        for name, (target, factor, places) in rules.items():
            product = exact * F.lit(factor).cast("decimal(18,12)")
            value = quantity_text(product if places is None else F.round(product, places))
            qty = F.when(x["unit"] == name, value).otherwise(qty)
            unit = F.when(x["unit"] == name, target).otherwise(unit)
        return F.struct(qty.alias("qty"), unit.alias("unit"), F.coalesce(F.element_at(table, F.lower(F.trim(x["item"]))), x["item"]).alias("item"))

    return F.struct(doc["fm"].alias("fm"), F.transform(doc["items"], item).alias("items"), doc["steps"].alias("steps"))


def change_log(docs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Key, field, pos, before_text, after_text for every item field and step that differs.

    Added and removed lines have a NULL side.
    """

    def given(a: Column, b: Column, field: str, text) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1)
        rows = F.transform(at, lambda i: F.struct(F.lit(field).alias("field"), i.alias("pos"), text(F.get(a, i)).alias("before_text"), text(F.get(b, i)).alias("after_text")))
        return F.filter(rows, lambda r: ~r["before_text"].eqNullSafe(r["after_text"]))

    old, new = F.col(before), F.col(after)
    fields = [given(old["items"], new["items"], f"items.{f}", lambda x, f=f: x[f]) for f in ("qty", "unit", "item")]
    steps = given(old["steps"], new["steps"], "steps", lambda x: x)
    return docs.select(key, F.inline(F.concat(*fields, steps)))  # both sides are in one row: nothing moves


def replay(docs: DataFrame, key: str, before: str, log: DataFrame) -> DataFrame:
    """Key, items array<struct(qty, unit, item)>: the items of ``before`` with the log applied, in their row."""
    # Of several rows of the log for one place the largest text counts.
    place = F.concat_ws(":", "field", "pos")
    edits = log.where("field LIKE 'items.%'").repartition(key).groupBy(key, place.alias("place"), "pos").agg(F.max("after_text").alias("text"))
    edits = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "text"))).alias("edits"), F.max("pos").alias("most"))
    held = docs.select(key, F.col(f"{before}.items").alias("old")).join(edits, key, "left")

    def item(i: Column) -> Column:
        def value(f: str) -> Column:
            name = F.concat(F.lit(f"items.{f}:"), i.cast("string"))
            return F.when(F.coalesce(F.map_contains_key("edits", name), F.lit(False)), F.element_at("edits", name)).otherwise(F.get("old", i)[f])

        return F.struct(*[value(f).alias(f) for f in ("qty", "unit", "item")])

    last = F.greatest(F.coalesce(F.size("old"), F.lit(0)) - 1, F.coalesce("most", F.lit(0)), F.lit(0))
    rows = F.filter(F.transform(F.sequence(F.lit(0), last), item), lambda x: x["qty"].isNotNull() | x["unit"].isNotNull() | x["item"].isNotNull())
    done = held.select(key, rows.alias("items"))
    return done.where(F.size("items") > 0)


def verify_counts(source: Column, other: Column) -> Column:
    """Coded issues of a translated document against its source."""

    def issue(code: str, bad: Column) -> Column:
        return F.when(bad, F.lit(code))

    def content(doc: Column) -> Column:
        qty = F.transform(doc["items"], lambda x: x["qty"])
        return F.array_sort(F.concat(qty, F.flatten(F.transform(doc["steps"], lambda s: numbers(s)))))

    return F.array_compact(
        F.array(
            issue("INGREDIENT_COUNT_MISMATCH", F.size(source["items"]) != F.size(other["items"])),
            issue("STEP_COUNT_MISMATCH", F.size(source["steps"]) != F.size(other["steps"])),
            issue("SERVINGS_MISMATCH", ~F.element_at(source["fm"], "servings").eqNullSafe(F.element_at(other["fm"], "servings"))),
            issue("P2_NUMBER_INVARIANT", content(source) != content(other)),
        )
    )


def verify_sections(source: Column, other: Column) -> Column:
    """array<struct(section, overlap, escalate)>: token overlap of each section against its threshold."""

    def tokens(doc: Column, section: str) -> Column:
        if section == "title":
            return letters(F.element_at(doc["fm"], "title"))
        lines = F.transform(doc["items"], lambda x: x["item"]) if section == "items" else doc["steps"]
        return letters(F.array_join(lines, " "))

    def row(section: str, least: float) -> Column:
        met = F.struct(F.array_distinct(tokens(source, section)).alias("a"), F.array_distinct(tokens(other, section)).alias("b"))
        o = once(met, lambda x: F.round(overlap_coefficient(x["a"], x["b"]), 6))
        return once(o, lambda x: F.struct(F.lit(section).alias("section"), x.alias("overlap"), (x < least).alias("escalate")))

    return F.array(*[row(s, t) for s, t in THRESHOLDS.items()])


#: What a document says of its part of the graph.
GRAPH_ROW = "array<struct<kind:string,pos:int,label:string,property:string,value:string,fm:map<string,string>>>"


def graph_rows(docs: DataFrame, key: str, doc: str, beside: str | None = None) -> DataFrame:
    """The rows of parsed documents' graph in one table, each by its document's key: key, kind (document, item, step or
    fact), id, pos, label, property, value, fm.

    A document's row has its front matter and as label the column ``beside``. Every document is looked at once, and its rows
    stay where it is: nothing moves. Ids are made of the rows, outside of lambdas.
    """

    def row(kind: str, pos=None, label=None, property_=None, value=None, fm=None) -> Column:
        given = {"pos": (pos, "int"), "label": (label, "string"), "property": (property_, "string"), "value": (value, "string"), "fm": (fm, "map<string,string>")}
        return F.struct(F.lit(kind).alias("kind"), *[(F.lit(None) if c is None else c).cast(type_).alias(name) for name, (c, type_) in given.items()])

    def told(d: Column) -> Column:
        items = F.transform(d["items"], lambda x, i: row("item", i, x["item"]))
        steps = F.transform(d["steps"], lambda x, i: row("step", i, x))
        fact = lambda p: F.transform(d["items"], lambda x, i: row("fact", i, property_=F.lit(p), value=x[p]))
        none = F.array().cast(GRAPH_ROW)
        whole = F.array(row("document", label=None if beside is None else F.col(beside), fm=d["fm"]))
        return F.concat(whole, *[F.coalesce(rows, none) for rows in (items, steps, fact("qty"), fact("unit"))])

    rows = docs.select(key, F.inline(once(F.col(doc), told))).where("kind <> 'fact' OR value IS NOT NULL")
    part = F.when(F.col("kind") == "step", "step").when(F.col("kind") != "document", "item")
    fact = F.col("kind") == "fact"
    return rows.select(key, "kind", F.concat_ws(":", key, part, "pos").alias("id"), F.when(~fact, F.col("pos")).alias("pos"), "label", "property", "value", "fm")


def subgraph(docs: DataFrame, key: str, doc: str) -> dict[str, DataFrame]:
    """Document, entity and fact rows of parsed documents; ``recompose`` is the inverse."""
    rows = graph_rows(docs, key, doc)
    entity = rows.where("kind IN ('item', 'step')").select(key, "id", "pos", F.col("kind").alias("type"), "label")
    fact = rows.where("kind = 'fact'").select(F.col("id").alias("entity_id"), "property", "value")
    return {"document": rows.where("kind = 'document'").select(key, "fm"), "entity": entity, "fact": fact}


def recompose(graph: dict[str, DataFrame], key: str) -> DataFrame:
    """Key, doc (as ``parse`` gives it) from the rows of ``subgraph``."""
    none = lambda kind: F.lit(None).cast(kind)
    text, place, map_ = none("string"), none("int"), none("map<string,string>")
    of = graph["entity"].select(key, F.col("id").alias("entity_id"))
    document = graph["document"].select(key, F.lit("document").alias("kind"), text.alias("id"), place.alias("pos"), text.alias("label"), text.alias("property"), text.alias("value"), "fm")
    entity = graph["entity"].select(key, "type", "id", "pos", "label", text, text, map_)
    fact = graph["fact"].join(of, "entity_id").select(key, F.lit("fact"), "entity_id", place, text, "property", "value", map_)
    return recomposed(document.union(entity).union(fact), key).select(key, "doc")


def recomposed(rows: DataFrame, key: str) -> DataFrame:
    """key, doc, label (that of the document's row) from ``graph_rows``, those of a document met once by its key; documents
    without entities are left out. Of several facts for one property the largest value counts."""
    of = lambda kind, *columns: F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns)))
    facts = lambda p: F.collect_list(F.when((F.col("kind") == "fact") & (F.col("property") == p), F.struct("id", "value"))).alias(p)
    whole = F.col("kind") == "document"
    met = rows.groupBy(key).agg(
        F.sort_array(of("item", "pos", "id", "label")).alias("items"), F.sort_array(of("step", "pos", "id", "label")).alias("steps"), facts("qty"), facts("unit"),
        F.first(F.when(whole, F.col("fm")), True).alias("fm"), F.first(F.when(whole, F.col("label")), True).alias("label"), F.max(whole).alias("whole"),
    )

    def value(p: str, id_: Column) -> Column:
        return F.array_max(F.transform(F.filter(p, lambda f: f["id"] == id_), lambda f: f["value"])).alias(p)

    items = F.transform("items", lambda e: F.struct(value("qty", e["id"]), value("unit", e["id"]), e["label"].alias("item")))
    doc = F.struct("fm", items.alias("items"), F.transform("steps", lambda e: e["label"]).alias("steps"))
    made = met.where(F.col("whole") & (F.size("items") + F.size("steps") > 0))
    return made.select(key, F.inline(F.array(F.struct(doc.alias("doc"), "label"))))  # a generator: the document is made once
