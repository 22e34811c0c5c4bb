"""Domain packs, and what their unit rules and glossaries make of documents.

A pack is a folder of YAML files of a few hundred entries, read on the driver as configuration; its terms become rows, and
its rules are compiled into column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.numbers import quantity_text
from kgspark.functions.text import clean_item, folded
from kgspark.operators.template import once


@dataclass(frozen=True)
class UnitRule:
    rule_id: str
    from_unit: str
    to_unit: str
    factor: str
    rounding: int | None = None


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    language: str = "it"
    canonical_language: str = "en"
    entries: tuple[dict, ...] = ()  # namespace, id, labels_en, labels_it, aliases, definition, ontology_uri, visibility
    units: tuple[UnitRule, ...] = ()
    plurals: dict[str, str] = field(default_factory=dict)  # singular -> plural
    template: str = ""


def _yaml(path: Path):
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8"))


def _entries(raw) -> list | None:
    rows = raw.get("entries") if isinstance(raw, dict) else raw
    return rows if isinstance(rows, list) else None


def validate(folder: str | Path) -> list[str]:
    """Every error of a pack folder; none for a good one."""
    root = Path(folder)
    if not (root / "pack.yaml").is_file():
        return ["pack.yaml: missing"]
    raw = _yaml(root / "pack.yaml")
    if not isinstance(raw, dict):
        return ["pack.yaml: not a mapping"]
    errors = [f"pack.yaml: {k}: missing" for k in ("name", "version", "glossaries", "units_source") if not raw.get(k)]
    if errors:
        return errors
    paths = raw.get("paths") or {}
    template = root / paths.get("template", "template.md")
    if not template.is_file():
        errors.append(f"{template.name}: missing")
    elif not template.read_text(encoding="utf-8").strip():
        errors.append(f"{template.name}: empty")
    for name in raw["glossaries"]:
        path = root / paths.get("glossaries", "glossari") / f"{name}.yaml"
        if not path.is_file():
            errors.append(f"{path.name}: missing")
            continue
        rows = _entries(_yaml(path))
        if rows is None:
            errors.append(f"{path.name}: no list of entries")
            continue
        seen: set[str] = set()
        for i, row in enumerate(rows):
            row = row if isinstance(row, dict) else {}
            errors += [f"{path.name}[{i}]: {k}: must not be empty" for k in ("id", "labels_en", "labels_it") if not str(row.get(k) or "").strip()]
            if row.get("id") in seen:
                errors.append(f"{path.name}[{i}]: duplicate id {row['id']!r}")
            seen.add(row.get("id"))
    path = root / raw["units_source"]
    rows = _yaml(path) if path.is_file() else None
    if not isinstance(rows, list):
        return [*errors, f"{path.name}: {'not a list' if path.is_file() else 'missing'}"]
    seen = set()
    for i, row in enumerate(rows):
        row = row if isinstance(row, dict) else {}
        errors += [f"{path.name}[{i}]: {k}: must not be empty" for k in ("rule_id", "from_unit", "to_unit") if not str(row.get(k) or "").strip()]
        if not isinstance(row.get("factor"), int | float) or row["factor"] <= 0:
            errors.append(f"{path.name}[{i}]: factor: must be a number above 0")
        if row.get("rule_id") in seen:
            errors.append(f"{path.name}[{i}]: duplicate rule_id {row['rule_id']!r}")
        seen.add(row.get("rule_id"))
    return errors


def load(folder: str | Path, plurals: dict[str, str] | None = None) -> Pack:
    """A validated pack; all of its errors in one ValueError."""
    if errors := validate(folder):
        raise ValueError("; ".join(errors))
    root = Path(folder)
    raw = _yaml(root / "pack.yaml")
    paths = raw.get("paths") or {}
    entries = [{"namespace": n, **e} for n in raw["glossaries"] for e in _entries(_yaml(root / paths.get("glossaries", "glossari") / f"{n}.yaml"))]
    units = [UnitRule(u["rule_id"], u["from_unit"], u["to_unit"], str(u["factor"]), u.get("rounding")) for u in _yaml(root / raw["units_source"])]
    template = (root / paths.get("template", "template.md")).read_text(encoding="utf-8")
    return Pack(raw["name"], str(raw["version"]), raw.get("language", "it"), raw.get("canonical_language", "en"), tuple(entries), tuple(units), plurals or {}, template)


TERM = "id string, namespace string, term_id string, label_en string, label_it string, definition string, ontology_uri string, is_public boolean, roles array<string>, teams array<string>"


def terms(spark: SparkSession, pack: Pack) -> DataFrame:
    """A pack's canonical terms with deterministic ids, to be merged by ``relations.upsert`` over the stored ones."""
    rows = [
        (f"{e['namespace']}:{e['id']}", e["namespace"], str(e["id"]), e.get("labels_en", e["id"]), e.get("labels_it", e["id"]), e.get("definition") or "", e.get("ontology_uri"), bool(e.get("is_public", False)), e.get("roles") or [], e.get("teams") or [])
        for e in pack.entries
    ]
    return spark.createDataFrame(rows, TERM)


def known_units(pack: Pack) -> tuple[str, ...]:
    """Every unit that a rule names, and its plural."""
    names = [u for r in pack.units for u in (r.from_unit, r.to_unit)]
    return tuple(dict.fromkeys([*names, *[pack.plurals[u] for u in names if u in pack.plurals]]))


def _spoken(pack: Pack, rule: UnitRule) -> list[str]:
    names = [rule.from_unit, rule.to_unit]
    return [*names, *[pack.plurals[u] for u in names if u in pack.plurals]]


def unit_rule(pack: Pack, unit: Column, value) -> Column:
    """``value(rule)`` of the first rule, in file order, that knows ``unit`` (as source, target or plural)."""
    out = F.lit(None)
    for rule in reversed(pack.units):
        out = F.when(unit.isin(*_spoken(pack, rule)), value(rule)).otherwise(out)
    return out


def _term_map(pack: Pack) -> dict[str, str]:
    """Folded labels and aliases -> English label; a term that two entries have keeps the first."""
    out: dict[str, str] = {}
    for e in pack.entries:
        for t in (e.get("labels_en"), e.get("labels_it"), *(e.get("aliases") or ())):
            if t and t.strip():
                out.setdefault(t.strip().casefold(), e["labels_en"])
    return out


def canonical(doc: Column, pack: Pack) -> Column:
    """struct(items, log, unresolved) of a parsed document.

    Units go by the pack's rules in exact decimals; an item that is a glossary term as a whole, without connectors and
    parentheses, becomes its English label. ``log`` has field, before_text, after_text and the rule of every change;
    ``unresolved`` the items that are no term, each once, for the queue of proposals.
    """
    table = F.create_map(*[F.lit(x) for kv in _term_map(pack).items() for x in kv]) if pack.entries else F.create_map().cast("map<string,string>")

    def item(x: Column) -> Column:
        exact = x["qty"].cast("decimal(18,4)")

        def product(rule: UnitRule) -> Column:
            out = exact * F.lit(rule.factor).cast("decimal(18,12)")
            return (out if rule.rounding is None else F.round(out, rule.rounding)).cast("decimal(38,16)")

        qty = quantity_text(F.coalesce(unit_rule(pack, x["unit"], product), exact.cast("decimal(38,16)")))
        unit = F.coalesce(unit_rule(pack, x["unit"], lambda r: F.lit(r.to_unit)), x["unit"])

        def looked(at: Column) -> Column:
            return F.struct(
                qty.alias("qty"), unit.alias("unit"), F.coalesce(at["found"], x["item"]).alias("item"), F.when(at["found"].isNull(), at["lookup"]).alias("lost"),
                F.coalesce(unit_rule(pack, x["unit"], lambda r: F.lit(r.rule_id)), F.lit("STRUCT-SERIALIZATION")).alias("rule"),
            )

        lookup = lambda t: F.struct(t.alias("lookup"), F.element_at(table, folded(t)).alias("found"))
        return once(once(clean_item(x["item"]), lookup), looked)

    def changes(done: Column) -> Column:
        def of(old: Column, i: Column) -> Column:
            new = F.get(done, i)
            rows = [(f, F.lit("GLOSSARY") if f == "item" else new["rule"]) for f in ("qty", "unit", "item")]
            entry = [F.when(~old[f].eqNullSafe(new[f]), F.struct(F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{f}")).alias("field"), old[f].alias("before_text"), new[f].alias("after_text"), rule.alias("rule_id"))) for f, rule in rows]
            return F.array_compact(F.array(*entry))

        return F.flatten(F.transform(doc["items"], of))

    def parts(done: Column) -> Column:
        lost = F.array_distinct(F.array_compact(F.transform(done, lambda x: x["lost"])))
        return F.struct(F.transform(done, lambda x: F.struct(x["qty"].alias("qty"), x["unit"].alias("unit"), x["item"].alias("item"))).alias("items"), changes(done).alias("log"), lost.alias("unresolved"))

    return F.get(F.transform(F.array(F.transform(doc["items"], item)), parts), F.lit(0))


#: Metric unit, factor and rule of each kitchen unit; units that are metric already; servings to scale to.
METRIC = {
    "tablespoon": ("ml", "15", "DOSE-TABLESPOON"),
    "teaspoon": ("ml", "5", "DOSE-TEASPOON"),
    "cup": ("ml", "250", "DOSE-CUP"),
    "pinch": ("g", "0.5", "DOSE-PINCH"),
    "clove": ("g", "5", "DOSE-CLOVE"),
    "leaf": ("g", "1", "DOSE-LEAF"),
    "sprig": ("g", "1", "DOSE-SPRIG"),
    "sachet": ("g", "7", "DOSE-SACHET"),
    "bunch": ("g", "50", "DOSE-BUNCH"),
    "slice": ("g", "30", "DOSE-SLICE"),
    "thread": ("g", "1", "DOSE-THREAD"),
    "drop": ("ml", "0.05", "DOSE-DROP"),
    "rib": ("g", "20", "DOSE-RIB"),
    "tuft": ("g", "5", "DOSE-TUFT"),
    "walnut": ("g", "10", "DOSE-WALNUT"),
    "grain": ("g", "0.1", "DOSE-GRAIN"),
    "zest": ("g", "1", "DOSE-ZEST"),
    "etto": ("g", "100", "DOSE-ETTO"),
}
NATIVE = ("g", "kg", "ml", "l", "°c", "min", "h")
SERVINGS = 10


def doses(doc: Column, target: int = SERVINGS) -> Column:
    """struct(items, log) of a parsed document with metric units, scaled to ``target`` servings.

    Quantities keep at most two decimals, rounded half up; unknown units stay and are logged. Without servings, or with
    none of them, a document serves four.
    """
    table = F.create_map(*[x for u, (to, factor, rule) in METRIC.items() for x in (F.lit(u), F.struct(F.lit(to).alias("to"), F.lit(factor).cast("decimal(8,2)").alias("factor"), F.lit(rule).alias("rule")))])
    servings = F.coalesce(F.nullif(F.element_at(doc["fm"], "servings").try_cast("int"), F.lit(0)), F.lit(4))

    def item(x: Column) -> Column:
        def of(at: Column) -> Column:
            unit, met = at["unit"], at["met"]
            exact = x["qty"].cast("decimal(14,4)") * F.coalesce(met["factor"], F.lit(1).cast("decimal(8,2)"))
            scaled = F.round((exact * F.lit(target).cast("decimal(6,0)")) / servings.cast("decimal(6,0)"), 2)
            rule = F.when(met.isNotNull(), met["rule"]).when(~unit.isin(*NATIVE, ""), "DOSE-UNKNOWN")
            return F.struct(quantity_text(scaled).alias("qty"), F.nullif(F.coalesce(met["to"], unit), F.lit("")).alias("unit"), x["item"].alias("item"), rule.alias("rule"))

        found = lambda u: F.struct(u.alias("unit"), F.element_at(table, u).alias("met"))
        return once(once(F.lower(F.coalesce(x["unit"], F.lit(""))), found), of)

    def line(x: Column) -> Column:
        return F.concat_ws(" ", x["qty"], x["unit"], x["item"])

    def log(done: Column) -> Column:
        def of(new: Column, i: Column) -> Column:
            told = F.struct(F.concat(F.lit("items["), i.cast("string"), F.lit("]")).alias("field"), line(F.get(doc["items"], i)).alias("before_text"), line(new).alias("after_text"))
            row = lambda x, rule: F.struct(x["field"].alias("field"), x["before_text"].alias("before_text"), x["after_text"].alias("after_text"), rule.alias("rule_id"))
            return once(told, lambda x: F.array_compact(F.array(F.when(new["rule"].isNotNull(), row(x, new["rule"])), row(x, F.lit("DOSE-SCALE")))))

        return F.flatten(F.transform(done, of))

    def parts(done: Column) -> Column:
        return F.struct(F.transform(done, lambda x: F.struct(x["qty"].alias("qty"), x["unit"].alias("unit"), x["item"].alias("item"))).alias("items"), log(done).alias("log"))

    return F.get(F.transform(F.array(F.transform(doc["items"], item)), parts), F.lit(0))


def changelog(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Key, change (added, removed or changed) between two versions of keyed rows; equal ones are left out."""
    a, b = [t.select(key, F.col(value).alias(v), F.lit(True).alias(f"_in_{v}")) for t, v in ((old, "_a"), (new, "_b"))]
    change = F.when(F.col("_in__a").isNull(), "added").when(F.col("_in__b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")
