"""Modules of a code graph, their documents, and the edges between their symbols.

nodes: id, label, file_type, source_file, source_location, kind (module, function or class); edges: source, target,
relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relations that make a module depend on another.
DEPENDS = ("imports_from", "re_exports")
#: What each kind of symbol is called in ids, and the term it is normalized to.
KINDS = {"function": ("fn", "CODE-FUNCTION"), "class": ("cls", "CODE-CLASS"), "dependency": ("dep", "CODE-DEPENDENCY")}


def line_number(location: Column) -> Column:
    """123 of ``L123``; 0 where there is none."""
    return F.coalesce(F.regexp_extract(location, "^L(\\d+)$", 1).try_cast("int"), F.lit(0))


def document_id(source_file: Column, prefix: str = "id_code_") -> Column:
    """Letters, digits and underscores stay, so that ``a__b`` and ``a_b`` are two; ``module`` where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(source_file, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(slug, F.lit("")), F.lit("module")))


def symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """document_id, kind, position, node_id, label of every function, class and dependency of a module.

    Functions and classes are in the order of (line, label), dependencies by label, each once. Symbols of files without a
    module are left out.
    """
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("module_id"), F.col("label").alias("module"), "source_file")
    own = nodes.where("kind IN ('function', 'class')").join(modules.select("source_file").distinct(), "source_file", "left_semi")
    own = own.select("source_file", "kind", F.col("id").alias("node_id"), F.coalesce("label", "id").alias("label"), line_number(F.col("source_location")).alias("line"))
    ends = edges.where(F.col("relation").isin(*DEPENDS)).select(F.col("source").alias("module_id"), F.col("target").alias("target_id"))
    to = modules.select(F.col("module_id").alias("target_id"), F.col("module").alias("label"))
    needs = ends.join(modules.select("module_id", "source_file"), "module_id").join(to, "target_id").select("source_file", "label").distinct()
    needs = needs.select("source_file", F.lit("dependency").alias("kind"), F.lit(None).cast("string").alias("node_id"), "label", F.lit(0).alias("line"))
    by = Window.partitionBy("source_file", "kind").orderBy("line", "label", "node_id")
    return own.unionByName(needs).select(document_id(F.col("source_file")).alias("document_id"), "source_file", "kind", (F.row_number().over(by) - 1).alias("position"), "node_id", "label")


def documents(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, md: the canonical markdown of every module, also of those without symbols."""
    part = F.struct("position", "label")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, part))).alias(k) for k in KINDS]
    grouped = found.groupBy("source_file").agg(*lists)
    modules = nodes.where("kind = 'module'").groupBy("source_file").agg(F.min("label").alias("title"))

    def bullets(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), F.array().cast("array<struct<position:int,label:string>>")), lambda x: F.concat(F.lit("- "), x["label"]))

    head = F.array(F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("id: "), "source_file"), *map(F.lit, ("lang: en", "source_lang: en", "verification_level: L1", "canonical_version: 1", "---", "## Functions")))
    lines = F.concat(head, bullets("function"), F.array(F.lit("## Classes")), bullets("class"), F.array(F.lit("## Dependencies")), bullets("dependency"))
    return modules.join(grouped, "source_file", "left").select(document_id(F.col("source_file")).alias("document_id"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("md"))


def entity_rows(found: DataFrame, namespace: str = "codice") -> DataFrame:
    """Id, document_id, type, label, position, term_id of the entities of all modules."""
    short = F.create_map(*[F.lit(x) for k, (s, _) in KINDS.items() for x in (k, s)])
    term = F.create_map(*[F.lit(x) for k, (_, t) in KINDS.items() for x in (k, f"{namespace}:{t}")])
    return found.select(
        F.concat_ws(":", "document_id", F.element_at(short, F.col("kind")), "position").alias("id"), "document_id",
        F.col("kind").alias("type"), "label", "position", F.element_at(term, F.col("kind")).alias("term_id"), "node_id",
    )


def relations(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id, relation between symbols, each once; edges to anything else are left out."""
    ids = entities.where("node_id IS NOT NULL").select("node_id", "id")
    met = edges.join(ids.select(F.col("node_id").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("node_id").alias("target"), F.col("id").alias("target_id")), "target")
    return met.select("source_id", "target_id", F.coalesce("relation", F.lit("RELATES_TO")).alias("relation")).distinct()
