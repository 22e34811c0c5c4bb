"""Files, node-link graphs and what they register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File extensions by job type, and folders that are never read.
EXTENSIONS = {
    "code": ("py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "go", "java", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx"),
    "document": ("md", "markdown", "txt", "rst", "text"),
    "image": ("png", "jpg", "jpeg", "gif", "webp"),
}
SKIPPED = (".git", ".venv", "__pycache__", ".pytest_cache", ".ruff_cache", "node_modules", ".mypy_cache")
_TEXT = T.StringType()
NODE = T.StructType([T.StructField(c, _TEXT) for c in ("id", "label", "file_type", "type", "source_file", "source_location", "confidence")])
LINK = T.StructType([T.StructField(c, _TEXT) for c in ("source", "_src", "target", "_tgt", "relation", "confidence", "source_file", "source_location")])
#: Relations that say nothing of a node and itself.
SELF_DROPPED = ("imports", "imports_from", "re_exports")
GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("links", T.ArrayType(LINK)), T.StructField("edges", T.ArrayType(LINK))])


def scan_files(spark: SparkSession, root: str, job_type: str) -> DataFrame:
    """Path, modificationTime, length, content of a job type's files below a folder, by path; skipped folders left out."""
    if job_type not in EXTENSIONS:
        raise ValueError(f"unsupported job type {job_type!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kind = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin(*EXTENSIONS[job_type])
    skip = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED)))
    return files.where(kind & ~skip).orderBy("path")


def digests(files: DataFrame) -> DataFrame:
    """Path and SHA-256 of the content."""
    return files.select("path", F.sha2("content", 256).alias("digest"))


def stale(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Files not changed for ``days`` days."""
    return files.where(F.col("modificationTime") < now - F.expr(f"INTERVAL '{int(days)}' DAY"))


def _given(*names: str) -> Column:
    """The first of the columns that is not empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def node_link(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and violations of node-link JSON files, with defaults for what is missing or empty.

    A file is one graph, or with ``lines`` a part of one in every line, so that large graphs are read in splits.

    A link's ends may be called ``_src`` and ``_tgt``. Links without both nodes are dropped, and so are imports of a node by
    itself; other relations of a node to itself stay. Nodes without an id and links without an end are violations (a link
    is named by its ends and file). Of nodes with one id the first by label counts.
    """
    graph = spark.read.schema(GRAPH).option("multiLine", not lines).json(path)
    n = graph.select(F.explode("nodes").alias("n")).select("n.*")
    e = graph.select(F.explode(F.coalesce("links", "edges")).alias("e")).select("e.*")
    e = e.withColumns({"source": F.coalesce("source", "_src"), "target": F.coalesce("target", "_tgt")}).drop("_src", "_tgt")
    bad_node, bad_edge = F.coalesce("id", F.lit("")) == "", F.col("source").isNull() | F.col("target").isNull()
    end = lambda c: F.coalesce(c, F.lit("?"))
    violations = n.where(bad_node).select(F.lit("NODE_WITHOUT_ID").alias("code"), _given("label", "source_file").alias("what"))
    violations = violations.union(e.where(bad_edge).select(F.lit("EDGE_WITHOUT_END"), F.concat_ws(" ", F.concat_ws(" -> ", end("source"), end("target")), "source_file")))
    nodes = n.where(~bad_node).withColumns({"label": _given("label", "id"), "file_type": _given("file_type", "type"), "confidence": F.coalesce(_given("confidence"), F.lit("EXTRACTED"))})
    rest = [c for c in nodes.columns if c not in ("id", "type")]
    nodes = nodes.groupBy("id").agg(F.min(F.struct(*rest)).alias("x")).select("id", "x.*")
    edges = e.where(~bad_edge).withColumns({"relation": F.coalesce(_given("relation"), F.lit("RELATES_TO")), "confidence": F.coalesce(_given("confidence"), F.lit("EXTRACTED"))})
    edges = edges.where(~((F.col("source") == F.col("target")) & F.col("relation").isin(*SELF_DROPPED)))
    edges = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes, edges.select([c for c in LINK.fieldNames() if not c.startswith("_")]), violations


def label_facts(nodes: DataFrame) -> DataFrame:
    """One fact for each node: id, logical_id, entity_id, property, value, source_id, confidence, status."""
    key = F.concat("id", F.lit("__label"))
    return nodes.select(
        key.alias("id"), key.alias("logical_id"), F.col("id").alias("entity_id"), F.lit("label").alias("property"), F.col("label").alias("value"),
        F.when(_given("source_file").isNotNull(), source_id(F.col("source_file"))).alias("source_id"), "confidence", F.lit("valid").alias("status"),
    )


def source_id(uri: Column) -> Column:
    return F.concat(F.lit("src_"), F.sha2(uri, 256))


def registered(nodes: DataFrame, edges: DataFrame, now: Column | None = None) -> DataFrame:
    """Id, uri, type, hash and ingested_at of every source file of nodes and edges, once."""
    files = nodes.select("source_file").union(edges.select("source_file")).where("source_file IS NOT NULL AND source_file <> ''").distinct()
    at = F.lit(None).cast("timestamp_ntz") if now is None else now
    return files.select(source_id(F.col("source_file")).alias("id"), F.col("source_file").alias("uri"), F.lit("file").alias("type"), F.sha2("source_file", 256).alias("hash"), at.alias("ingested_at"))


def code_module(md: Column) -> Column:
    """struct(functions, classes, dependencies) of a module's markdown: bullets by the section above them."""
    lines = F.split(md, "\n")

    def section(name: str) -> Column:
        body = F.regexp_extract(md, f"(?s)(?:\\A|\\n)## {name}(?=\\n)(.*?)(?=\\n## |\\z)", 1)
        return F.transform(F.filter(F.split(body, "\n"), lambda x: F.startswith(x, F.lit("- "))), lambda x: F.substring(x, F.lit(3), F.length(x)))

    return F.struct(*[section(s).alias(s.lower()) for s in ("Functions", "Classes", "Dependencies")], F.size(lines).alias("n_lines"))


def with_front_matter(md: Column, key: str, value: Column) -> Column:
    """A front-matter field set, or added as the last one."""
    head = F.regexp_extract(md, "(?s)\\A---\\n(.*?)\\n---\\n", 1)
    line = F.concat(F.lit(f"{key}: "), value)
    has = F.rlike(head, F.lit(f"(?m)^{key}: "))
    new = F.when(has, F.regexp_replace(head, f"(?m)^{key}: .*$", line)).otherwise(F.concat(head, F.lit("\n"), line))
    return F.concat(F.lit("---\n"), new, F.lit("\n---\n"), F.regexp_replace(md, "(?s)\\A---\\n.*?\\n---\\n", ""))
