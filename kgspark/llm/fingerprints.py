"""2. Document fingerprints: a Merkle tree over leaves, paragraphs, sections and the document. Native.

Sections end at empty lines, paragraphs at line ends; together they hold every character. A paragraph's node is the
SHA-256 of its text, each node above is the SHA-256 of its children's nodes, and the root is the document's fingerprint:
texts are equal where their roots are, and following the branches that differ finds edits without comparing the rest. Below
a paragraph stand its leaves, which end at the end of a sentence or after RUN words; the likeness of two documents is the
share of leaves (by 64-bit hash) they have in common (Dice).

Defined results: a null text is empty and an empty text has no leaves; two documents without leaves are alike (1.0); a
null doc_id comes last in the order; repeated rows share one place in it and repeat their result; the next of a single
document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import documents, stored, table

RUN = 8
LEAF = f"(?s)\\s++|(?:\\S*[^\\s.!?]\\s*+){{0,{RUN - 1}}}\\S++\\s*+"


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ","), 256)


def tree(text: Column) -> Column:
    """array of sections, each struct(node, paragraphs), each paragraph struct(node, leaves array<long>)."""

    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n"), lambda p: F.struct(F.sha2(p, 256).alias("node"), paragraph(p).alias("leaves")))

    return F.transform(F.transform(F.split(text, "\n\n"), section), lambda p: F.struct(_node(p["node"]).alias("node"), p.alias("paragraphs")))


def root(tree_: Column) -> Column:
    return _node(tree_["node"])


def leaves(tree_: Column) -> Column:
    """The distinct leaves of a tree."""
    return F.array_distinct(F.flatten(F.flatten(F.transform(tree_["paragraphs"], lambda p: p["leaves"]))))


def paragraphs(tree_: Column) -> Column:
    """The nodes of all paragraphs, in order."""
    return F.flatten(F.transform(tree_["paragraphs"], lambda p: p["node"]))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves; 1.0 for two without any."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) * 2.0 / n)


def following(ids: DataFrame) -> DataFrame:
    """h1, h2 -> n1, n2: each row's successor by descending doc_id; the last one's is the first.

    Ranges of the order are numbered and written as a table, so that all that follows reads the same numbers; rows find
    their successor inside their range, and only one row of each range (so as many as there are tasks) is ordered in one
    place.
    """
    ids = ids.distinct()
    order = [F.desc_nulls_last("doc_id"), F.asc("h1"), F.asc("h2")]
    parts = max(2, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    row = F.struct("h1", "h2")
    own = Window.partitionBy("part").orderBy(*order)
    ahead = dealt.withColumn("ahead", F.lead(row).over(own)).withColumn("nth", F.row_number().over(own))
    firsts = ahead.where("nth = 1").select("part", row.alias("first"))
    across = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(across), F.first("first").over(whole)).alias("turn"))
    met = ahead.join(firsts, "part").withColumn("ahead", F.coalesce("ahead", "turn"))
    return met.select("h1", "h2", F.col("ahead.h1").alias("n1"), F.col("ahead.h2").alias("n2"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, tree of every row."""
    rows = documents(docs).withColumn("tree", tree(F.col("text")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), root(F.col("tree")).alias("fingerprint"), "tree")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the second half replaced by the next one's beginning."""
    rows = documents(docs).withColumn("h1", F.xxhash64("doc_id", "text")).withColumn("h2", F.xxhash64(F.lit(1), "doc_id", "text")).repartition("h1", "h2")
    after = following(documents(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("h2")))
    own = rows.join(after, ["h1", "h2"]).withColumn("tree", tree(F.col("text"))).withColumn("n_chars", F.length("text"))
    own = own.select(
        "doc_id", "n_chars", "n1", "n2",
        F.substring("text", F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")).alias("head"),
        root(F.col("tree")).alias("fingerprint"), leaves(F.col("tree")).alias("leaves"),
        F.transform(paragraphs(F.col("tree")), lambda p: F.xxhash64(p)).alias("paragraphs"),  # short, to be shuffled
    )
    nth = Window.partitionBy("n1", "n2").orderBy("doc_id")
    # Repeated rows stand for one: the same shuffle as the first join's.
    after_text = rows.select("doc_id", F.col("text").alias("next_text"), F.col("h1").alias("n1"), F.col("h2").alias("n2")).withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("doc_id", "nth")
    met = own.join(after_text, ["n1", "n2"])
    met = met.withColumn("edited", F.concat("head", F.substring("next_text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")))).drop("head", "n1", "n2")
    met = met.withColumn("edited_tree", tree(F.col("edited"))).withColumn("next_leaves", leaves(tree(F.col("next_text"))))
    return met.withColumn("edited_paragraphs", F.transform(paragraphs(F.col("edited_tree")), lambda p: F.xxhash64(p)))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.size(F.filter(F.sequence(F.lit(0), F.size("paragraphs") - 1), lambda i: F.get("paragraphs", i) == F.get("edited_paragraphs", i)))
    return edits(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", root(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaves(F.col("edited_tree"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.size("paragraphs").cast("long").alias("n_paragraphs"), same.cast("long").alias("n_same_paragraphs"),
    )
