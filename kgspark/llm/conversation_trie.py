"""12. Conversation prefix trie: chained digests name prefixes, grouping makes them nodes, explosion to ancestors sums subtrees.

Each turn is reduced to the SHA-256 of its role and text and the bytes of its text where it is read; texts do not move. A
conversation's turns, in order, are streamed through a chain: a prefix's digest is the SHA-256 of the digest one turn
shorter and the turn's. Every prefix is a row; those of equal (depth, digest) are one node, and its smallest member names it.

A conversation owns the nodes it names: from some depth on, all of its own prefixes. So subtree sums are pre-aggregated:
what a conversation's own nodes give is summed from its last turn up inside the chain of them, and only the chain's total
is exploded to all ancestors above it, which are the conversation's own shorter prefixes. That is one row for each prefix
and not one for each pair of node and ancestor, so very long conversations do not give quadratic rows.

The ids of the members that end in a node are joined in sorted parts, dealt by range, and hashed part after part, so a
conversation of which there are very many copies is never gathered.

Defined results: turns are ordered by turn, null first; equal turns by role and then by the digest of role and text;
repeated rows are turns of their own; a null role or text counts as empty; rows without conv_id are no conversation; an
empty table has no nodes, not even a root. ``c - c % 5`` has the sign rule of SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgspark.llm.common import joined, stored, table

ROOT = bytes(32)
#: Ids that are joined to one part.
PART = 4096
PREFIXES = "conv_id long, depth long, digest binary, parent binary, n_bytes long, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn (digest), n_bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), name.alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "turn")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("conv_id", "place", "turn", "n_bytes")


def rebuilt(found: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with its first h turns taken from c - c % group; h is the CRC-32 of c's decimals modulo ``most``.

    Further rows of place 0 and no turn stand for the conversations themselves, as some have no turn left.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    all_ = found.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    heads = found.where(F.col("place") < most).where(F.col("conv_id") % group == 0).withColumnRenamed("conv_id", "base")
    taken = all_.join(heads, "base").where("place <= h").select("conv_id", "place", "turn", "n_bytes")
    own = found.where(F.col("place") > h)
    marks = all_.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(taken).unionByName(marks)


def marked(found: DataFrame) -> DataFrame:
    """``turns`` as they are, with the rows of place 0 that ``prefix_trie`` asks for."""
    marks = found.where("place = 1").select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("n_bytes"))
    return found.unionByName(marks)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every prefix of every conversation, in the order of (conv_id, place); a row waits until it is known to be the last."""
    names = ["conv_id", "depth", "digest", "parent", "n_bytes", "ends"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    last: tuple | None = None
    for batch in batches:
        rows = []
        for conv, turn, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "n_bytes")), strict=True):
            if last and last[0] == conv:
                rows.append((*last, False))
                digest, depth = last[2], last[1]
                last = (conv, depth + 1, hashlib.sha256(digest + turn).digest(), digest, n)
            else:
                if last:
                    rows.append((*last, True))
                last = (conv, 0, ROOT, None, 0)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*last, True), types, strict=True)], names=names)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, first (an id), ids: the ids of rows in the order of (digest, conv_id), comma-joined, PART at most."""
    digest, ids = None, []
    for batch in batches:
        rows = []
        for d, i in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (d != digest or len(ids) == PART):
                rows.append((digest, ids[0], ",".join(map(str, ids))))
                ids = []
            digest = d
            ids.append(i)
        if rows:
            yield _parts(rows)
    if ids:
        yield _parts([(digest, ids[0], ",".join(map(str, ids)))])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, ends_sha256 from parts in the order of (digest, first)."""
    digest, state = None, None
    for batch in batches:
        done = []
        for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if d == digest:
                state.update(b"," + ids.encode())
                continue
            if state:
                done.append((digest, state.hexdigest()))
            digest, state = d, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["digest", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])


def prefix_trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie of ``found`` (conv_id, place, turn, n_bytes; place 0 for each conversation).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest.
    """
    c = F.col
    prefixes = stored(found.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_chained, PREFIXES), "prefixes")
    nodes = prefixes.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.count_if("ends").alias("n_ends")
    )  # all members of a node have the same parent and bytes
    chain = Window.partitionBy("conv_id").orderBy(c("depth").desc())
    # Childless are nodes all of whose members end there.
    nodes = nodes.withColumn("leaf", (c("n_convs") == c("n_ends")).cast("long")).withColumn("saved", (c("n_convs") - 1) * c("n_bytes"))
    nodes = nodes.select(
        "depth", "digest", "conv_id", "n_convs", "n_ends", "parent",
        F.sum("leaf").over(chain).alias("leaves"), F.sum("saved").over(chain).alias("saved"), (F.row_number().over(chain) > 1).alias("goes_on"), F.lead("depth").over(chain).isNull().alias("top"),
    )
    nodes = stored(nodes, "nodes")

    above = nodes.where("top").select("conv_id", c("depth").alias("top_depth"), "leaves", "saved")
    given = prefixes.select("conv_id", "depth", "digest").join(above, "conv_id").where("depth < top_depth")
    given = given.groupBy("depth", "digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count_if(c("depth") == c("top_depth") - 1).alias("branches"))

    parts = prefixes.where("ends").select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_in_parts, "digest binary, first long, ids string")
    ends = parts.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_digested, "digest binary, ends_sha256 string")

    none = lambda name: F.coalesce(name, F.lit(0))
    whole = stored(
        nodes.join(given, ["depth", "digest"], "left").join(ends, "digest", "left").select(
            "depth", "digest", "conv_id", "parent", "top", "n_convs", (c("goes_on").cast("long") + none("branches")).alias("n_children"), none("branches").alias("branches"),
            (c("leaves") + none("more_leaves")).alias("n_leaves"), (c("saved") + none("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        ),
        "trie",
    )
    # Below the top of a chain the parent is in the chain; a top's parent is another's, and the root is the parent of very many.
    tops = whole.where("top and depth > 0").select(c("depth").alias("own_depth"), c("digest").alias("own"), (c("depth") - 1).alias("depth"), c("parent").alias("digest"), *whole.columns[2:])
    owners = whole.where("branches > 0").select("depth", "digest", c("conv_id").alias("parent_conv_id"), c("branches").alias("n"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"]
    tops = joined(tops, owners, "depth", "digest").drop("depth", "digest").withColumnsRenamed({"own_depth": "depth", "own": "digest"})
    rest = whole.where("not top or depth = 0").withColumn("parent_conv_id", F.when(c("depth") > 0, c("conv_id")))
    return rest.select(columns).unionByName(tops.select(columns))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(rebuilt(found)).drop("digest")


SQL = """
WITH RECURSIVE
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
crc AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS x FROM numbered
  UNION ALL
  SELECT conv_id, s, i + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(s[i // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE i < 8 * length(s)) AS step
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(x, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(s)
),
rebuilt AS (
  SELECT c.conv_id, n.place, n.role, n.text FROM convs AS c JOIN numbered AS n ON n.conv_id = c.base AND n.place <= c.h
  UNION ALL
  SELECT c.conv_id, n.place, n.role, n.text FROM convs AS c JOIN numbered AS n ON n.conv_id = c.conv_id AND n.place > c.h
),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS n_bytes,
    string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)
),
prefixes AS (
  SELECT conv_id, depth, n_bytes, path FROM steps
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p.path, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.n = p.depth), '')) AS ends_sha256
  FROM prefixes AS p JOIN lengths AS l USING (conv_id) GROUP BY p.path
),
edges AS (
  SELECT n.path AS child, p.path AS parent FROM nodes AS n JOIN prefixes AS p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
),
children AS (SELECT parent, count(*) AS n FROM edges GROUP BY parent),
sums AS (
  SELECT p.path, count_if(NOT EXISTS (SELECT 1 FROM children AS k WHERE k.parent = n.path)) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
  FROM nodes AS n JOIN prefixes AS p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s USING (path)
LEFT JOIN children AS k ON k.parent = n.path
LEFT JOIN edges AS e ON e.child = n.path
LEFT JOIN nodes AS up ON up.path = e.parent
"""
