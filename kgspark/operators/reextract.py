"""Documents extracted anew after the glossary changed, and only those that the change touches.

An item of a document gives a fact ``term``: the entry of the longest alias that the item holds as whole words. A glossary
change (an approved proposal, or the rollback of one) names the aliases that only one of both glossaries has. A document can
hold such an alias only if one of its items holds the alias's rarest word. An inverted index of the different items tells
these from the partitions of these words alone. The items of these documents are extracted anew, and what differs from their
open facts is written by ``FactStore`` at once: changed values as new versions, new ones as inserts (also where only closed
versions are left), vanished ones closed; nothing is deleted, and partitions without a difference keep their files.

Document, place and value are what is shuffled and stored; ids are made of them afterwards.

A write that broke off is repeated by the same call: it finds the differences that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import folded
from kgspark.operators.curator import longest_alias
from kgspark.operators.fact_store import FactStore
from kgspark.operators.search_index import SearchIndex
from kgspark.sources.shared import stored

PROPERTY = "term"
#: Rows of a task that makes ids.
TASK_ROWS = 1_000_000


def entries(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """document_id, pos, value of every item (document_id, pos, item).

    value is null where the item is null or holds no alias (alias, entry_id). Equal items are looked up once.
    """
    found = stored(longest_alias(items.select(F.col("item").alias("term")).distinct(), aliases))  # its size is known: few are broadcast
    rows = items.join(found.select(F.col("term").alias("item"), F.col("entry_id").cast("string").alias("value")), "item", "left")
    return rows.select("document_id", "pos", "value")


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (document_id, pos, others) with logical_id, entity_id and property."""
    entity = F.concat_ws(":", "document_id", F.lit("item"), "pos")
    return rows.withColumns({"logical_id": F.concat_ws(":", entity, F.lit(PROPERTY)), "entity_id": entity, "property": F.lit(PROPERTY)})


def extracted(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """document_id, logical_id, entity_id, property, value of every item, as ``entries`` has them."""
    return named(entries(items, aliases)).select("document_id", "logical_id", "entity_id", "property", "value")


def first_facts(items: DataFrame, aliases: DataFrame, at: Column) -> DataFrame:
    """The facts of a first extraction, open since ``at``."""
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // TASK_ROWS))
    rows = named(entries(items, aliases).where("value IS NOT NULL").repartition(parts, "document_id", "pos").distinct())
    return rows.select(
        F.concat("logical_id", F.lit("__v_1")).alias("id"), "logical_id", "entity_id", "property", "value", F.lit("EXTRACTED").alias("confidence"),
        F.lit("valid").alias("status"), at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )


@dataclass
class ItemIndex:
    """The inverted index of the words of different items (``texts``), and the documents' items themselves."""

    texts: SearchIndex
    items: DataFrame

    def documents(self, phrases: DataFrame) -> DataFrame:
        """document_id of those with an item that holds the rarest word of a phrase (phrase)."""
        found = stored(self.texts.candidates(phrases).select(F.col("key").alias("item")))
        return self.items.join(found, "item", "left_semi").select("document_id").distinct()

    def candidates(self, phrases: DataFrame) -> DataFrame:
        """``documents`` as ``SearchIndex`` gives them: kind, key."""
        return self.documents(phrases).select(F.lit("item").alias("kind"), F.col("document_id").cast("string").alias("key"))


def indexed(items: DataFrame, path: str) -> ItemIndex:
    """The index of the items' words; equal items are indexed once."""
    texts = items.select("item").distinct().select(F.lit("item").alias("kind"), F.col("item").alias("key"), folded(F.col("item")).alias("text"))
    return ItemIndex(SearchIndex.built(texts, path), items)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """alias: those of which one of both glossaries (alias, entry_id) has a pair that the other has not."""
    b, a = [t.select(F.trim(folded(F.col("alias"))).alias("alias"), "entry_id").distinct() for t in (before, after)]
    return b.subtract(a).union(a.subtract(b)).select("alias").distinct()


def reextract(store: FactStore, index: ItemIndex, items: DataFrame, before: DataFrame, after: DataFrame, now: Column, author: str | None = None) -> DataFrame:
    """Bring the facts of ``store`` from the glossary ``before`` to ``after``; ``before`` and ``after`` swapped roll it back.

    Returns, for each document that was extracted anew: document_id, n_created, n_versions, n_invalidated, n_refused (items
    of different texts at one place are refused).
    """
    touched = index.documents(difference(before, after).select(F.col("alias").alias("phrase")))
    own = stored(items.join(touched, "document_id", "left_semi"))
    asks = named(entries(own, after)).select("document_id", "logical_id", "value")
    met = store.met(asks, ["value"])
    open_ = F.coalesce("held.open", F.lit(False))
    met = met.where(F.when(F.col("value").isNull(), open_).otherwise(~open_ | ~F.col("held.value").eqNullSafe(F.col("value"))))
    met = met.dropDuplicates(["logical_id", "value"])  # different items at one place may give the same
    entity = F.left("logical_id", F.length("logical_id") - len(PROPERTY) - 1)
    to = F.struct("value", F.lit(PROPERTY).alias("property"), entity.alias("entity_id"))
    met = met.select("document_id", "logical_id", "held", to.alias("to"), F.lit(author).cast("string").alias("author"), F.col("value").isNull().alias("closes"))
    done = store.carry_out(met, now, reopen=True)
    told = own.select("document_id", F.lit(None).cast("string").alias("kind")).union(done.select("document_id", "kind"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    counts = {"n_created": "create", "n_versions": "update", "n_invalidated": "invalidate", "n_refused": "refused"}
    return told.groupBy("document_id").agg(*[of(kind).alias(name) for name, kind in counts.items()])
