"""One method for each read or write of the knowledge base; every method returns a DataFrame."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import text
from kgspark.operators import conflicts, entities, facts, relations, retrieval, review, search_index
from kgspark.operators.search_index import SearchIndex
from kgspark.operators.vector_index import VectorIndex
from kgspark.operators.visibility import DIMENSIONS, Principal, visible, visible_rows, with_parent
from kgspark.sources.shared import shared_dir


@dataclass
class KnowledgeEngine:
    """Tables of the knowledge base.

    entities: id, label, is_public, roles, teams, tenant; facts and sources as the operators take them; relations:
    source_id, target_id, relation; documents: id, title, text, lang, verification_level, translation_state and the
    visibility columns; terms: id, namespace, term and, where they are not for all, the visibility columns; links: document_id, entity_id, term_id.
    """

    entities: DataFrame
    facts: DataFrame
    sources: DataFrame
    relations: DataFrame | None = None
    documents: DataFrame | None = None
    terms: DataFrame | None = None
    links: DataFrame | None = None
    vectors: VectorIndex | None = None
    idf: DataFrame | None = field(default=None, repr=False)
    texts: SearchIndex | None = None

    def list_entities(self, principal: Principal, label: str | None = None) -> DataFrame:
        """GET /entities."""
        rows = visible_rows(self.entities, principal)
        return rows if label is None else rows.where(F.col("label") == label)

    def entity_history(self, principal: Principal, entity_id) -> DataFrame:
        """GET /entities/{id}: the versions of its visible facts, each with its neighbours."""
        own = self.facts.where(F.col("entity_id") == F.lit(entity_id))
        return visible_rows(with_parent(facts.history(own), self.entities), principal)

    def entity_facts(self, principal: Principal, entity_id=None, at: Column | None = None) -> DataFrame:
        """GET /entities/{id}/facts: open versions, or those valid at a time."""
        rows = facts.current(self.facts) if at is None else facts.as_of(self.facts, at)
        rows = rows if entity_id is None else rows.where(F.col("entity_id") == F.lit(entity_id))
        return visible_rows(with_parent(rows, self.entities), principal)

    def neighbours(self, principal: Principal, entity_id) -> DataFrame:
        """GET /entities/{id}/relations: outgoing relations to visible targets."""
        target = self.entities.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"), *DIMENSIONS)
        return visible_rows(self.relations.where(F.col("source_id") == F.lit(entity_id)).join(target, "target_id"), principal)

    def search(self, principal: Principal, query: str) -> DataFrame:
        """GET /search: entities, facts, documents and terms that hold the query, filtered before they are matched."""
        seen = visible_rows(with_parent(facts.current(self.facts), self.entities), principal)
        indexes = [("entity", visible_rows(self.entities, principal), "id", ["label"]), ("fact", seen, "id", ["value", "property"])]
        if self.documents is not None:
            indexes.append(("document", visible_rows(self.documents, principal), "id", ["title"]))
        if self.terms is not None:
            indexes.append(("term", self._seen(self.terms, principal), "id", ["term"]))
        return retrieval.search(query, indexes)

    def scan_conflicts(self, known: DataFrame | None = None) -> DataFrame:
        """GET /conflicts: new pairs with their suggestion."""
        found = conflicts.pairs(conflicts.candidates(self.facts, self.sources))
        return found if known is None else conflicts.unreported(found, known)

    def index_documents(self, path: str | None = None) -> VectorIndex:
        """Embed every document once and keep the vectors, by cells, with the weights of tokens; ``retrieve`` reads these."""
        spark = self.documents.sparkSession
        path = path or f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
        idf = retrieval.idf(self.documents).drop("df")
        idf.withColumn("part", search_index.partition(F.col("token"), search_index.PARTITIONS)).repartition("part").sortWithinPartitions("part", "token").write.partitionBy("part").parquet(f"{path}/idf")
        self.idf = spark.read.schema("token string, idf double, part int").parquet(f"{path}/idf")
        vectors = retrieval.dense(retrieval.embed(self.documents.select("id", "text"), self.idf.drop("part")))
        self.vectors = VectorIndex.built(vectors.withColumnRenamed("id", "key"), path)
        return self.vectors

    def retrieve(self, principal: Principal, query: str, lang: str, limit: int = 5, probe: int | None = None) -> DataFrame:
        """POST /rag/query: the visible documents nearest to the query by hashed tf-idf, boosted and explained.

        Only stored vectors are read (those of ``probe`` cells, or all), and of the weights those of the query's words;
        the vectors are made by ``index_documents``, at the latest by the first question.
        """
        if self.vectors is None:
            self.index_documents()
        spark = self.documents.sparkSession
        asked = spark.createDataFrame([("q", query)], "id string, text string")
        words = search_index.placed(spark, query, text.tokens, search_index.PARTITIONS)
        known = self.idf.where(F.col("part").isin([*set(words.values())]) & F.col("token").isin([*words])).drop("part")
        made = retrieval.dense(retrieval.embed(asked, known)).first()
        docs = visible_rows(self.documents, principal)
        near = self.vectors.nearest_to(made.v if made else [0.0] * retrieval.DIMENSIONS, max(limit * 10, 50), probe, docs.select(F.col("id").alias("key")))
        return retrieval.boosted(docs.join(F.broadcast(near.withColumnsRenamed({"key": "id", "score": "cosine"})), "id"), query, lang).orderBy(F.desc("score"), "id").limit(limit)

    def index_texts(self, path: str | None = None) -> SearchIndex:
        """Write the inverted index of labels, types, facts, titles and terms that ``search_ranked`` reads."""
        spark = self.entities.sparkSession
        parts = [("entity", self.entities, ["label", "type"]), ("fact", facts.current(self.facts), ["property", "value"]), ("document", self.documents, ["title"]), ("term", self.terms, ["term"])]
        rows = [t.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("key"), F.concat_ws(" ", *[c for c in names if c in t.columns]).alias("text")) for kind, t, names in parts if t is not None]
        self.texts = SearchIndex.built(reduce(DataFrame.unionByName, rows), path or f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")
        return self.texts

    def search_ranked(self, principal: Principal, query: str, limit: int = 20) -> DataFrame:
        """GET /search: kind, key, score of the visible rows that have words of the query, the best first."""
        if self.texts is None:
            self.index_texts()
        own = {"entity": visible_rows(self.entities, principal), "fact": visible_rows(with_parent(facts.current(self.facts), self.entities), principal)}
        own |= {kind: self._seen(t, principal) for kind, t in (("document", self.documents), ("term", self.terms)) if t is not None}
        return self.texts.ranked(query, limit, seen={kind: t.select(F.col("id").alias("key")) for kind, t in own.items()})

    def glossary(self, principal: Principal, term_id: str) -> DataFrame:
        """GET /glossary/query: visible documents that reach a visible term over their entities; nothing for another one."""
        known = self._seen(self.terms, principal).select(F.col("id").alias("term_id"))
        met = self.links.where(F.col("term_id") == term_id).join(known, "term_id", "left_semi").groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
        return visible_rows(self.documents, principal).join(met, "id")

    def document(self, principal: Principal, document_id, lang: str) -> DataFrame:
        """GET /documents/{id}, with the flag of untranslated content."""
        row = visible_rows(self.documents.where(F.col("id") == F.lit(document_id)), principal)
        return row.withColumn("untranslated", text.untranslated_document(lang, F.col("lang"), F.col("translation_state")))

    def get(self, principal: Principal, table: str, key) -> DataFrame:
        """The visible row of ``entities``, ``documents``, ``terms`` or ``sources`` with an id; no row for any other."""
        rows: DataFrame = getattr(self, table)
        return self._seen(rows.where(F.col("id") == F.lit(key)), principal)

    def list_documents(self, principal: Principal) -> DataFrame:
        """GET /documents."""
        return entities.listed(visible_rows(self.documents, principal))

    def list_terms(self, principal: Principal) -> DataFrame:
        """GET /terms."""
        return entities.listed(self._seen(self.terms, principal))

    def search_terms(self, principal: Principal, query: str) -> DataFrame:
        """GET /terms/search: visible terms that hold the query, shorter ones first."""
        found = self._seen(self.terms, principal).where(F.contains(text.folded(F.col("term")), text.folded(F.lit(query))))
        return found.orderBy(F.length("term"), "id")

    def retrieve_code(self, principal: Principal, query: str, limit: int = 5) -> DataFrame:
        """POST /code/query: retrieval over documents of code, which are in English."""
        return self.retrieve(principal, query, "en", limit)

    def review_conflicts(self, queue: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """POST /conflicts/{id}/approve: facts, queue, audit rows, refused decisions."""
        return review.approved(self.facts, queue, decisions, now)

    def retract_source(self, source_id, edges: DataFrame, reason: str, user: str, now: Column, depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """POST /sources/{id}/invalidate: facts, sources, report, audit row."""
        return review.invalidated(self.facts, self.sources, source_id, edges, reason, user, now, depth)

    def restore_document(self, snapshot: DataFrame) -> DataFrame:
        """What brings a document's facts back to a snapshot of them."""
        own = self.facts.join(snapshot.select("logical_id").distinct(), "logical_id", "left_semi")
        return facts.reconcile(snapshot, own)

    @staticmethod
    def _seen(rows: DataFrame, principal: Principal) -> DataFrame:
        """Visible rows; a table without visibility columns has nothing to hide."""
        return visible_rows(rows, principal) if set(DIMENSIONS) <= set(rows.columns) else rows

    def may_see(self, principal: Principal) -> Column:
        return visible(principal, *map(F.col, DIMENSIONS))

    def upsert_relations(self, batch: DataFrame) -> DataFrame:
        """Relations with the batch's rows in place of those with the same ends and name."""
        return relations.upsert(self.relations, batch, ["source_id", "target_id", "relation"])
