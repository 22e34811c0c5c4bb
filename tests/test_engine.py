from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kgspark.engine import KnowledgeEngine
from kgspark.operators.visibility import Principal
from kgspark.sources import graph as g

VIEWER, ADMIN = Principal("u", ("viewer",), (), "t1"), Principal("a", ("admin",))


@pytest.fixture(scope="module")
def engine(spark, sf):
    docs = g.documents(spark, sf).withColumns({"is_public": F.col("id") % 2 == 0, "roles": F.lit(None).cast("array<string>"), "teams": F.lit(None).cast("array<string>"), "tenant": F.lit(None).cast("string")})
    links = docs.select(F.col("id").alias("document_id"), (F.col("id") % 7).alias("entity_id"), F.concat(F.lit("t:"), F.col("id") % 3).alias("term_id"))
    none = F.lit(None)
    terms = spark.range(3).select(F.concat(F.lit("t:"), "id").alias("id"), F.lit("n").alias("namespace"), F.concat(F.lit("term user_1 "), "id").alias("term"), (F.col("id") != 2).alias("is_public"), none.cast("array<string>").alias("roles"), none.cast("array<string>").alias("teams"), none.cast("string").alias("tenant"))
    edges = g.entities(spark, sf).select(F.col("id").alias("source_id"), ((F.col("id") + 1) % 15).alias("target_id"), F.lit("knows").alias("relation"))
    return KnowledgeEngine(g.entities(spark, sf), g.facts(spark, sf), g.sources(spark, sf), edges, docs, terms, links)


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


def test_reads_hide_what_a_principal_may_not_see(engine):
    assert 0 < engine.list_entities(VIEWER).count() < engine.list_entities(ADMIN).count()
    assert 0 < engine.entity_facts(VIEWER).count() < engine.entity_facts(ADMIN).count()
    hidden = {r.target_id for r in engine.neighbours(ADMIN, 1).collect()} - {r.target_id for r in engine.neighbours(VIEWER, 1).collect()}
    assert hidden <= {r.id for r in engine.entities.select("id").collect()}
    assert engine.document(VIEWER, 1, "en").count() == 0 and engine.document(ADMIN, 1, "en").count() == 1


def test_search_is_filtered_first(engine):
    mine, everything = (engine.search(p, "user_1").where("match_type = 'entity'").count() for p in (VIEWER, ADMIN))
    assert 0 < mine < everything
    assert [{r.id for r in engine.search(p, "user_1").where("match_type = 'term'").collect()} for p in (VIEWER, ADMIN)] == [{"t:0", "t:1"}, {"t:0", "t:1", "t:2"}]


def test_approved_conflicts_do_not_come_back(engine):
    none = F.lit(None)
    found = engine.scan_conflicts().withColumns({"id": F.monotonically_increasing_id(), "status": F.lit("pending"), "resolved_by": none.cast("string"), "resolved_at": none.cast("timestamp_ntz")}).persist()
    says = found.select("id", F.col("suggestion").alias("choice"), F.lit("u").alias("user_id"))
    facts, queue, audit, refused = engine.review_conflicts(found, says, now())
    after = KnowledgeEngine(engine.entities, facts, engine.sources)
    assert found.count() == audit.count() > 0 == refused.count() and queue.where("status <> 'approved'").count() == 0
    assert after.scan_conflicts().count() == 0


def test_an_invalidated_source_leaves_no_open_fact(engine):
    edges = engine.facts.where("valid_to IS NULL AND source_id = 3").select(F.col("logical_id").alias("child"), F.concat_ws(":", "entity_id", "property", F.lit(2)).alias("parent"))
    facts, sources, report, _ = engine.retract_source(2, edges, "wrong", "u", now(), 1)
    assert facts.where("source_id = 2 AND valid_to IS NULL").count() == 0
    review = facts.where("status = 'under_review'")
    assert review.count() == report.where("kind = 'under_review'").count() > 0 == review.where("source_id = 2 OR confidence <> 'INFERRED'").count()
    assert [r.id for r in sources.where("status = 'invalidated'").collect()] == [2]


def test_retrieval_finds_a_document_by_its_text(engine):
    row = engine.documents.where("is_public AND length(text) > 800").orderBy("id").first()
    top = engine.retrieve(VIEWER, " ".join(row.text.split()[10:40]), "en", 3).collect()
    assert row.id in [r.id for r in top]
    assert all(r.id % 2 == 0 and r.reason.startswith("cosine=") for r in top)


def test_glossary_groups_entities_by_document(engine):
    assert engine.glossary(VIEWER, "t:2").count() == 0 < engine.glossary(ADMIN, "t:2").count()
    rows = engine.glossary(VIEWER, "t:1").collect()
    assert rows and all(r.id % 2 == 0 and r.id % 3 == 1 and r.entities == [r.id % 7] for r in rows)


def test_lists_and_lookups_show_visible_rows_in_order(engine):
    ids = [r.id for r in engine.list_documents(VIEWER).select("id").collect()]
    assert ids == sorted(ids) and all(i % 2 == 0 for i in ids)
    assert [r.id for r in engine.list_terms(VIEWER).collect()] == ["t:0", "t:1"]
    assert [r.id for r in engine.search_terms(ADMIN, "USER_1 2").collect()] == ["t:2"] and engine.search_terms(VIEWER, "user_1 2").count() == 0
    assert engine.get(VIEWER, "documents", 2).count() == 1 and engine.get(VIEWER, "documents", 1).count() == 0
    assert engine.get(VIEWER, "sources", 2).count() == 1


def test_a_source_is_retracted_with_a_report(engine, spark):
    edges = spark.createDataFrame([], "child string, parent string")
    after, _, report, _ = engine.retract_source(2, edges, "wrong", "u", now(), 1)
    assert after.where("source_id = 2 AND valid_to IS NULL AND status = 'valid'").count() == 0
    assert {r.kind for r in report.select("kind").distinct().collect()} == {"invalidated", "under_review"}
