from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kgspark.functions import numbers
from kgspark.operators import code, entities, evaluation, jobs, normalize, review
from kgspark.sources import artifacts

T = dt.datetime(2030, 1, 1)
FACT = "id string, logical_id string, entity_id string, property string, value string, source_id string, confidence string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


def fact(name, entity, value, source, confidence="EXTRACTED"):
    return (f"{name}@1", name, entity, "p", value, source, confidence, "valid", dt.datetime(2024, 1, 1), None)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([fact("a", "e1", "x", "s1"), fact("b", "e1", "y", "s2"), fact("c", "e1", "z", "s3", "INFERRED"), fact("d", "e2", "w", "s3", "INFERRED"), fact("e", "e3", "v", "s3", "INFERRED"), fact("f", "e3", "u", "s3")], FACT)


QUEUE = "id int, entity_id string, property string, value_a string, value_b string, source_id_a string, source_id_b string, status string, resolved_by string, resolved_at timestamp_ntz"


def test_approval_closes_the_loser_and_is_audited(spark, facts):
    queue = spark.createDataFrame([(1, "e1", "p", "x", "y", "s1", "s2", "pending", None, None), (2, "e1", "p", "x", "q", "s1", "s2", "pending", None, None), (3, "e1", "p", "x", "y", "s1", "s2", "approved", "u", T)], QUEUE)
    say = spark.createDataFrame([(1, "a", "u1"), (2, "a", "u1"), (3, "b", "u1"), (4, "a", "u1")], "id int, choice string, user_id string")
    after, queue2, audit, refused = review.approved(facts, queue, say, now())
    assert {r.logical_id: r.status for r in after.collect()} == {**dict.fromkeys("acdef", "valid"), "b": "obsolete"}
    assert {r.id: (r.status, r.resolved_by) for r in queue2.collect()} == {1: ("approved", "u1"), 2: ("pending", None), 3: ("approved", "u")}
    assert [(r.entity_id, r.new_value) for r in audit.collect()] == [("1", '{"status":"approved","choice":"a","winning_value":"x","losing_value":"y"}')]
    assert {r.id: r.reason for r in refused.collect()} == {2: "LOSING_FACT_NOT_FOUND", 3: "ALREADY_RESOLVED", 4: "NOT_FOUND"}


def test_only_touched_entities_are_scanned(spark, facts):
    sources, known = spark.createDataFrame([], "id string, ingested_at timestamp_ntz"), spark.createDataFrame([], QUEUE)
    some = review.detected(facts, sources, known, spark.createDataFrame([("e1",)], "entity_id string"))
    assert some.count() == 3 == review.detected(facts, sources, known).count()
    assert review.detected(facts, sources, known, spark.createDataFrame([("e2",)], "entity_id string")).count() == 0


@pytest.mark.parametrize(("depth", "want"), [(0, set()), (1, {"c"}), (2, {"c", "d"}), (3, {"c", "d", "e"})])
def test_a_source_s_facts_close_and_dependents_come_under_review(spark, facts, depth, want):
    sources = spark.createDataFrame([("s1", "u"), ("s3", "v")], "id string, uri string")
    edges = spark.createDataFrame([("d", "c"), ("e", "d")], "child string, parent string")
    after, marked, report, audit = review.invalidated(facts, sources, "s1", edges, "wrong", "u1", now(), depth)
    assert {r.fact_id for r in report.collect() if r.kind == "invalidated"} == {"a"}
    assert {r.fact_id for r in report.collect() if r.kind == "under_review"} == want
    open_ = {r.logical_id: r.status for r in after.where("valid_to IS NULL").collect()}
    assert open_ == {k: "under_review" if k in want else "valid" for k in "bcdef"}
    assert after.count() == facts.count() + len(want)
    assert [r.invalidation_reason for r in marked.orderBy("id").collect()] == ["wrong", None]
    assert audit.first().new_value == f'{{"reason":"wrong","invalidated":1,"under_review":{len(want)},"max_depth":{depth}}}'


def test_invalidations_in_a_row_keep_each_other_s_marks(spark, facts):
    sources = spark.createDataFrame([("s1", "u"), ("s2", "v"), ("s3", "w")], "id string, uri string")
    edges = spark.createDataFrame([], "child string, parent string")
    after, marked, *_ = review.invalidated(facts, sources, "s1", edges, "first", "u1", now(), 0)
    _, marked, *_ = review.invalidated(after, marked, "s2", edges, "second", "u2", now(), 0)
    got = {r.id: (r.status, r.invalidation_reason, r.invalidated_by, r.invalidated_at) for r in marked.collect()}
    assert got == {"s1": ("invalidated", "first", "u1", T), "s2": ("invalidated", "second", "u2", T), "s3": (None, None, None, None)}
    held = sources.selectExpr("*", "'active' AS status", "'old' AS invalidation_reason")
    marked = review.invalidated(facts, held, "s1", edges, "new", "u1", now(), 0)[1]
    assert {r.id: (r.status, r.invalidation_reason) for r in marked.collect()} == {"s1": ("invalidated", "new"), "s2": ("active", "old"), "s3": ("active", "old")}


def test_a_fact_that_is_not_inferred_ends_the_path(spark):
    rows = [fact("A", "e1", "x", "s1"), fact("B", "e2", "y", "s2", "EXTRACTED"), fact("C", "e3", "z", "s2", "INFERRED"), fact("D", "e2", "w", "s2", "INFERRED"), fact("E", "e4", "w", "s2", "INFERRED"), fact("F", "e4", "v", "s2", "INFERRED")]
    facts_ = spark.createDataFrame(rows, FACT)
    sources = spark.createDataFrame([("s1", "u")], "id string, uri string")
    edges = spark.createDataFrame([("B", "A"), ("C", "B")], "child string, parent string")
    report = review.invalidated(facts_, sources, "s1", edges, "r", "u", now())[2]
    assert sorted(map(tuple, report.collect())) == [("invalidated", "A")]
    edges = edges.union(spark.createDataFrame([("E", "A"), ("A", "E")], "child string, parent string"))  # a cycle
    report = review.invalidated(facts_, sources, "s1", edges, "r", "u", now())[2]
    assert sorted(map(tuple, report.collect())) == [("invalidated", "A"), ("under_review", "E"), ("under_review", "F")]


def test_the_loser_may_be_under_review_and_is_the_last_one_made(spark, facts):
    late = ("z@2", "z", "e1", "p", "y", "s2", "EXTRACTED", "under_review", dt.datetime(2025, 1, 1), None)
    rows = facts.union(spark.createDataFrame([late], FACT))
    queue = spark.createDataFrame([(1, "e1", "p", "x", "y", "s1", "s2", "pending", None, None), (2, "e1", "p", "x", "y", "s1", "s2", "pending", None, None)], QUEUE)
    say = spark.createDataFrame([(1, "a", "u1"), (2, "a", "u1"), (2, "b", "u2")], "id int, choice string, user_id string")
    after, queue2, audit, refused = review.approved(rows, queue, say, now())
    assert {r.logical_id: r.status for r in after.where("entity_id = 'e1'").collect()} == {"a": "valid", "b": "valid", "c": "valid", "z": "obsolete"}
    assert [tuple(r) for r in refused.collect()] == [(2, "DECIDED_TWICE")]
    assert audit.count() == 1 and {r.id: r.status for r in queue2.collect()} == {1: "approved", 2: "pending"}


def test_invalidation_needs_a_reason_and_a_source(spark, facts):
    sources, edges = spark.createDataFrame([("s1", "u")], "id string, uri string"), spark.createDataFrame([], "child string, parent string")
    with pytest.raises(ValueError):
        review.invalidated(facts, sources, "s1", edges, " ", "u", now())
    with pytest.raises(LookupError):
        review.invalidated(facts, sources, "s9", edges, "r", "u", now())
    assert [r.logical_id for r in review.logical_id(facts, "a@1").collect()] == ["a"] == [r.logical_id for r in review.logical_id(facts, "a").collect()]


def test_precision_recall_and_gates(spark):
    schema = "doc int, nth int, item string, resolved boolean"
    draft = spark.createDataFrame([(1, 0, "RICE", True), (1, 1, "salt", True), (2, 0, "x", False)], schema)
    golden = spark.createDataFrame([(1, 0, "rice", True), (1, 1, "pepper", True), (2, 0, "x", True)], schema)
    assert tuple(evaluation.normalization(draft, golden).first()) == (0.5, 0.3333, 1, 2, 3)
    none = spark.createDataFrame([], schema)
    assert tuple(evaluation.normalization(none, none).first())[:2] == (1.0, 1.0)
    m = spark.createDataFrame([(1.0, 0.89)], "roundtrip double, relative_coverage double")
    assert {r.metric: r.passed for r in evaluation.gates(m).collect()} == {"roundtrip": True, "relative_coverage": False, "recall_at_5": False}


def test_modules_of_a_code_graph(spark):
    nodes = [("m", "mod", "module", "a.py", None), ("n", "other", "module", "b.py", None), ("f", "run()", "function", "a.py", "L30"), ("g", "go()", "function", "a.py", "L4"), ("c", "Thing", "class", "a.py", None), ("x", "lost()", "function", "z.py", "L1")]
    edges = [("m", "n", "imports_from"), ("m", "n", "re_exports"), ("n", "m", "calls"), ("f", "c", "calls"), ("f", "c", "calls"), ("f", "x", "calls")]
    n = spark.createDataFrame(nodes, "id string, label string, kind string, source_file string, source_location string")
    e = spark.createDataFrame(edges, "source string, target string, relation string")
    found = code.symbols(n, e)
    md = {r.document_id: r.md for r in code.documents(n, found).collect()}
    assert md["id_code_a_py"].endswith("---\n## Functions\n- go()\n- run()\n## Classes\n- Thing\n## Dependencies\n- other\n")
    assert md["id_code_b_py"].endswith("## Functions\n## Classes\n## Dependencies\n")
    assert [tuple(r) for r in code.relations(e, code.entity_rows(found)).collect()] == [("id_code_a_py:fn:1", "id_code_a_py:cls:0", "calls")]


def test_jobs_move_between_their_states(spark):
    shape = "id int, source_uri string, type string, status string, progress int, error string, started_at timestamp_ntz, finished_at timestamp_ntz"
    table = jobs.created(spark.createDataFrame([], shape), spark.createDataFrame([(1, "u", "code"), (2, "v", "image")], "id int, source_uri string, type string"))
    with pytest.raises(ValueError):
        jobs.created(table, spark.createDataFrame([(3, "u", "film")], "id int, source_uri string, type string"))
    event = lambda *rows: spark.createDataFrame(list(rows), "id int, status string, error string")
    table, refused = jobs.moved(table, event((1, "running", None), (9, "running", None), (2, "lost", None)), now())
    assert sorted(r.id for r in refused.collect()) == [2, 9]
    table = jobs.progressed(table, spark.createDataFrame([(1, 1, 3)], "id int, n_done int, n_files int"))
    table, _ = jobs.moved(table, event((1, "failed", "disk")), now())
    assert [(r.id, r.status, r.progress, r.error, r.started_at, r.finished_at) for r in table.orderBy("id").collect()] == [(1, "failed", 33, "disk", T, T), (2, "pending", 0, None, None, None)]
    table, _ = jobs.moved(table, event((1, "running", None)), now())
    table, _ = jobs.moved(table, event((1, "completed", None)), now())
    r = table.where("id = 1").first()
    assert (r.status, r.progress, r.error) == ("completed", 100, None)


def test_small_functions(spark, tmp_path):
    df = spark.createDataFrame([("2.5", "1"), ("3.5", "1"), ("0.125", "10")], "q string, f string")
    assert [r.x for r in df.select(numbers.convert_float(F.col("q"), F.col("f"), 0).alias("x")).collect()] == [2.0, 4.0, 1.0]
    doc = normalize.parse(F.lit("---\ntitle: Riso\nid: d\n---\n## Ingredienti\n- 2 dl acqua\n## Procedimento\n1. Bolli.\n"), ("dl",))
    assert spark.range(1).select(normalize.translation_input(doc).alias("x")).first().x == "Riso\n\n## Ingredienti\n- 2 dl acqua\n\n## Procedimento\n1. Bolli."
    assert [r.q for r in entities.sample(df, "q", 2).collect()] == ["0.125", "2.5"]
    for _ in range(2):
        artifacts.append(df, f"file://{tmp_path}/log")
        artifacts.append_json(df, f"file://{tmp_path}/json")
    assert artifacts.read(spark, f"file://{tmp_path}/log").count() == 6 == spark.read.json(f"file://{tmp_path}/json").count()
    artifacts.reports(spark.createDataFrame([("a", "# A\n\nx"), ("b", "# B")], "name string, md string"), f"file://{tmp_path}/md", "name", "md")
    (one,) = (tmp_path / "md/name=a").glob("*.txt")
    assert one.read_text() == "# A\n\nx\n"
