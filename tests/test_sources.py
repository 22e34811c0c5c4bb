from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import queues
from kgspark.sources import files


def test_files_by_job_type(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", "sub/c.py", ".git/d.md", "node_modules/x/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = files.scan_files(spark, f"file://{tmp_path}", "document")
    assert sorted(r.path.rpartition("/")[2] for r in found.collect()) == ["a.md", "b.txt"]
    assert files.digests(found).count() == 2
    assert files.stale(found, F.current_timestamp(), 30).count() == 0


def test_node_link_graph(spark, tmp_path):
    graph = {
        "nodes": [{"id": "a", "label": "A", "source_file": "x.py"}, {"id": "b"}, {"label": "lost"}],
        "links": [{"source": "a", "target": "b", "source_file": "y.py"}, {"source": "a", "target": "gone"}, {"source": "a"}, {"source": "a", "target": "a"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(graph))
    nodes, edges, violations = files.node_link(spark, f"file://{tmp_path}/g.json")
    assert {(r.id, r.label, r.file_type) for r in nodes.collect()} == {("a", "A", None), ("b", "b", None)}
    assert sorted((r.source, r.target, r.relation, r.confidence) for r in edges.collect()) == [("a", "a", "RELATES_TO", "EXTRACTED"), ("a", "b", "RELATES_TO", "EXTRACTED")]
    assert sorted(r.code for r in violations.collect()) == ["EDGE_WITHOUT_END", "NODE_WITHOUT_ID"]
    assert sorted(r.uri for r in files.registered(nodes, edges).collect()) == ["x.py", "y.py"]


def test_code_module_sections(spark):
    md = "---\nid: m\n---\n## Functions\n- f()\n- g()\n## Classes\n## Dependencies\n- os\n"
    r = spark.createDataFrame([(md,)], "md string").select(files.code_module(F.col("md")).alias("x")).first().x
    assert (r.functions, r.classes, r.dependencies) == (["f()", "g()"], [], ["os"])


def test_front_matter_fields_are_set_or_added(spark):
    df = spark.createDataFrame([("---\nid: m\nlevel: L1\n---\nbody\n",)], "md string")
    assert df.select(files.with_front_matter(F.col("md"), "level", F.lit("L3")).alias("x")).first().x == "---\nid: m\nlevel: L3\n---\nbody\n"
    assert df.select(files.with_front_matter(F.col("md"), "version", F.lit("2")).alias("x")).first().x == "---\nid: m\nlevel: L1\nversion: 2\n---\nbody\n"


def test_decisions_count_once_and_are_audited(spark):
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "id long, term string, status string, resolved_by string, resolved_at timestamp_ntz, created_at timestamp_ntz")
    queue = queues.created(empty, spark.createDataFrame([(1, "x"), (2, "y")], "id long, term string"), now)
    queue = queues.created(queue, spark.createDataFrame([(2, "again"), (3, "z")], "id long, term string"), now)
    assert [(r.id, r.term) for r in queues.listed(queue, "pending").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    say = spark.createDataFrame([(1, "approved", "u"), (2, "maybe", "u"), (9, "rejected", "u")], "id long, status string, resolved_by string")
    after, audit, refused = queues.decided(queue, say, now)
    assert {r.id: r.status for r in after.collect()} == {1: "approved", 2: "pending", 3: "pending"}
    assert [(r.entity_id, r.new_value) for r in audit.collect()] == [("1", '{"status":"approved"}')]
    assert sorted(r.id for r in refused.collect()) == [2, 9]
    assert sorted(r.id for r in queues.decided(after, say, now)[2].collect()) == [1, 2, 9]
    with pytest.raises(ValueError):
        queues.listed(queue, "lost")


def test_links_by_other_names_empty_values_and_self_relations(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"nodes": [{"id": "a", "label": "", "type": "code", "source_file": "x.py", "confidence": "INFERRED"}, {"id": "", "label": "lost"}, {"id": "b", "file_type": ""}],'
        ' "links": [{"_src": "a", "_tgt": "b", "relation": ""}, {"source": "a", "target": "a", "relation": "imports"}, {"source": "a", "target": "a", "relation": "calls"}, {"source_file": "y.py"}]}'
    )
    nodes, edges, violations = files.node_link(spark, f"file://{tmp_path}/g.json")
    assert sorted((r.id, r.label, r.file_type, r.confidence) for r in nodes.collect()) == [("a", "a", "code", "INFERRED"), ("b", "b", None, "EXTRACTED")]
    assert sorted((r.source, r.target, r.relation) for r in edges.collect()) == [("a", "a", "calls"), ("a", "b", "RELATES_TO")]
    assert sorted(map(tuple, violations.collect())) == [("EDGE_WITHOUT_END", "? -> ? y.py"), ("NODE_WITHOUT_ID", "lost")]
    (r,) = files.registered(nodes, edges).collect()
    assert (r.id, r.type, r.hash) == (f"src_{r.hash}", "file", __import__("hashlib").sha256(b"x.py").hexdigest())
    assert sorted((f.logical_id, f.value, f.source_id) for f in files.label_facts(nodes).collect()) == [("a__label", "a", r.id), ("b__label", "b", None)]


def test_module_ids(spark):
    from kgspark.operators import code

    df = spark.createDataFrame([("src/a__b.py",), ("src/a_b.py",), ("/_x_.py/",), ("--",)], "f string")
    assert [r.x for r in df.select(code.document_id(F.col("f")).alias("x")).collect()] == ["id_code_src_a__b_py", "id_code_src_a_b_py", "id_code_x__py", "id_code_module"]


def test_small_factors_are_exact(spark):
    from kgspark.functions import numbers

    df = spark.createDataFrame([("100000", "0.00003527")], "q string, f string")
    assert df.select(numbers.quantity_text(numbers.convert(F.col("q"), F.col("f"), None)).alias("x")).first().x == "3.527"
