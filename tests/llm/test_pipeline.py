from __future__ import annotations

import corpus_pipeline as p
from kgspark.llm.common import stored
from kgspark.llm.jaccard_join import jaccard_components


def test_stages(spark, docs, sf):
    tables = [docs]
    for name, stage in p.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf), name))
    assert all(t.columns == p.COLUMNS for t in tables[1:-1])
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    parts = jaccard_components(tables[2]).collect()
    assert ids[3] == {r.component_id for r in parts}
    assert tables[4].where("text LIKE '%[REDACTED]%'").count() > 0 or tables[3].where("text LIKE '%token = \"%'").count() == 0
    assert p.run(spark, sf).count() == tables[-1].count()


def test_odd_rows(spark, odd, nothing):
    for df in (odd, nothing):
        t = df
        for name, stage in p.STAGES:
            t = stored(stage(spark, t, ""), name)
        assert t.count() >= (df is odd)
    once = p.near_duplicates(spark, odd, "").collect()
    assert [r.doc_id for r in once].count(8) == 1 and [r.doc_id for r in once].count(2) == 0
    assert [r.doc_id for r in once].count(None) == 1
