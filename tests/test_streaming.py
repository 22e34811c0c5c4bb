from __future__ import annotations

import datetime as dt

from kgspark.streaming import ingest


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    data, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "logical_id string, value string, ts timestamp_ntz, seq long"
    write(spark, data, [("a", "1", t(0), 0), ("a", "2", t(5), 1), ("b", "1", t(1), 2)], schema)
    first = ingest.drained(ingest.versions(ingest.read_stream(spark, data)), where=out)
    assert [tuple(r) for r in first.collect()] == [("a", "1", t(0), t(5))]
    write(spark, data, [("b", "2", t(7), 3), ("a", "3", t(9), 4)], schema)
    second = ingest.drained(ingest.versions(ingest.read_stream(spark, data)), where=out)
    assert sorted(tuple(r) for r in second.collect()) == [("a", "1", t(0), t(5)), ("a", "2", t(5), t(9)), ("b", "1", t(1), t(7))]


def test_unchanged_content_is_dropped_across_batches(spark, tmp_path):
    data, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for rows in ([("f", "x"), ("f", "x")], [("f", "x"), ("f", "y"), ("g", "x")]):
        write(spark, data, rows, "key string, digest string")
        got = ingest.drained(ingest.changed(ingest.read_stream(spark, data), "key", "digest"), where=out)
    assert sorted(tuple(r) for r in got.collect()) == [("f", "x"), ("f", "y"), ("g", "x")]


def test_one_key_with_all_rows_waits_in_slices(spark, tmp_path):
    """More rows than are held at a time, out of order, and some of them in a later file."""
    data, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 7919 % 25_000) for i in range(25_000)]
    rows = [("k", str(i), t, i) for i, t in enumerate(at)]
    write(spark, data, rows, "logical_id string, value string, ts timestamp_ntz, seq long")
    got = [tuple(r) for r in ingest.drained(ingest.versions(ingest.read_stream(spark, data)), where=out).collect()]
    rows.sort(key=lambda r: r[2])
    assert sorted(got, key=lambda r: r[2]) == [("k", v, t, u) for (_, v, t, _), (_, _, u, _) in zip(rows, rows[1:], strict=False)]


FACT = "id string, logical_id string, entity_id string, property string, value string, source_id string, confidence string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"
SIDES = ["entity_id", "property", "value_a", "value_b", "source_id_a", "source_id_b", "suggestion"]


def test_conflicts_found_in_a_stream_equal_those_of_the_batch(spark, tmp_path):
    from kgspark.operators import conflicts
    from kgspark.streaming import hooks

    data, where = f"file://{tmp_path}/in", f"file://{tmp_path}/hook"
    sources = spark.createDataFrame([("s1", dt.datetime(2024, 1, 1)), ("s2", dt.datetime(2024, 1, 2))], "id string, ingested_at timestamp_ntz")
    fact = lambda n, e, v, s: (f"{n}@1", n, e, "p", v, s, "EXTRACTED", "valid", dt.datetime(2024, 1, 1), None)
    batches = [
        [fact("a", "e1", "x", "s1"), fact("b", "e2", "y", "s1"), fact("c", "e1", "z", "s2")],
        [fact("d", "e2", "w", "s2"), fact("e", "e3", "v", "s1")],
        [fact("f", "e1", "q", "s3"), fact("g", "e3", "v", "s2"), fact("h", "e1", "x", "s2")],
    ]
    for rows in batches:
        write(spark, data, rows, FACT)
        hook = hooks.detect(ingest.read_stream(spark, data), sources, where)
    all_ = spark.createDataFrame(sum(batches, []), FACT)
    want = sorted(map(repr, conflicts.pairs(conflicts.candidates(all_, sources)).select(SIDES).collect()))
    got = lambda: sorted(map(repr, hook.conflicts(spark).select(SIDES).collect()))
    assert got() == want and len(want) >= 4
    hook(spark.createDataFrame(batches[2], FACT), 2)  # a replay of a batch that is done
    assert got() == want
    # A replay of one that was written but is not in the ledger.
    left = spark.read.parquet(f"{where}/ledger").where("batch < 2").collect()
    spark.createDataFrame(left, "batch long, facts long, conflicts long").coalesce(1).write.mode("overwrite").parquet(f"{where}/ledger")
    assert got() != want
    hook(spark.createDataFrame(batches[2], FACT), 2)
    assert got() == want


def test_token_bucket_equals_a_loop(spark, tmp_path):
    data = f"file://{tmp_path}/in"
    times = [0, 0, 0, 0, 0.4, 1.2, 1.3, 1.4, 5, 5, 5]
    rows = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i) for i, s in enumerate(times)]
    write(spark, data, rows, "key string, ts timestamp_ntz, seq long")
    got = {r.seq: r.allowed for r in ingest.drained(ingest.token_bucket(ingest.read_stream(spark, data), 1.0)).collect()}
    tokens, last, want = 2.0, None, {}
    for i, s in enumerate(times):
        tokens = min(2.0, tokens + (0 if last is None else s - last))
        last = s
        want[i] = tokens >= 1
        tokens -= want[i]
    assert got == want


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    data, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for rows in ([("x", t(0, 5)), ("x", t(0, 50))], [("x", t(3))], [("x", t(0, 7)), ("x", t(9))], [("x", t(12))]):
        write(spark, data, rows, "event_type string, ts timestamp")
        got = ingest.drained(ingest.window_counts(ingest.read_stream(spark, data)), where=out)
    n = {r.start.hour: r.n for r in got.collect()}
    assert n[0] == 2 and n[3] == 1


def test_token_bucket_adds_up_exactly_and_keeps_the_order_of_one_time(spark, tmp_path):
    """Ten tenths of a second fill one token, which doubles miss; rows of one microsecond go by nth before seq."""
    data = str(tmp_path / "exact")
    rows = [(1, 0, 0, 0)] + [(1, 100_000 * i, 0, i) for i in range(1, 31)] + [(2, 5, 2, 100), (2, 5, 1, 101)]
    spark.createDataFrame(rows, "key long, us long, nth long, seq long").selectExpr("key", "timestamp_micros(us + 1700000000000000) AS ts", "nth", "seq").write.parquet(data)
    got = {r.seq: r.allowed for r in ingest.drained(ingest.token_bucket(ingest.read_stream(spark, data), 1.0, 1.0)).collect()}
    assert [s for s, allowed in sorted(got.items()) if allowed] == [0, 10, 20, 30, 101]


def test_versions_wait_in_an_aggregation_and_rows_without_a_time_are_left_out(spark, tmp_path):
    """No Python for each row or key; rows that are equal stay two."""
    data = f"file://{tmp_path}/in"
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("a", "1", t(0), 0), ("a", "lost", None, 1), ("a", "2", t(5), 2), ("a", "2", t(5), 2), ("a", None, t(6), 3), ("a", "3", t(7), 4), ("b", "1", t(1), 5)]
    write(spark, data, rows, "logical_id string, value string, ts timestamp_ntz, seq long")
    found = ingest.versions(ingest.read_stream(spark, data))
    plan = found.stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
    got = [tuple(r) for r in ingest.drained(found).collect()]
    assert sorted(got, key=lambda r: r[2:]) == [("a", "1", t(0), t(5)), ("a", "2", t(5), t(5)), ("a", "2", t(5), t(6)), ("a", None, t(6), t(7))]


def test_a_batch_that_comes_again_writes_the_same(spark, tmp_path):
    write(spark, f"file://{tmp_path}/in", [("a", "1", dt.datetime(2024, 1, 1), 0)], "logical_id string, value string, ts timestamp_ntz, seq long")
    each = ingest.versions(ingest.read_stream(spark, f"file://{tmp_path}/in")).writer(f"file://{tmp_path}/out")
    batches = [[("a", 1, 0, "x"), ("b", 2, 1, "y")], [("a", 5, 2, "z")], [], [("b", 9, 3, "w"), ("a", 7, 4, "v")]]
    for n, rows in enumerate(batches):
        for _ in range(2):
            each(spark.createDataFrame(rows, "logical_id string, us long, seq long, value string"), n)
    got = spark.read.parquet(f"file://{tmp_path}/out/rows").selectExpr("batch", "logical_id", "value", "unix_micros(valid_from::timestamp)", "unix_micros(valid_to::timestamp)")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "x", 1, 5), (3, "a", "z", 5, 7), (3, "b", "y", 2, 9)]


def test_buckets_go_on_in_later_batches_until_they_are_full(spark, tmp_path):
    write(spark, f"file://{tmp_path}/in", [("k", dt.datetime(2024, 1, 1), 0)], "key string, ts timestamp_ntz, seq long")
    each = ingest.token_bucket(ingest.read_stream(spark, f"file://{tmp_path}/in"), 1.0, 2.0).writer(f"file://{tmp_path}/out")
    s = 1_000_000
    batches = [[("k", 0, 0, None), ("k", 0, 1, None), ("m", 0, 2, None)], [("k", s // 2, 3, None)], [], [("k", s, 4, None), ("m", s, 5, None), ("m", s, 6, None), ("m", s, 7, None)], [("n", 9 * s, 8, None)]]
    left = []
    for n, rows in enumerate(batches):
        for _ in range(2):
            each(spark.createDataFrame(rows, "key string, us long, seq long, value long"), n)
        left.append(sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/left/{n % 2}").select("key", "us", "tokens").collect()))
    got = {r.seq: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out/rows").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True}
    assert left[1] == left[2] == [("k", s // 2, s // 2), ("m", 0, s)]
    assert left[4] == [("n", 9 * s, s)]
