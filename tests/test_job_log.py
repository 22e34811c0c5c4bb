"""Jobs told from streams that fail, pause and go on, and the fold of their events."""

from __future__ import annotations

import datetime as dt
import time

from kgspark.streaming import ingest, job_log


def files(spark, path, n, first=0):
    for i in range(first, first + n):
        spark.createDataFrame([(i, "x"), (i + 100, "y")], "id long, v string").coalesce(1).write.mode("append").parquet(path)


def sequence(log, job):
    return [(r.event, r.batch, r.rows) for r in log.events().where(f"job = '{job}'").orderBy("seq").collect()]


def test_a_stream_that_fails_and_goes_on_is_one_job(spark, tmp_path):
    data, log = f"file://{tmp_path}/in", job_log.JobLog(spark, f"file://{tmp_path}/log")
    files(spark, data, 3)
    broken = [1]

    def hook(batch, number):
        if number in broken:
            broken.clear()
            raise ValueError("no such disk")
        batch.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={number}")

    with log:
        for _ in range(2):
            run = job_log.tracked(ingest.read_stream(spark, data, 1), log, "load", f"file://{tmp_path}/job", hook)
            try:
                run.awaitTermination()
            except Exception as e:
                assert "no such disk" in str(e)
            assert log.settled(run)
            state = job_log.told(log.events(), spark.createDataFrame([("load", 6)], "id string, n_rows long")).first()
            if run.exception():
                assert (state.status, state.n_batches, state.n_rows, state.progress) == ("failed", 1, 2, 33)
                assert "no such disk" in state.error and state.finished_at is not None
    assert sequence(log, "load") == [("running", None, None), ("progress", 0, 2), ("failed", None, None), ("running", None, None), ("progress", 1, 2), ("progress", 2, 2), ("completed", None, None)]
    assert (state.status, state.n_batches, state.n_rows, state.progress, state.error) == ("completed", 3, 6, 100, None)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6


def test_a_paused_stream_goes_on_where_it_stopped(spark, tmp_path):
    data, log = f"file://{tmp_path}/in", job_log.JobLog(spark, f"file://{tmp_path}/log")
    files(spark, data, 1)
    with log:
        run = job_log.tracked(ingest.read_stream(spark, data, 1), log, "watch", f"file://{tmp_path}/job", trigger={"processingTime": "1 second"})
        run.processAllAvailable()
        log.pause(run)
        assert log.settled(run)
        paused = job_log.told(log.events()).first()
        assert (paused.status, paused.finished_at) == ("paused", None)
        files(spark, data, 2, 1)
        run = job_log.tracked(ingest.read_stream(spark, data, 1), log, "watch", f"file://{tmp_path}/job")
        run.awaitTermination()
        assert log.settled(run)
        other = ingest.drained(ingest.read_stream(spark, data))  # a stream without a name is no job
        assert other.count() == 6
        time.sleep(1)
    assert [e for e, _, _ in sequence(log, "watch")] == ["running", "progress", "paused", "running", "progress", "progress", "completed"]
    assert job_log.told(log.events()).select("id", "status", "n_rows").collect() == [("watch", "completed", 6)]


def test_events_fold_by_their_order(spark):
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    rows = [("a", "r1", 1, "running", None, None, None, t(1)), ("a", "r1", 2, "progress", 0, 5, None, t(2)), ("a", "r1", 3, "failed", None, None, "e", t(3)), ("a", "r2", 4, "running", None, None, None, t(4)), ("a", "r2", 5, "progress", 0, 5, None, t(5))]
    rows += [("b", "r3", 7, "completed", None, None, None, t(7)), ("b", "r3", 7, "running", None, None, None, t(7))]
    got = {r.id: r for r in job_log.told(spark.createDataFrame(rows[::-1], job_log.EVENT), spark.createDataFrame([("a", 20), ("b", 0)], "id string, n_rows long")).collect()}
    assert got["a"].asDict() == {"id": "a", "status": "running", "n_batches": 1, "n_rows": 5, "error": None, "started_at": t(1), "finished_at": None, "progress": 25}
    assert (got["b"].status, got["b"].n_rows, got["b"].progress, got["b"].finished_at) == ("completed", 0, 100, t(7))
    assert job_log.told(spark.createDataFrame([], job_log.EVENT)).collect() == []
