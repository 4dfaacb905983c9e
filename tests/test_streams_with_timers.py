"""Streams with timers: islands against the batch operator, jobs with repeated, late and missing events."""

import datetime as dt
import random

import pytest

from shotloom.operators import intervals
from shotloom.sources import snapshots
from shotloom.streaming import islands, jobs

SHOTS = "video_id long, shot_idx long, t_start double, t_end double, score double, asr_text string"
EVENTS = "job_id string, video_id long, status string, at timestamp, error string"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def feed(spark, tmp_path, batches, schema, shape, name):
    source, n = str(tmp_path / "in"), [0]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        n[0] += 1
        stream = shape(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    return spark.read.parquet(str(tmp_path / name))


def test_islands_are_those_of_the_batch_operator(spark, tmp_path, store):
    rng = random.Random(6)
    rows = []
    for video in (1, 2):
        t = 1000.0
        for i in range(60):
            t += rng.choice([0.0, 2.0, 2.5, 9.0])
            rows.append((video, i, t, t + rng.choice([1.0, 2.0, 3.0]), rng.choice([0.1, 0.5, 0.9]), rng.choice(["", " ", None, f"s{i}"])))
    end = (3, 0, 1e6, 1e6 + 1, 0.0, "")  # moves the watermark on
    rows.sort(key=lambda r: r[2] + rng.uniform(-20, 20))  # out of order, by less than the bound
    size = len(rows) // 3
    late = (1, 900, 1000.5, 1001.0, 9.0, "late")
    batches = [rows[:size], rows[size : 2 * size], rows[2 * size :], [end], [late, (None, 1, 1.0, 2.0, 0.0, "x"), (1, 1, None, 2.0, 0.0, "x")]]
    got = feed(spark, tmp_path, batches, SHOTS, lambda s: islands.merged_stream(s), "out")
    key = lambda r: (r.video_id, r.t_start)
    want = intervals.merge_contiguous(spark.createDataFrame(rows, SHOTS)).collect()
    same = lambda rs: [(r.video_id, r.t_start, r.t_end, r.score, r.shot_idx, r.asr_text, r.n_shots) for r in sorted(rs, key=key)]
    assert same(got.collect()) == same(want) and len(want) > 10


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_jobs_go_forward_and_stuck_ones_end(spark, tmp_path, store):
    first = [
        ("a", 1, "queued", at(0), None), ("a", 1, "processing", at(1), None), ("b", 2, "queued", at(0), None), ("b", 2, "processing", at(2), None),
        ("c", 3, "ready", at(3), None), ("d", 4, "queued", at(3), None), ("x", 9, "dancing", at(3), None), (None, 9, "ready", at(3), None), ("y", None, "ready", at(3), None),
    ]
    second = [("a", 1, "ready", at(20), None), ("a", 1, "processing", at(1), None), ("c", 3, "processing", at(2), None), ("c", 3, "error", at(21), "no"), ("d", 4, "error", at(21), "e" * 5000), ("e", 5, "queued", at(22), None)]
    third = [("z", 8, "queued", at(100), None)]  # an hour on: b and then e have had no news
    fourth = [("b", 2, "ready", at(95), None), ("z", 8, "flagged", at(101), None)]
    fifth = [("z2", 8, "queued", at(130), None)]
    got = feed(spark, tmp_path, [first, second, second[:3], third, fourth, fifth], EVENTS, lambda s: jobs.job_changes(s, 3600, 86400, "10 minutes"), "out").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.job_id, r.ord)):
        seen.setdefault(r.job_id, []).append(r.status)
    assert seen == {"a": ["queued", "processing", "ready"], "b": ["queued", "processing", "error"], "c": ["ready"], "d": ["queued", "error"], "e": ["queued", "error"], "z": ["queued", "flagged"], "z2": ["queued"]}
    errors = {r.job_id: r.error for r in got if r.status == "error"}
    assert errors == {"b": jobs.STUCK, "d": "e" * 1000, "e": jobs.STUCK} and {r.at for r in got if r.job_id == "b" and r.status == "error"} == {at(62)}


def test_the_table_of_jobs_counts_a_repeated_batch_once(spark, tmp_path, store):
    source, path, ready = str(tmp_path / "in"), f"file://{tmp_path}/jobs", []
    spark.createDataFrame([("a", 1, "queued", at(0), None), ("a", 1, "ready", at(1), None), ("b", 2, "queued", at(1), None)], EVENTS).write.parquet(source)
    changes = jobs.job_changes(spark.readStream.schema(EVENTS).parquet(source))
    q = jobs.keep_jobs(changes, path, str(tmp_path / "cp"), lambda batch, number: ready.extend(r.video_id for r in batch.collect()))
    assert q.awaitTermination(180)
    assert sorted((r.job_id, r.status) for r in snapshots.read(spark, path).collect()) == [("a", "ready"), ("b", "queued")] and ready == [1]
    version = snapshots.manifest(spark, path)["version"]
    again = spark.createDataFrame([(1, "a", "error", at(9), "x", 7)], "video_id long, job_id string, status string, at timestamp, error string, ord long")
    assert snapshots.upsert(again, path, ["video_id", "job_id"], "ord", token=f"{tmp_path / 'cp'}:0") == version
    assert sorted(r.status for r in snapshots.read(spark, path).collect()) == ["queued", "ready"]


def test_clock_on_the_wall(spark, tmp_path, store):
    import time

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    put(("a", 1, "processing", at(0), None))
    changes = jobs.job_changes(spark.readStream.schema(EVENTS).parquet(source), 1.0, 60, None)
    q = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not any(r.status == "error" for r in (spark.read.schema(jobs.CHANGE).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else [])):
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r.job_id, r.status) for r in spark.read.parquet(out).collect()) == [("a", "error"), ("a", "processing")]
