from pyspark.sql import functions as F

from shotloom.sources import sinks
from shotloom.streaming import reindex as streaming

SPANS = "video_id long, ord long, v long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_last_writer_wins(spark):
    old = spark.createDataFrame([(1, 0, 1), (2, 0, 5)], SPANS)
    new = spark.createDataFrame([(1, 0, 1), (2, 0, 4), (3, 0, 1)], SPANS)
    got = sinks.last_writer(old.withColumn("from", F.lit("old")), new.withColumn("from", F.lit("new")), ["video_id", "ord"], "v")
    assert rows(got, "video_id", "from") == [(1, "new"), (2, "old"), (3, "new")]


def test_replace_and_tombstones(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 1)], SPANS), path)
    sinks.replace_partitions(spark.createDataFrame([(1, 7, 2)], SPANS), path)
    stored = spark.read.parquet(path)
    assert rows(stored, "video_id", "ord", "v") == [(1, 7, 2), (2, 0, 1)]
    assert rows(sinks.without(stored, stored.where("video_id = 1")), "video_id") == [(2,)]


def test_upsert_and_purge(spark, tmp_path):
    path = str(tmp_path / "t")
    rows_of = lambda: rows(spark.read.parquet(path), "video_id", "ord", "v")
    sinks.upsert(spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 5)], SPANS), path, ["video_id", "ord"], "v")
    sinks.upsert(spark.createDataFrame([(1, 1, 2), (2, 0, 4), (3, 0, 1)], SPANS), path, ["video_id", "ord"], "v")
    assert rows_of() == [(1, 0, 1), (1, 1, 2), (2, 0, 5), (3, 0, 1)]
    for _ in range(2):
        sinks.purge_and_insert(spark.createDataFrame([(1, 9, 9)], SPANS), path)
        assert rows_of() == [(1, 9, 9), (2, 0, 5), (3, 0, 1)]
    assert sinks.ensure(spark, str(tmp_path / "new"), SPANS) and not sinks.ensure(spark, str(tmp_path / "new"), SPANS)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 0


def test_stream_keeps_what_came_before(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for v in (1, 2, 3):
        spark.createDataFrame([(1, v % 3, v), (v, 7, v)], SPANS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SPANS).parquet(source)
        streaming.reindex(stream, out, str(tmp_path / "cp"), lambda df: df.withColumn("v", F.col("v") * 10)).awaitTermination(60)
    assert rows(spark.read.parquet(out), "video_id", "ord", "v") == [(1, 0, 30), (1, 1, 10), (1, 2, 20), (1, 7, 10), (2, 7, 20), (3, 7, 30)]


def test_events_count_once(spark, tmp_path):
    source = str(tmp_path / "in")
    e = spark.createDataFrame([("a", "2024-01-01 01:00:00", 1), ("b", "2024-01-01 02:00:00", 2), ("a", "2024-01-01 03:00:00", 3)], "event_id string, t string, v int").select("event_id", F.col("t").cast("timestamp").alias("received_at"), "v")
    e.write.parquet(source)
    assert rows(streaming.once_per_event(e), "event_id", "v") == [("a", 1), ("b", 2)]
    q = streaming.once_per_event(spark.readStream.schema(e.schema).parquet(source)).writeStream.format("memory").queryName("ledger").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r[0] for r in rows(spark.table("ledger"), "event_id")] == ["a", "b"]


def test_subscriptions_fold_alike_in_batch_and_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    made = [
        (1, "2024-01-01 01:00:00", 0, "checkout.session.completed", None, "c1", None),
        (1, "2024-01-03 01:00:00", 2, "customer.subscription.updated", "past_due", None, 99),
        (1, "2024-01-02 01:00:00", 1, "customer.subscription.updated", "active", None, 50),
        (2, "2024-01-01 01:00:00", 3, "customer.subscription.deleted", None, None, None),
        (3, "2024-01-01 01:00:00", 4, "other", None, None, None),
    ]
    e = spark.createDataFrame(made, "user_id long, t string, ord long, type string, status string, customer string, period_end long").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    cols = ("user_id", "plan_id", "status", "customer", "period_end")
    want = [(1, "developer", "past_due", "c1", 99), (2, "free", "canceled", None, None), (3, "free", "active", None, None)]
    from shotloom.operators import accounts

    assert rows(accounts.latest_subscription(e), *cols) == want
    for part in (e.where("ord in (0, 2, 3)"), e.where("ord in (1, 4)")):  # an event comes late
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {}
    q = streaming.subscriptions(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r["user_id"]: tuple(r[c] for c in cols) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(got.values()) == want


def test_job_states(spark):
    e = spark.createDataFrame([(1, 5, "queued", 1), (1, 5, "processing", 2), (1, 5, "ready", 2), (2, 5, "queued", 9)], "job_id long, video_id long, status string, at long")
    assert rows(streaming.job_states(e), "job_id", "status", "at") == [(1, "ready", 2), (2, "queued", 9)]


def test_files_dumps_and_reports(spark, tmp_path):
    import json

    import numpy as np

    from shotloom.sources import files

    np.save(tmp_path / "v1.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    np.save(tmp_path / "v2.npy", np.zeros((0, 0)))
    assert rows(files.feature_rows(spark, str(tmp_path)), "video_id", "clip_idx", "vector") == [("v1", 0, [0.0, 1.0]), ("v1", 1, [2.0, 3.0]), ("v1", 2, [4.0, 5.0])]
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "a.yaml").write_text(json.dumps([{"id": "x", "question": "q?", "expected_tool": "t", "expected_args": {"b": 1}}, {"id": "y", "expected_tool": "u"}]))
    assert rows(files.golden_cases(spark, str(tmp_path / "cases")), "file", "id", "expected_tool", "expected_args") == [("a.yaml", "x", "t", '{"b": 1}'), ("a.yaml", "y", "u", "{}")]
    assert files.golden_cases(spark, str(tmp_path / "cases"), "t").count() == 1
    videos = spark.createDataFrame([(1, "ready"), (2, "queued")], "video_id long, status string")
    shots = spark.createDataFrame([(1, 1, 2.0, 4.5), (1, 0, 0.0, 2.0), (2, 0, 0.0, 1.0)], "video_id long, shot_idx long, t_start double, t_end double")
    dump = {r.video_id: (r.n_shots, [s.duration for s in r.shots or []]) for r in sinks.index_dump(videos, shots).collect()}
    assert dump == {1: (2, [2.0, 2.5]), 2: (0, [])}
    scores = spark.createDataFrame([("g", True, None, 0.5)], "id string, ok boolean, arg boolean, score double")
    assert [r.value for r in sinks.report_lines(scores).collect()] == ["g,True,None,0.5"]


def test_daily_usage_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    usage = "user_id long, created_at timestamp, prompt long, completion long, cost_usd double"
    spark.createDataFrame([(1, "2024-01-01 01:00:00", 1, 2, 0.5), (1, "2024-01-01 05:00:00", 3, 4, 0.5), (2, "2024-01-02 05:00:00", 1, 1, 1.0)], "user_id long, t string, prompt long, completion long, cost_usd double").select("user_id", F.col("t").cast("timestamp").alias("created_at"), "prompt", "completion", "cost_usd").write.parquet(source)
    q = streaming.usage_by_day(spark.readStream.schema(usage).parquet(source)).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("daily"), "user_id", "prompt", "cost_usd") == [(1, 4, 1.0), (2, 1, 1.0)]
