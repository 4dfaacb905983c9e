"""Steps whose memory, time or shuffle must not outgrow the input."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotloom.operators import fusion, intervals, ranking


def test_boundaries_of_a_grid_meet_cuts_before_they_are_dealt_out(spark):
    rng = random.Random(4)
    videos = spark.createDataFrame([(i, rng.choice([3.0, 7.0, 20.5, 349.9, 350.0, 4000.0])) for i in range(60)] + [(99, None), (98, 0.0)], "video_id long, duration double").repartition(3)
    cuts = spark.createDataFrame([(rng.randrange(70), rng.choice([rng.uniform(0, 400), rng.randrange(60) * 7.0 + rng.choice([-2.0, 0.0, 2.0, 2.5]), 7.0 * rng.randrange(9)])) for _ in range(900)] + [(1, None)], "video_id long, cut double")
    points = intervals.fixed_grid(videos).where("t_start > 0").select("video_id", F.col("t_start").alias("t"))
    key = lambda df: sorted((r.video_id, r.t, r.snapped) for r in df.collect())
    got = intervals.nearest_in_grid(videos, cuts, 2.0)
    assert key(got) == key(intervals.nearest_within(points, cuts, 2.0)) and any(a != b for _, a, b in key(got))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("sequence(1") < plan.index("Join")  # boundaries are made above all joins


def test_questions_of_one_weight_are_ranked_once(spark):
    rng = random.Random(5)
    signals = spark.createDataFrame([(v, c, float(rng.randrange(5)), rng.choice([None, 0.0, 1.5, 3.0])) for v in range(6) for c in range(30)], "video_id long, clip_idx long, seen double, heard double")
    gates = spark.createDataFrame([(q, q % 7, rng.choice([None, 0.0, 0.4, 0.4, 1.0, 3.0])) for q in range(200)], "q_id long, video_id long, gate double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("fused", 9).desc(), "clip_idx"))
    key = lambda df: sorted(((r.q_id, r["rank"], r.clip_idx, r.fused, r.weight) for r in df.collect()), key=repr)
    for alpha in (1.0, 0.5):
        want = key(fusion.gated_fusion(signals, gates, alpha).withColumn("rank", rank).where("rank <= 4"))
        assert key(fusion.gated_best(signals, gates, 4, alpha)) == want and len(want) > 600


def test_one_large_file_is_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DEALT", 10, raising=False)
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 5 + 1)]) for i in range(200)], "doc_id long, tokens array<string>").coalesce(1)
    items = spark.createDataFrame([(0, ["w0", "w3"]), (1, ["w1", "x"])], "item_id long, tokens array<string>")
    shared = ranking.shared_tokens(docs, items)
    assert "RepartitionByExpression [doc_id" in (plan := shared._jdf.queryExecution().analyzed().toString()) and ", 20" in plan
    assert sorted(map(tuple, ranking.top_overlap(docs, items, 2).select("item_id", "doc_id", "shared", "rank").collect())) == [(0, 3, 2, 1), (0, 4, 2, 2), (1, 1, 1, 1), (1, 2, 1, 2)]
