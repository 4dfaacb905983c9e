"""Worked edge cases of the interval, fusion, text and roll-up operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators import fusion, intervals, rollups, timeline, vectors
from shotloom.plans import catalogue


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_contiguous_shots_and_nested_span(spark):
    shots = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.2, "a"), (1, 1, 1.0, 3.0, 0.9, " "), (1, 2, 10.5, 12.0, 0.1, "b"), (2, 3, 0.0, 5.0, 0.5, None), (2, 4, 6.0, 7.0, 0.5, None), (2, 5, 8.1, 9.0, 0.5, None)], "video_id long, shot_idx long, t_start double, t_end double, score double, asr_text string")
    got = rows(intervals.merge_contiguous(shots), "video_id", "t_start", "t_end", "score", "shot_idx", "asr_text")
    assert got == [(1, 0.0, 12.0, 0.9, 1, "a b"), (2, 0.0, 7.0, 0.5, 3, ""), (2, 8.1, 9.0, 0.5, 5, "")]


def test_label_runs_end_at_another_label(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 10.0, "A", 1.0), (1, 1, 2.0, 3.0, "B", 1.0), (1, 2, 11.0, 12.0, "A", 1.0)], "video_id long, ord long, t_start double, t_end double, label string, score double")
    assert intervals.merge_labels(spans).count() == 3


def test_short_turns_go(spark):
    turns = spark.createDataFrame([(1, 0, 0.0, 0.3, "X", 1.0)], "video_id long, ord long, t_start double, t_end double, speaker string, score double")
    assert intervals.normalize_turns(turns).count() == 0


def test_windows_are_split(spark):
    spans = spark.createDataFrame([(1, 0, 0.0, 400.0)], "video_id long, ord long, t_start double, t_end double")
    assert rows(intervals.candidate_windows(spans), "t_start", "t_end") == [(0.0, 150.0), (150.0, 300.0), (300.0, 415.0)]


def test_saliency_edges(spark):
    clips = spark.createDataFrame([(1, 0, 3.0), (1, 1, 0.0), (1, 2, 0.0)], "video_id long, clip_idx long, score double")
    assert rows(intervals.saliency_moments(clips), "t_start", "t_end", "score") == [(0.0, 4.0, 1.0)]


def test_nms_keeps_disjoint_and_notes_families(spark):
    c = spark.createDataFrame([("g", 0, 0.0, 30.0, 1.0, "a"), ("g", 1, 10.0, 14.0, 1.0, "b"), ("h", 2, 0.0, 10.0, 1.0, "visual"), ("h", 3, 0.0, 9.0, 0.8, "event:x"), ("h", 4, 0.0, 8.0, 0.5, "visual")], "group string, ord long, t_start double, t_end double, score double, family string")
    got = rows(intervals.temporal_nms(c).withColumn("also", F.array_join("also_matched", ",")), "group", "ord", "rank", "also")
    assert got == [("g", 0, 1, ""), ("g", 1, 0, ""), ("h", 2, 0, "event:x")]


def test_chunks_restart_at_their_first_span(spark):
    s = spark.createDataFrame([(1, i, i * 30.0, i * 30.0 + 30) for i in range(5)], "video_id long, ord long, t_start double, t_end double")
    assert [r[1] for r in rows(intervals.pack_chunks(s), "ord", "chunk")] == [0, 0, 1, 1, 2]


def test_nearest_cut_prefers_the_earlier(spark):
    p = spark.createDataFrame([(1, 10.0), (1, 50.0)], "video_id long, t double")
    c = spark.createDataFrame([(1, 9.0), (1, 11.0), (2, 50.0)], "video_id long, cut double")
    assert rows(intervals.nearest_within(p, c, 2.0), "t", "snapped") == [(10.0, 9.0), (50.0, 50.0)]


def test_nearest_midpoint_or_none(spark):
    c = spark.createDataFrame([(1, 0, 10.0), (1, 1, 30.0), (2, 0, 5.0)], "video_id long, ord long, mid double")
    s = spark.createDataFrame([(1, 1, 8.0), (1, 2, 12.0), (1, 3, 29.0), (3, 0, 5.0)], "video_id long, idx long, s_mid double")
    assert rows(intervals.nearest_midpoint(c, s), "video_id", "ord", "segment_idx") == [(1, 0, 1), (1, 1, 3), (2, 0, -1)]


def test_overlap_query_has_whole_texts(spark, tmp_path):
    long = ["a" * 200 + " end", "b" * 990]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(long)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows(catalogue.queries()["overlap_text_join_whole"](spark, str(tmp_path)), "ord", "text")
    assert got == [(0, " | ".join(long)[:1000]), (1, long[1])]


def test_ranges_text(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 40.0, 50.0)], "video_id long, ord long, t_start double, t_end double")
    assert intervals.in_any_range(s, "nonsense, 9-3").count() == 2
    assert rows(intervals.in_any_range(s, "0-10, x"), "ord") == [(0,)]


def test_fusion_ties_and_repeats(spark):
    hits = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 0, "a"), (2, 0, 1, "a"), (2, 0, 2, "b")], "q_id long, stream_no int, rank int, key string")
    got = rows(fusion.reciprocal_rank_fusion(fusion.best_ranks(hits)), "q_id", "rank", "key", "score")
    assert [g[:3] for g in got] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b")]
    assert got[3][3] == pytest.approx(1 / 62)


def test_gate_with_no_positive_top(spark):
    hits = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "q_id long, rank int, score double")
    assert rows(fusion.relative_gate(hits, 0.85), "rank") == [(0,)]


def test_family_maximum_below_zero_divides_by_one(spark):
    c = spark.createDataFrame([(1, "f", -2.0)], "q_id long, family string, score double")
    assert rows(fusion.family_weighted(c, ["q_id"], {}), "score") == [(-2.0,)]


def test_status_lattice_and_zero_duration(spark):
    v = spark.createDataFrame([(1, 0, "ready", 0.0, "x [part 1]"), (1, 1, "error", 0.0, "x [part 2]"), (2, 0, "ready", 1.0, "y"), (2, 1, "queued", 2.0, "y")], "parent_id long, chunk_offset long, status string, duration double, filename string").withColumn("created_at", F.lit("2024"))
    assert rows(rollups.collapse_chunks(v), "parent_id", "status", "duration", "filename") == [(1, "error", None, "x"), (2, "processing", 3.0, "y")]


def test_loop_counts_twice(spark):
    r = spark.createDataFrame([("x", "x")], "src string, dst string")
    assert rows(rollups.graph_nodes(r, 5), "id", "degree") == [("x", 2)]


def test_canonical_and_clock(spark):
    df = spark.createDataFrame([("Matrix-Vector  Product!", 2.5), ("", 3.5)], "n string, s double")
    assert rows(df.select(T.canonical(F.col("n")).alias("n"), T.clock(F.col("s")).alias("c")), "n", "c") == [("", "00:04"), ("matrix vector product", "00:02")]


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0])], "item_id long, vector array<double>")
    queries = items.where("item_id < 5").withColumnRenamed("item_id", "q_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = sorted((q, int(i), r + 1) for q in range(5) for r, i in enumerate(np.argsort(-(u[q] @ u.T), kind="stable")[:4]))
    assert rows(vectors.top_k(items, queries, 4), "q_id", "item_id", "rank") == expected


def test_zero_norm_scores_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine("a", "b").alias("c")).first().c == 0.0


def test_spikes(spark):
    x = [float(i % 3) for i in range(60)]
    x[30] = 90.0
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "video_id long, clip_idx long, score double")
    assert (30,) in rows(timeline.z_peaks(s), "clip_idx")


def test_empty_inputs_keep_the_schema(spark):
    spans = spark.createDataFrame([], "video_id long, ord long, t_start double, t_end double, label string, score double, family string, group string")
    for df in (intervals.merge_labels(spans), intervals.candidate_windows(spans), intervals.pack_chunks(spans), intervals.temporal_nms(spans), intervals.postprocess_shots(spans)):
        assert df.columns and df.count() == 0
