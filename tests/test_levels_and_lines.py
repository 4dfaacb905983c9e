"""Overlap joins by levels, speech splits, streamed medians, pooled vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import folds, intervals, ranking, rolling, vectors

YEARS = 10 * 365 * 86400.0
LEFT, RIGHT = "video_id long, t_start double, t_end double, ord long", "video_id long, t_start double, t_end double, idx long"


def spans(rng, n):
    kinds = [lambda: rng.uniform(0, 3), lambda: rng.uniform(3, 40), lambda: rng.uniform(40, 4000), lambda: 4.0, lambda: 16.0, lambda: 0.0]
    out = [(rng.randrange(3), a := float(rng.choice([rng.uniform(-50, 9000), rng.randrange(0, 9000, 4)])), a + rng.choice(kinds)(), i) for i in range(n)]
    return [*out, (0, -1000.0, YEARS, n), (1, 5.0, 1.0, n + 1), (None, 0.0, 1.0, n + 2), (2, None, 3.0, n + 3), (2, 0.0, None, n + 4)]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(8)
    x, y = spans(rng, 250), spans(rng, 200)
    got = sorted((r.l_ord, r.r_idx) for r in intervals.overlap_join(spark.createDataFrame(x, LEFT).repartition(3), spark.createDataFrame(y, RIGHT)).collect())
    want = sorted((a[3], b[3]) for a in x for b in y if a[0] is not None and a[0] == b[0] and None not in (*a[:3], *b[:3]) and a[1] < b[2] and a[2] > b[1])
    assert got == want and len(want) > 1000


def test_few_rows_and_few_candidates(spark):
    # ten years of ten-second spans would be 31 million cells of ten seconds; one long span costs two rows a level
    many = [(1, i * 10.0, i * 10.0 + 9.0, i) for i in range(2000)] + [(1, 3.0, YEARS, -1)]
    df = spark.createDataFrame(many, LEFT)
    named = df.select(*(F.col(c).alias(f"l_{c}") for c in df.columns)).withColumn("l_level", intervals._level("l_"))
    levels = named.agg(F.array_sort(F.collect_set("l_level")).alias("levels"))
    cells = intervals.with_cells(named, "l", levels)
    assert cells.where("l_ord = -1").count() <= 2 * len(levels.first()[0]) and cells.count() <= 2 * 2 * len(many)
    x, y = cells, cells.withColumnsRenamed({c: f"y{c}" for c in cells.columns})
    tried = x.join(y, (F.col("level") == F.col("ylevel")) & (F.col("cell") == F.col("ycell")) & (F.col("l_own") | F.col("yl_own"))).count()
    assert tried < 12 * len(many)  # all pairs would be two thousand times as many as spans
    assert intervals.overlap_join(df, df.withColumnRenamed("ord", "idx")).count() == 2000 + 2 * 2000 + 1


def whole_list(at, begin, end, longest, least):
    at = sorted(t for t in at if t - begin >= least and end - t >= least)
    cuts, n = [begin], -int(-(end - begin) // longest)
    if end - begin > longest and not at:
        cuts += [begin + (k + 1) * ((end - begin) / n) for k in range(n)]
        return list(zip(cuts, cuts[1:], strict=False))
    while end - cuts[-1] > longest:
        now = cuts[-1]
        good, some = [t for t in at if now + longest / 2 <= t <= now + longest], [t for t in at if now < t <= now + 1.5 * longest]
        cuts.append(max(good) if good else max(some) if some else now + longest)
    if cuts[-1] < end - 1e-3 or len(cuts) == 1:
        cuts.append(end)
    return list(zip(cuts, cuts[1:], strict=False))


def test_splits_as_places_come():
    rng = random.Random(1)
    for _ in range(20_000):
        begin = rng.choice([0.0, 3.5])
        end = begin + rng.choice([5, 10, 12, 30, 60.5])
        at = sorted(rng.choice([rng.uniform(begin - 1, end + 1), float(rng.randint(0, 70))]) for _ in range(rng.choice([0, 1, 2, 3, 6, 15])))
        fold, out = folds.Splits(1, 2, begin, end, 10.0, 0.75), []
        for t in [*at, None]:
            out += fold.add(t)
        out += fold.end()
        assert [r[3:] for r in out] == whole_list(at, begin, end, 10.0, 0.75) and [r[2] for r in out] == list(range(len(out)))


@pytest.mark.parametrize("points", [3, 5, 12])
def test_medians_of_series_in_pieces(points):
    rng = np.random.default_rng(points)
    for n in (0, 1, 2, points - 1, points, points + 1, 50):
        x = np.round(rng.normal(size=n), 2)
        pad = np.pad(x, points // 2, mode="edge") if n else x
        want = [np.median(x) if n else 0.0] * n if n < points else [np.median(pad[i : i + points]) for i in range(n)]
        for step in (1, 3, 100):
            m = rolling.Medians(points)
            got = np.concatenate([*(m.push(x[a : a + step]) for a in range(0, n, step)), m.close()]) if n else m.close()
            assert np.allclose(got, want)


def test_pool_of_odd_vectors(spark, monkeypatch):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", [5.0]), ("a", None), ("b", [None]), (None, [4.0]), (None, [6.0]), ("c", []), ("d", [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "k string, vector array<double>").repartition(4)
    for keys in (vectors.KEYS, 0):
        monkeypatch.setattr(vectors, "KEYS", keys)
        got = {r.k: r.vector for r in vectors.mean_pool(df, "k").collect()}
        assert str(got.pop("d")) == "[1.0, nan]" and got == {"a": [3.0, 2.0], "b": [None], None: [5.0]}


def test_best_and_strong_in_one_pass(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, rng.sample("abcdefgh", rng.randint(0, 6))) for i in range(80)] + [(99, None)], "doc_id long, tokens array<string>")
    items = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["z"]), (9, list("defgh"))], "item_id long, tokens array<string>")
    best = {(r.item_id, r.doc_id, r.shared, r["rank"]) for r in ranking.top_overlap(docs, items, 5).collect()}
    strong = {r.item_id: r.n_strong for r in ranking.strong_overlaps(docs, items).collect()}
    for held in (ranking.HELD, 3):
        monkeypatch.setattr(ranking, "HELD", held)
        got = ranking.top_and_strong(docs, items, 5).collect()
        assert {(r.item_id, r.doc_id, r.shared, r["rank"]) for r in got} == best and {r.item_id: r.n_strong for r in got} == strong


def test_snapping_where_neighbours_may_meet(spark):
    videos = spark.createDataFrame([(1, 100.0), (2, 9.0), (3, 0.0), (4, None), (5, 2000.0)], "video_id long, duration double")
    cuts = spark.createDataFrame([(1, 6.9), (1, 9.6), (1, 15.0), (1, 99.0), (2, 8.0), (5, 39.0), (5, 41.0), (5, None), (9, 1.0)], "video_id long, cut double")
    for tolerance, least in ((2.0, 1.0), (5.0, 3.0), (30.0, 10.0)):
        got = {}
        for r in intervals.snap_grid(videos, cuts, tolerance, least).orderBy("video_id", "segment_idx").collect():
            got.setdefault(r.video_id, []).append((r.t_start, r.t_end))
        for video, duration in ((1, 100.0), (2, 9.0), (5, 2000.0)):
            step = max(7.0, duration / 50)
            marks = [c for v, c in [(1, 6.9), (1, 9.6), (1, 15.0), (1, 99.0), (2, 8.0), (5, 39.0), (5, 41.0)] if v == video]
            moved = []
            for k in range(1, int(np.ceil(round(duration / step, 9)))):
                near = [(abs(k * step - c), c) for c in marks if abs(k * step - c) <= tolerance]
                moved.append(min(near)[1] if near else k * step)
            kept = [0.0]
            for t in sorted(t for t in moved if t < duration):
                if t > kept[-1] + least:
                    kept.append(t)
            assert got[video] == list(zip(kept, [*kept[1:], duration], strict=True))
        assert set(got) == {1, 2, 5}


def test_one_kind_that_fails_leaves_the_others(spark):
    from shotloom.operators import isolation, presets

    shots = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 5, f" c{i}", "hi" if i % 2 else None, "ann" if i < 4 else None) for i in range(6)], "video_id long, shot_idx long, t_start double, t_end double, chunk_caption string, ocr_text string, person string")
    broken = shots.withColumn("ocr_text", F.when(F.col("shot_idx") == 3, F.raise_error(F.lit("torn page"))).otherwise(F.lit("x")))
    rows, status = presets.segments_isolated(broken, [{"id": "shot_detection"}, {"id": "ocr"}, {"id": "person_of_focus"}, {"id": "topic_changes"}, {"id": "speaker_diarization"}])
    got = {r.kind: (r.state, r.n) for r in status.collect()}
    assert got == {"shot_detection": ("done", 6), "ocr": ("fallback", 1), "person_of_focus": ("done", 1), "topic_changes": ("fallback", 1), "speaker_diarization": ("done", 0)}  # no vectors: topics fail as well
    assert "torn page" in {r.kind: r.error for r in status.collect()}["ocr"] and rows.groupBy("definition").count().count() == 4
    bad = lambda: shots.select(F.raise_error(F.lit("x" * 3000)).alias("v"))
    rows, status = isolation.isolated(spark, {"good": lambda: spark.range(3).selectExpr("id as v"), "bad": bad, "worse": bad}, "v long", {"worse": bad})
    assert sorted((r.kind, r.v) for r in rows.collect()) == [("good", 0), ("good", 1), ("good", 2)]
    assert sorted((r.kind, r.state, r.n) for r in status.collect()) == [("bad", "failed", 0), ("good", "done", 3), ("worse", "failed", 0)] and all(len(r.error or "") <= 1000 for r in status.collect())


def test_presets_from_columns(spark):
    from shotloom.operators import presets

    schema = "video_id long, shot_idx long, t_start double, t_end double, role string, person string"
    shots = spark.createDataFrame([(1, i, i * 40.0, i * 40.0 + 40, r, p) for i, (r, p) in enumerate([(None, "a"), ("x", "a"), ("x", None), (None, "a"), ("y", "b"), (None, "b"), (None, None)])], schema)
    turns = spark.createDataFrame([(1, 0, "s", 0.0, 5.0, 1.0), (1, 1, "s", 5.5, 9.0, 1.0), (1, 2, "t", 6.0, 7.0, 1.0), (1, 3, "t", 20.0, 20.1, 1.0), (1, 4, "t", 30.0, 33.0, 1.0)], "video_id long, ord long, speaker string, t_start double, t_end double, score double")
    got = {}
    for r in presets.segments(shots, [{"id": "editorial_segment"}, {"id": "person_of_focus"}, {"id": "speaker_diarization"}], turns).orderBy("definition", "segment_idx").collect():
        got.setdefault(r.definition, []).append((r.t_start, r.t_end, r.label))
    assert got == {
        "editorial_segment": [(0.0, 160.0, "x"), (160.0, 240.0, "y"), (240.0, 280.0, None)],
        "person_of_focus": [(0.0, 80.0, "a"), (120.0, 160.0, "a"), (160.0, 240.0, "b")],
        "speaker_diarization": [(0.0, 9.0, "s"), (30.0, 33.0, "t")],
    }


def test_kinds_of_media_and_frames(spark):
    from shotloom.sources import media

    probes = [(1, True, ["video", "audio"], "12.5"), (2, True, ["video"], None), (3, True, ["audio", "subtitle"], "x"), (4, True, [], "3"), (5, True, None, "3"), (6, False, ["audio"], "3"), (7, None, None, None)]
    got = media.with_modality(spark.createDataFrame(probes, "video_id long, probed boolean, codecs array<string>, duration string")).orderBy("video_id").collect()
    assert [r.modality for r in got] == ["video_audio", "video_only", "audio_only", "audio_only", "audio_only", "video_audio", "video_audio"]
    assert [r.duration_s for r in got] == [12.5, 0.0, 0.0, 3.0, 3.0, 0.0, 0.0] and [r.has_video for r in got] == [True, True, False, False, False, True, True]
    rng = random.Random(4)
    clips = [(i, a := rng.uniform(0, 50), a + rng.choice([-1.0, 0.0, 0.1, 0.5, 3.0, 90.0]), rng.choice([0.0, 24.0, 29.97]), rng.choice([0, 1, 5, 700, 3000])) for i in range(300)]
    df = spark.createDataFrame(clips, "clip long, start_s double, end_s double, fps double, n_frames long")
    for r in media.frame_numbers(df, 8).collect():
        a, b = int(r.start_s * r.fps), min(int(r.end_s * r.fps), r.n_frames)
        a, b = (0, r.n_frames) if b - a <= 0 else (a, b)
        assert r.frames == (np.linspace(a, b - 1, min(8, b - a), dtype=int).tolist() if b > a else [])


def test_the_gate_changes_the_order(spark):
    from shotloom.operators import fusion

    signals = spark.createDataFrame([(1, i, float(i), float(9 - i)) for i in range(10)], "video_id long, clip_idx long, seen double, heard double")
    gates = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0), (3, 1, None), (4, 1, 7.0), (5, 2, 1.0)], "q_id long, video_id long, gate double")
    best = {r.q_id: r.clip_idx for r in fusion.gated_fusion(signals, gates).groupBy("q_id").agg(F.max_by("clip_idx", "fused").alias("clip_idx")).collect()}
    assert best == {1: 9, 2: 0, 3: 9, 4: 0}
