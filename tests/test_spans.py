"""Worked and brute-force cases of windows, runs, partitions, tracks, text functions and account rules."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import text as T
from shotloom.operators import accounts, folds, fusion, intervals, presets, ranking, rollups, spans, timeline, vectors


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def said(spark, column, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(column(F.col("t"))).collect()]


def test_uniform_windows_join_a_short_tail(spark):
    v = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 10.0), (4, 0.0), (5, -3.0), (6, 60.0)], "video_id long, duration double")
    got = rows(spans.uniform_windows(v, 30.0), "video_id", "t_start", "t_end")
    assert [g for g in got if g[0] == 1] == [(1, 0.0, 30.0), (1, 30.0, 60.0), (1, 60.0, 100.0)]
    assert [g for g in got if g[0] == 2][-1] == (2, 90.0, 110.0)
    assert [g for g in got if g[0] > 2] == [(3, 0.0, 10.0), (4, 0.0, 0.1), (5, 0.0, 0.1), (6, 0.0, 30.0), (6, 30.0, 60.0)]


def test_runs_of_clips(spark):
    c = spark.createDataFrame([(1, i) for i in (7, 1, 2, 2, 3, 9)] + [(2, 5)], "video_id long, clip_idx long")
    assert rows(spans.clip_runs(c, ["video_id"]), "video_id", "first", "last") == [(1, 1, 3), (1, 7, 7), (1, 9, 9), (2, 5, 5)]
    w = spark.createDataFrame([(1, 0.0, 4.0, 10), (1, 4.0, 7.0, 10), (1, 15.0, 99.0, 10), (1, 5.0, 5.0, 10), (2, -3.0, 1.0, 10)], "video_id long, t_start double, t_end double, n long")
    assert rows(spans.windows_to_runs(w), "video_id", "first", "last", "t_start", "t_end") == [(1, 0, 3, 0.0, 8.0), (1, 7, 9, 14.0, 20.0), (2, 0, 0, 0.0, 2.0)]


def test_groups_of_ones_and_zeros(spark):
    bits = [0, 1, 1, 0, 0, 1]
    c = spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "video_id long, clip_idx long, bit int")
    got = rows(spans.bit_groups(c), "bit", "t_start", "t_end")
    assert got == [(0, 0.0, 2.0), (0, 6.0, 10.0), (1, 10.0, 12.0), (1, 2.0, 6.0)]
    assert said(spark, lambda x: spans.length_bin(x, (60.0, 30.0, 10.0)), [70.0, 60.0, 59.0, 10.0, 1.0], "double") == [0, 0, 1, 2, None]


def test_orders_of_mixed_videos(spark):
    p = spark.createDataFrame([(1, 0, "a", 10, 14, "a"), (1, 1, "b", 0, 3, "a"), (1, 2, "a", 2, 5, "a")], "mix_id long, piece int, src string, s long, e long, own string")
    r = spark.createDataFrame([(1, 0, 2, 8), (1, 1, 7, 99), (1, 2, 5, 5)], "mix_id long, range_id int, begin long, end long")
    assert rows(spans.resolve_order(p, r), "range_id", "src", "s", "e") == [(0, "a", 12, 14), (0, "a", 2, 3), (0, "b", 0, 3), (1, "a", 2, 5)]
    assert rows(spans.consistency_map(p), "m0", "m1", "s", "e") == [(0, 4, 10, 14), (7, 10, 2, 5)]


def test_class_balanced_top(spark):
    p = spark.createDataFrame([(1, i, s, w) for i, (s, w) in enumerate([(0.9, 0.1), (0.8, 0.1), (0.7, 0.05), (0.2, 0.5), (0.1, 0.6)])], "video_id long, ord long, score double, width double")
    assert rows(spans.class_balanced_top(p, (0.1, 0.5), 6), "slot", "ord", "class") == [(0, 0, 0), (1, 1, 0), (2, 3, 1), (4, 4, 2)]
    assert rows(spans.class_balanced_top(p, (), 2), "slot", "ord") == [(0, 0), (1, 1)]


def test_partition_closes_gaps_and_overlaps(spark):
    s = spark.createDataFrame([(1, 0, 3.0, 10.4), (1, 1, 12.0, 20.0), (1, 2, 18.0, 50.0), (1, 3, 7.0, 7.0), (2, 0, 9.0, 4.0)], "video_id long, ord long, t_start double, t_end double")
    v = spark.createDataFrame([(1, 40.0), (2, 40.0)], "video_id long, duration double")
    cuts = spark.createDataFrame([(1, 10.0), (1, 11.0)], "video_id long, t double")
    assert rows(spans.partition_of(s, v, cuts, 1.0), "ord", "t_start", "t_end") == [(0, 0.0, 10.5), (1, 10.5, 19.0), (2, 19.0, 40.0)]


def test_long_shots_split_where_speech_allows(spark):
    shots = [(1, 0, 0.0, 8.0), (1, 1, 0.0, 30.0), (1, 2, 0.0, 25.0), (1, 3, 0.0, 40.0)]
    words = [(1, 1, "one.", 6.0, 7.0), (1, 1, "two", 8.0, 9.5), (1, 1, "three!", 12.0, 18.0), (1, 1, "four", 19.0, 29.5), (1, 3, "far.", 13.0, 14.5), (1, 3, "end.", 39.0, 39.8)]
    s = spark.createDataFrame(shots, "video_id long, shot_idx long, t_start double, t_end double")
    w = spark.createDataFrame(words, "video_id long, shot_idx long, word string, w_start double, w_end double")
    got = rows(intervals.split_long_shots(s, w), "shot_idx", "t_start", "t_end")
    assert [g[1:] for g in got if g[0] == 0] == [(0.0, 8.0)]
    assert sorted(g[1:] for g in got if g[0] == 1) == [(0.0, 9.5), (9.5, 18.0), (18.0, 28.0), (28.0, 30.0)]
    assert len([g for g in got if g[0] == 2]) == 3 and [g for g in got if g[0] == 2][0][2] == pytest.approx(25 / 3)
    assert sorted(g[1:] for g in got if g[0] == 3) == [(0.0, 14.5), (14.5, 24.5), (24.5, 34.5), (34.5, 40.0)]


def test_interpolation_clamps_at_the_ends(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(np.arange(100), 12, replace=False)).astype(float)
    x, grid = rng.normal(size=12), np.arange(-5, 110, 3.5)
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x, strict=True)] + [(2, 5.0, 7.0)], "video_id long, t double, value double")
    g = spark.createDataFrame([(v, float(a)) for v in (1, 2, 3) for a in grid], "video_id long, t double")
    got = {(r.video_id, r.t): r.value for r in spans.interpolated(s, g).collect()}
    assert np.allclose([got[1, a] for a in grid], np.interp(grid, t, x)) and {got[2, a] for a in grid} == {7.0} and {got[3, a] for a in grid} == {0.0}


@pytest.mark.parametrize("points", [2, 5, 6, 12])
def test_rolling_median(spark, points):
    rng = np.random.default_rng(points)
    series = {v: rng.normal(size=n) for v, n in enumerate((1, 4, 5, 6, 11, 12, 40))}
    df = spark.createDataFrame([(v, i, float(a)) for v, x in series.items() for i, a in enumerate(x)], "video_id long, clip_idx long, score double")
    got = {(r.video_id, r.clip_idx): r.m for r in timeline.rolling_median(df, "score", "m", points).collect()}
    for v, x in series.items():
        half = points // 2
        pad = np.pad(x, half, mode="edge")
        want = [np.median(x)] * len(x) if points < 3 or len(x) < points else [np.median(pad[i : i + points]) for i in range(len(x))]
        assert np.allclose([got[v, i] for i in range(len(x))], want)


def test_spikes_against_brute_force(spark):
    rng = np.random.default_rng(12)
    series = {v: np.round(np.abs(rng.normal(size=n)) * rng.choice([0.1, 3.0], n, p=[0.8, 0.2]), 3) for v, n in enumerate((1, 3, 8, 12, 30, 90))}
    series[9] = np.zeros(20)
    df = spark.createDataFrame([(v, i, float(a)) for v, x in series.items() for i, a in enumerate(x)], "video_id long, clip_idx long, score double")
    got = {}
    for v, i in rows(timeline.z_peaks(df), "video_id", "clip_idx"):
        got.setdefault(v, []).append(i)
    some = 0
    for v, x in series.items():
        pad = lambda y: np.pad(y, 6, mode="edge")
        median = lambda y: np.array([np.median(pad(y)[i : i + 12]) for i in range(len(y))]) if len(y) >= 12 else np.full(len(y), np.median(y))
        low = median(x)
        scale = 1.4826 * median(np.abs(x - low))
        scale[scale < 1e-6] = np.median(scale[scale > 0]) if (scale > 0).any() else 1.0
        z, kept = (x - low) / scale, []
        for i in range(len(x)):
            if z[i] >= 1.5 and z[i] == z[max(0, i - 1) : i + 2].max():
                if not kept or (i - kept[-1]) * 0.5 >= 2.0:
                    kept.append(i)
                elif x[i] > x[kept[-1]]:
                    kept[-1] = i
        assert sorted(got.get(v, [])) == kept
        some += len(kept)
    assert some > 5


def test_suppression_by_islands_is_the_whole_fold(spark):
    rng = random.Random(5)
    made = [("g%d" % (i % 3), i, a := rng.uniform(0, 300), a + rng.uniform(0, 20), rng.choice([0.1, 0.5, 0.9]), "f%d" % (i % 4)) for i in range(400)]
    df = spark.createDataFrame(made, "group string, ord long, t_start double, t_end double, score double, family string")
    want = []
    for g in ("g0", "g1", "g2"):
        kept = []
        for _, o, a, b, s, f in sorted((r for r in made if r[0] == g), key=lambda r: (-r[4], r[3] - r[2], r[1])):
            hit = next((k for k in kept if max(b, k[2]) > min(a, k[1]) and (min(b, k[2]) - max(a, k[1])) / (max(b, k[2]) - min(a, k[1])) >= 0.5), None)
            if hit is None:
                kept.append([o, a, b, f, []])
            elif f != hit[3] and f not in hit[4]:
                hit[4].append(f)
        want += [(g, k[0], i, k[4]) for i, k in enumerate(kept)]
    assert rows(intervals.temporal_nms(df), "group", "ord", "rank", "also_matched") == sorted(want, key=repr)


def test_event_ids_are_name_based(spark):
    got = said(spark, timeline.event_id, ["1:shots:0", "café:speakers:12"])
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_OID, k)) for k in ("1:shots:0", "café:speakers:12")]


def test_words_of_texts(spark):
    assert said(spark, T.canonical, ["Café-Society, (2)", "你好 / 世界", "a_b  c", None]) == ["café society 2", "你好 世界", "a_b c", None]
    assert T.expanded("  Cheering ") == sorted({"cheering", "cheer", "crowd", "applause", "clap", "chant", "ovation", "chatter", "hubbub", "shout", "yell", "screaming"})
    assert T.expanded("plain") == ["plain"] and T.expanded(" ") == []
    assert said(spark, T.object_phrase, ["When does the red car appear?", "show me when is a goal happening", "where", "The dog is seen", None, "at what time did it was"]) == ["red car.", "goal happening.", "", "dog.", "", "it."]
    assert said(spark, T.citations, ["see [01:30-2:05] and [1:00 – 1:10], not [1:2-3:04]", None]) == [[(90.0, 125.0), (60.0, 70.0)], None]
    assert said(spark, T.relation_name, ["Is Part of. More", " . x", "", None]) == ["is part of", "related_to", "related_to", "related_to"]
    assert [tuple(x) for x in said(spark, T.named_parts, ["A box.\nNAMES: Acme, none, Bolt ", "no line", "x\nnames: NONE", "NAMES:"])] == [("A box.", ["Acme", "Bolt"]), ("no line", []), ("x", []), ("", [])]
    assert said(spark, rollups.unquoted, [' "a" ', "'b", "''", '"', "c"]) == ["a", "'b", "", '"', "c"]
    assert said(spark, T.language, ["", "hello", "tóm tắt"]) == ["", "English", "Vietnamese"]
    assert said(spark, T.lexical_gate, ["loud cheer", "nothing", "win"]) == pytest.approx([1.0, 0.0, 0.44])
    assert said(spark, T.clock, [89.5, 90.5, 0.4], "double") == ["01:30", "01:30", "00:00"]
    assert said(spark, T.first_json, ["x [1, 2] y", "[1, {", None]) == ["[1, 2]", None, None]


def test_rules(spark):
    d = spark.createDataFrame([(None, 1), ("person", 2), ("method", 3)], "type string, v int")
    assert rows(d.where(fusion.keeps(must_not=[F.col("type") == "person"])), "v") == [(1,), (3,)]
    assert rows(d.where(fusion.keeps(should=[F.col("type") == "person", F.col("v") == 1])), "v") == [(1,), (2,)]
    p = spark.createDataFrame([("superuser", None, False), (None, None, True), ("admin", None, True), ("user", True, False)], "role string, active boolean, own boolean")
    assert [r[0] for r in p.select(accounts.patch_refusal(F.col("role"), F.col("active"), F.col("own"))).collect()] == [400, 400, 403, None]
    prices = spark.createDataFrame([("gpt-4o", 1.0, 1.0), ("gpt-4o-mini", 0.5, 0.5)] + [(f"x{i}", 1.0, 1.0) for i in range(12_000)], "prefix string, price_in double, price_out double")
    u = spark.createDataFrame([("gpt-4o-mini-2024", 1000, 0), ("gpt-4o", 1000, 0), ("x11999z", 1000, 0), ("other", 1000, 0)], "model string, prompt long, completion long")
    assert rows(rollups.priced(u, prices), "model", "cost") == [("gpt-4o", 1.0), ("gpt-4o-mini-2024", 0.5), ("other", 0.0), ("x11999z", 1.0)]


def test_ranking_by_tokens_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, None), (4, ["a", "b", "c"])], "doc_id long, tokens array<string>")
    items = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["z"]), (9, ["b"])], "item_id long, tokens array<string>")
    want = [(7, 1, 2, 2), (7, 4, 3, 1), (9, 1, 1, 1), (9, 2, 1, 2)]
    for held in (ranking.HELD, 0):
        monkeypatch.setattr(ranking, "HELD", held)
        assert rows(ranking.top_overlap(docs, items, 2), "item_id", "doc_id", "shared", "rank") == want
        assert [r for r in rows(ranking.strong_overlaps(docs, items), "item_id", "n_strong") if r[1]] == [(7, 2)]


def test_top_k_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    made = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(60, [1.0, 2.0], 0), (61, None, 0), (62, [0.0] * 5, 0)]
    df = spark.createDataFrame(made, "id long, vector array<double>, part int")
    for block in (vectors.QUERY_BLOCK, 7):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "ITEM_BLOCK", block)
        for by in (None, "part"):
            got = vectors.top_k(df.withColumnRenamed("id", "item_id"), df.withColumnRenamed("id", "q_id").where("q_id < 60"), 4, by)
            u = x / np.linalg.norm(x, axis=1, keepdims=True)
            for r in got.where("q_id < 60").collect():
                s = {j: u[r.q_id] @ u[j] for j in range(60) if by is None or j % 3 == r.q_id % 3}
                s |= {62: 0.0} if by is None or r.q_id % 3 == 0 else {}
                assert sorted(s, key=lambda j: (-round(s[j], 9), j))[r["rank"] - 1] == r.item_id


def test_presets(spark):
    shots = spark.createDataFrame([(1, i, i * 25.0, i * 25.0 + 25, [1.0, 0.0] if i < 2 else [0.0, 1.0], "cap %d. x" % i, None, [("Crowd", 0.9)] if i == 1 else []) for i in range(4)], "video_id long, shot_idx long, t_start double, t_end double, vector array<double>, chunk_caption string, asr_text string, tags array<struct<label:string,score:double>>")
    got = rows(presets.segments(shots, [{"id": "topic_changes"}, {"id": "sports_highlights", "ranges": "0-60"}, {"id": "mine"}]), "definition", "segment_idx", "t_start", "t_end", "label")
    assert got == [("mine", 0, 0.0, 50.0, None), ("mine", 1, 50.0, 100.0, None), ("sports_highlights", 1, 25.0, 50.0, "crowd"), ("topic_changes", 0, 0.0, 50.0, "cap 0"), ("topic_changes", 1, 50.0, 100.0, "cap 2")]
    with pytest.raises(ValueError):
        presets.segments(shots, [{"id": "x"}] * 11)
    raw = spark.createDataFrame([({"n": "2", "b": "YES", "k": "Red", "z": "?"},), ({"n": "x", "k": "red"},)], "raw map<string,string>")
    fields = [{"name": "n", "type": "number"}, {"name": "b", "type": "boolean"}, {"name": "k", "enum": ["red"]}]
    assert [r.metadata for r in presets.with_fields(raw, "raw", fields).collect()] == [{"n": "2.0", "b": "true"}, {"k": "red"}]


def test_folds_hold_one_group(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "k long, v long")

    class Sum:
        def __init__(self, k):
            self.k, self.s = k, 0

        def add(self, v):
            self.s += v
            return []

        def end(self):
            return [(self.k, self.s)]

    assert rows(folds.fold(df, ["k"], ["v"], ["v"], Sum, "k long, s long"), "k", "s") == [(k, sum(range(k, 50, 5))) for k in range(5)]
    assert folds.fold(df.limit(0), ["k"], ["v"], ["v"], Sum, "k long, s long").count() == 0
