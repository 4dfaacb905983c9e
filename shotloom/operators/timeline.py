"""Timeline tracks: speakers, spoken windows, summaries, keyword flags, spikes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Apart, fold
from .rolling import rolling_median, rolling_spread

__all__ = ["rolling_median"]


def numbered_speakers(turns: DataFrame, longest: int = 200) -> DataFrame:
    """Turns with the speaker's number by first appearance and a label "Speaker n: text"."""
    firsts = turns.groupBy("video_id", "speaker").agg(F.min(F.struct("t_start", "ord")).alias("first"))
    numbers = firsts.select("video_id", "speaker", F.row_number().over(Window.partitionBy("video_id").orderBy("first")).alias("number"))
    label = F.substring(F.concat(F.lit("Speaker "), F.col("number"), F.lit(": "), F.coalesce("text", F.lit(""))), 1, longest)
    return turns.join(numbers, ["video_id", "speaker"]).withColumn("label", label)


def spoken_windows(turns: DataFrame, seconds: float = 120.0) -> DataFrame:
    """Bounds and number of turns of each window of ``seconds`` in which something is said."""
    w = turns.groupBy("video_id", F.floor(F.col("t_start") / seconds).cast("long").alias("window_idx"))
    return w.agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.some(F.trim(F.coalesce("text", F.lit(""))) != "").alias("spoken"), F.count("*").alias("n_turns")).where("spoken")


def summary_grid(segments: DataFrame, seconds: float = 120.0, most: int = 24) -> DataFrame:
    """Grid windows with their first ``most`` segment ids; the last window of a video ends with its last segment."""
    g = segments.groupBy("video_id", F.floor(F.col("t_start") / seconds).cast("long").alias("window_idx")).agg(F.slice(F.array_sort(F.collect_list("ord")), 1, most).alias("segment_ids"), F.max("t_end").alias("last_end"))
    final = F.max("window_idx").over(Window.partitionBy("video_id")) == F.col("window_idx")
    return g.select("video_id", "window_idx", (F.col("window_idx") * seconds).alias("t_start"), F.when(final, F.col("last_end")).otherwise((F.col("window_idx") + 1) * seconds).alias("t_end"), "segment_ids")


def keyword_flags(spans: DataFrame, keywords: list[str], least: float = 0.15) -> DataFrame:
    """Spans whose label has a keyword, at ``least`` or more: the first keyword and low, medium (0.35) or high (0.6)."""
    event = reduce(lambda rest, k: F.when(F.lower("label").contains(k), k).otherwise(rest), reversed(keywords), F.lit(None).cast("string"))
    rows = spans.withColumn("event", event).where(F.col("event").isNotNull() & (F.col("score") >= least))
    return rows.withColumn("intensity", F.when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.35, "medium").otherwise("low"))


def tracks(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per kind and video that has spans: how many and their bounds."""
    rows = [df.groupBy("video_id").agg(F.count("*").alias("n"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end")).withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def z_peaks(series: DataFrame, seconds: float = 0.5, baseline: float = 6.0, least: float = 1.5, gap: float = 2.0) -> DataFrame:
    """(video_id, clip_idx, z): spikes of each video's series, a value (score) every ``seconds``.

    z is the distance from the rolling median over the rolling median of such distances (times 1.4826; where that is no more than 0, the
    median of the video's positive ones, or 1). Peaks are maxima of three at the ends too, with z of ``least`` or more; of two closer than ``gap`` seconds the one of the higher score stays.
    """
    video = Window.partitionBy("video_id")
    line = video.orderBy("clip_idx")
    rows = rolling_spread(series, max(5, round(baseline / seconds))).withColumn("_scale", 1.4826 * F.col("mad"))
    usual = F.percentile(F.when(F.col("_scale") > 0, F.col("_scale")), F.lit(0.5)).over(video)
    rows = rows.withColumn("_usual", usual).withColumn("_scale", F.when(F.col("_scale") < 1e-6, F.coalesce("_usual", F.lit(1.0))).otherwise(F.col("_scale")))
    rows = rows.withColumn("z", (F.col("score") - F.col("floor")) / F.col("_scale"))
    tops = rows.withColumn("_top", F.max("z").over(line.rowsBetween(-1, 1))).where((F.col("z") >= least) & (F.col("z") == F.col("_top"))).withColumn("t", F.col("clip_idx") * seconds)
    return fold(tops, ["video_id"], ["clip_idx"], ["clip_idx", "t", "score", "z"], lambda video: Apart(video, gap), "video_id long, clip_idx long, z double")


def _trimmed(text: str) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def text_track(segments: DataFrame, longest: int = 200) -> DataFrame:
    """Runs of segments (video_id, ord, t_start, t_end, text) that show the same text, at most a second apart."""
    from .intervals import merge_labels

    rows = segments.withColumn("label", F.substring(_trimmed("text"), 1, longest)).where("label <> ''").withColumn("score", F.lit(1.0))
    return merge_labels(rows).select("video_id", "t_start", "t_end", "label", F.col("ord").alias("tie"))


def scene_track(segments: DataFrame) -> DataFrame:
    """Each segment as "Scene n"."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t_start", "ord"))
    return segments.select("video_id", "t_start", "t_end", F.concat(F.lit("Scene "), n).alias("label"), F.col("ord").alias("tie"))


def topic_track(segments: DataFrame, summaries: DataFrame, seconds: float = 120.0, longest: int = 200) -> DataFrame:
    """Windows in which something is said and that have a summary (video_id, window_idx, summary)."""
    rows = spoken_windows(segments, seconds).join(summaries.withColumn("label", F.substring(_trimmed("summary"), 1, longest)).where("label <> ''"), ["video_id", "window_idx"])
    return rows.select("video_id", "t_start", "t_end", "label", F.col("window_idx").alias("tie"))


def highlight_track(moments: DataFrame) -> DataFrame:
    """Ranked moments as "Highlight n", in their rank's order."""
    return moments.select("video_id", "t_start", "t_end", F.concat(F.lit("Highlight "), "rank").alias("label"), F.col("rank").cast("long").alias("tie"))


def action_track(actions: DataFrame, longest: int = 200) -> DataFrame:
    """Actions with a text and a time, in order."""
    rows = actions.where("t_start is not null").withColumn("label", F.substring("action", 1, longest)).where("label <> ''")
    return rows.select("video_id", "t_start", "t_end", "label", F.col("ord").alias("tie"))


def speaker_track(turns: DataFrame, segments: DataFrame, snippet: int = 120, longest: int = 200) -> DataFrame:
    """Turns as "Speaker n: what is said meanwhile", numbered by first appearance; turns without a speaker go."""
    from .intervals import overlap_join

    known = turns.where("speaker is not null and t_start is not null").withColumn("text", F.lit(""))
    numbers = numbered_speakers(known).select("video_id", "ord", "t_start", "t_end", "number")
    heard = segments.withColumn("text", _trimmed("text")).where("text <> ''").select("video_id", "ord", "t_start", "t_end", "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_t_start", "r_ord", "r_text"))), lambda x: x["r_text"]), " ")
    texts = overlap_join(numbers.select("video_id", "ord", "t_start", "t_end"), heard).groupBy(F.col("l_video_id").alias("video_id"), F.col("l_ord").alias("ord")).agg(F.substring(said, 1, snippet).alias("said"))
    label = F.concat(F.lit("Speaker "), F.col("number"), F.coalesce(F.concat(F.lit(": "), F.nullif("said", F.lit(""))), F.lit("")))
    return numbers.join(texts, ["video_id", "ord"], "left").select("video_id", "t_start", "t_end", F.substring(label, 1, longest).alias("label"), F.col("ord").alias("tie"))


def build(parts: dict[str, DataFrame]) -> DataFrame:
    """All tracks (kind -> video_id, t_start, t_end, label, tie) as events with i, their place in the track, and a key of video, kind and place.

    Events of a track are in time order, highlights in the order of their rank.
    """
    both = reduce(DataFrame.unionByName, (df.select("video_id", "t_start", "t_end", "label", F.col("tie").cast("long").alias("tie"), F.lit(kind).alias("kind")) for kind, df in parts.items()))
    when = F.when(F.col("kind") == "highlights", 0.0).otherwise(F.col("t_start"))
    i = F.row_number().over(Window.partitionBy("video_id", "kind").orderBy(when, "tie")) - 1
    return both.withColumn("i", i.cast("long")).withColumn("event_key", F.concat_ws(":", "video_id", "kind", "i")).drop("tie")


def shape(events: DataFrame) -> DataFrame:
    """One row per video and kind with its segments in time order."""
    return events.groupBy("video_id", "kind").agg(F.array_sort(F.collect_list(F.struct("t_start", "i", "t_end", "label"))).alias("segments"))


def event_texts(events: DataFrame, segments: DataFrame, longest: int = 1000) -> DataFrame:
    """Events with their label and the texts of the segments (idx, text) that they overlap, joined by ' | ' and cut."""
    from .intervals import overlap_join

    heard = segments.withColumn("text", _trimmed("text")).where("text <> ''").select("video_id", "idx", "t_start", "t_end", "text")
    pairs = overlap_join(events.select("video_id", "kind", "i", "t_start", "t_end"), heard)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_t_start", "r_idx", "r_text"))), lambda x: x["r_text"]), " | ")
    key = ["video_id", "kind", "i"]
    texts = pairs.groupBy(*(F.col(f"l_{c}").alias(c) for c in key)).agg(said.alias("said"))
    return events.join(texts, key, "left").withColumn("text", F.substring(F.concat_ws(" | ", F.nullif("label", F.lit("")), "said"), 1, longest)).drop("said")


def event_id(key: Column, namespace: str = "6ba7b8129dad11d180b400c04fd430c8") -> Column:
    """The name-based (version 5) id of a key in a namespace, which is that of object identifiers."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def parsed_actions(rows: DataFrame, span: float, longest: int = 200) -> DataFrame:
    """Actions of the first JSON list in ``raw`` as times of the video: t is clamped to the clip, the end to the clip's.

    Items without a text or a number t are left out; of equal texts, apart from case and white space, the earliest stays.
    ``rows`` has video_id, clip_start, clip_dur and columns that name the clip.
    """
    items = F.from_json(F.regexp_extract("raw", r"(?s)\[.*\]", 0), "array<string>")
    keys = [c for c in rows.columns if c != "raw"]
    each = rows.select(*keys, F.posexplode(items).alias("n", "item")).withColumn("a", F.from_json("item", "t string, action string"))
    each = each.withColumn("action", _trimmed("a.action")).withColumn("t", F.col("a.t").try_cast("double"))
    each = each.where("action <> '' and t is not null").withColumn("t", F.greatest(F.lit(0.0), F.least("t", "clip_dur")))
    each = each.select(*keys, "n", F.substring("action", 1, longest).alias("action"), F.round(F.col("clip_start") + F.col("t"), 2).alias("t_start"), F.round(F.least(F.col("clip_start") + F.col("clip_dur"), F.col("clip_start") + F.col("t") + span), 2).alias("t_end"))
    phrase = F.trim(F.regexp_replace(F.lower("action"), r"\s+", " "))
    best = each.groupBy(*keys, phrase.alias("phrase")).agg(F.min_by(F.struct("action", "t_start", "t_end"), F.struct("t_start", "n")).alias("b"))
    return best.select(*keys, "b.*")


#: Sounds that mark a play, in the order in which they name it.
PLAYS = ("cheer", "applause", "crowd", "shout", "yell", "whistle", "horn", "siren", "slam", "dunk")
#: What a class of sound tells of excitement.
EXCITING = {"cheering": 1.0, "applause": 0.9, "crowd": 0.8, "whistle": 0.7, "shout": 0.6, "yell": 0.6, "screaming": 0.6, "chatter": 0.3, "speech": 0.15}


def sports_plays(shots: DataFrame, least: float = 0.15) -> DataFrame:
    """Shots whose ``tags`` (label, score) name a play: the best such tag's (ties: the first) event, intensity and score."""
    names = lambda label: reduce(lambda a, b: a | b, (F.lower(label).contains(k) for k in PLAYS))
    tags = F.filter(F.transform("tags", lambda t, n: F.struct(t["score"].alias("score"), (-n).alias("n"), F.lower(t["label"]).alias("label"))), lambda t: (t["score"] >= least) & names(t["label"]))
    rows = shots.withColumn("best", F.array_max(tags)).where("best is not null").withColumn("label", F.col("best.label")).withColumn("score", F.col("best.score"))
    return keyword_flags(rows, list(PLAYS), least).drop("best", "tags")


def excitement(probs: DataFrame) -> DataFrame:
    """(video_id, step, total, norm): probabilities of classes (label, prob) weighed and added; norm runs from 0 to 1 inside a video."""
    from .fusion import min_max

    weight = F.greatest(*(F.when(F.lower("label").contains(k), w).otherwise(0.0) for k, w in EXCITING.items()))
    rows = probs.groupBy("video_id", "step").agg(F.sum(F.col("prob") * weight).alias("total"))
    return rows.withColumn("norm", min_max("total", "video_id"))


def top_tag_runs(segments: DataFrame, least: float = 0.15) -> DataFrame:
    """Runs of segments whose first tag (of ``tags``, best first) is the same, at ``least`` or more; other segments do not end a run."""
    from .intervals import merge_labels

    top = F.get("tags", F.lit(0))
    rows = segments.withColumn("label", top["label"]).withColumn("score", top["score"]).where((F.coalesce("label", F.lit("")) != "") & (F.col("score") >= least))
    return merge_labels(rows.drop("tags"))
