"""Windows, runs, groups, partitions and orders over the time line of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import beside, island, nearest_within, with_islands


def uniform_windows(videos: DataFrame, seconds: float = 30.0) -> DataFrame:
    """(video_id, window_idx, t_start, t_end): windows of ``seconds``; a last one under half of that joins the one before.

    A duration of 0 or less gives one window of a tenth of a second.
    """
    n = f"greatest(1, cast(ceil(round((duration - 1e-3) / {seconds}, 9)) as int))"
    v = videos.withColumn("n", F.expr(n)).withColumn("m", F.expr(f"n - if(n >= 2 and duration - (n - 1) * {seconds} < {seconds / 2}, 1, 0)"))
    v = v.withColumn("window_idx", F.explode(F.expr("sequence(0, m - 1)")))
    end = F.when(F.col("duration") <= 0, F.lit(0.1)).when(F.col("window_idx") == F.col("m") - 1, F.col("duration")).otherwise((F.col("window_idx") + 1) * seconds)
    return v.select("video_id", "window_idx", (F.col("window_idx") * seconds).alias("t_start"), end.alias("t_end"))


def groups_from(shots: DataFrame, starts: Column, order: str = "shot_idx") -> DataFrame:
    """Rows with group_no, counted from the rows where ``starts`` holds; rows before the first of them are in no group and go."""
    return shots.withColumn("group_no", island(["video_id"], [F.col(order)], starts) - 1).where("group_no >= 0")


def _blank(text: str) -> Column:
    """The text without outer white space, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def described_groups(shots: DataFrame, by: list[str], order: str = "shot_idx") -> DataFrame:
    """Each group's bounds, number of shots, first and last shot and a title.

    The title is the first caption's beginning up to a full stop, 80 characters of it; else that of the first transcript;
    else "Topic (n shots)". Shots have chunk_caption and asr_text.
    """
    said = lambda c: F.substring(F.substring_index(F.min_by(_blank(c), F.when(_blank(c).isNotNull(), F.col(order))), ".", 1), 1, 80)
    g = shots.groupBy(*by).agg(
        F.min_by("t_start", order).alias("t_start"),
        F.max_by("t_end", order).alias("t_end"),
        F.count("*").alias("shot_count"),
        F.min(order).alias("first_idx"),
        F.max(order).alias("last_idx"),
        said("chunk_caption").alias("_caption"),
        said("asr_text").alias("_said"),
    )
    return g.withColumn("title", F.coalesce("_caption", "_said", F.format_string("Topic (%d shots)", "shot_count"))).drop("_caption", "_said")


def partition_of(segments: DataFrame, videos: DataFrame, cuts: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Loose segments (video_id, ord, t_start, t_end) as a partition of [0, duration].

    Bounds are clamped and moved to near cuts (0 and the duration are cuts); the first begins at 0 and the last ends with the video;
    a gap or an overlap of neighbours closes at its middle. Segments without an extent go, before and after.
    """
    v = videos.select("video_id", "duration")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(c, "duration"))
    rows = segments.join(v, "video_id").select("video_id", "ord", "duration", clamp("t_start").alias("a"), clamp("t_end").alias("b")).where("b > a")
    marks = cuts.select("video_id", F.col("t").cast("double").alias("cut")).union(v.select("video_id", F.lit(0.0))).union(v.select("video_id", F.col("duration").cast("double")))
    points = rows.select("video_id", "ord", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("t")), F.struct(F.lit(1).alias("end"), F.col("b").alias("t")))).alias("p")).select("video_id", "ord", "p.end", "p.t")
    snapped = nearest_within(points, marks, tolerance).groupBy("video_id", "ord").agg(F.max(F.when(F.col("end") == 0, F.col("snapped"))).alias("x"), F.max(F.when(F.col("end") == 1, F.col("snapped"))).alias("y"))
    line = Window.partitionBy("video_id").orderBy("a", "ord")
    rows = rows.join(snapped, ["video_id", "ord"]).withColumn("_before", F.lag("y").over(line)).withColumn("_after", F.lead("x").over(line))
    begin = F.when(F.col("_before").isNull(), 0.0).otherwise((F.col("_before") + F.col("x")) / 2)
    end = F.when(F.col("_after").isNull(), F.col("duration")).otherwise((F.col("y") + F.col("_after")) / 2)
    # neighbours that meet already have their middle there
    return rows.select("video_id", "ord", begin.alias("t_start"), end.alias("t_end")).where("t_end > t_start")


def clip_runs(clips: DataFrame, by: list[str]) -> DataFrame:
    """Maximal runs (first, last) of the distinct clip numbers (clip_idx) of each ``by``."""
    rows = clips.select(*by, "clip_idx").distinct().withColumn("_run", F.col("clip_idx") - F.row_number().over(Window.partitionBy(*by).orderBy("clip_idx")))
    return rows.groupBy(*by, "_run").agg(F.min("clip_idx").alias("first"), F.max("clip_idx").alias("last")).drop("_run")


def windows_to_runs(windows: DataFrame, clip_seconds: float = 2.0) -> DataFrame:
    """Windows (video_id, t_start, t_end, n: clips of the video) as merged runs of clips, with the seconds that these cover."""
    w = windows.where("t_end > t_start and n > 0").withColumn("first", F.expr(f"greatest(0, least(n - 1, cast(floor(t_start / {clip_seconds}) as long)))"))
    w = w.withColumn("last", F.expr(f"greatest(first, least(n - 1, cast(ceil(t_end / {clip_seconds}) as long) - 1))"))
    spans = w.select("video_id", F.col("first").cast("double").alias("t_start"), F.col("last").cast("double").alias("t_end"))
    runs = with_islands(spans, ["video_id"], [F.col("t_start"), F.col("t_end")], 1.0).groupBy("video_id", "island").agg(F.min("t_start").cast("long").alias("first"), F.max("t_end").cast("long").alias("last"))
    return runs.select("video_id", "first", "last", (F.col("first") * clip_seconds).alias("t_start"), ((F.col("last") + 1) * clip_seconds).alias("t_end"))


def bit_groups(clips: DataFrame, clip_seconds: float = 2.0) -> DataFrame:
    """(video_id, bit, t_start, t_end): maximal runs of equal bits of a series of clips (video_id, clip_idx, bit)."""
    line = [F.col("clip_idx")]
    new = F.col("bit") != F.lag("bit").over(Window.partitionBy("video_id").orderBy(*line))
    runs = clips.withColumn("_run", island(["video_id"], line, new)).groupBy("video_id", "_run", "bit").agg(F.min("clip_idx").alias("a"), F.max("clip_idx").alias("b"))
    return runs.select("video_id", "bit", (F.col("a") * clip_seconds).alias("t_start"), ((F.col("b") + 1) * clip_seconds).alias("t_end"))


def length_bin(length: Column, borders: tuple[float, ...]) -> Column:
    """The first of descending ``borders`` that a length reaches, by number; null below all."""
    out = F.lit(None).cast("int")
    for i, border in reversed(list(enumerate(borders))):
        out = F.when(length >= border, i).otherwise(out)
    return out


def length_class(width: Column, borders: tuple[float, ...]) -> Column:
    """How many of ascending ``borders`` lie below a width."""
    return sum(((width > b).cast("int") for b in borders), F.lit(0))


def class_balanced_top(proposals: DataFrame, borders: tuple[float, ...], queries: int, by: str = "video_id") -> DataFrame:
    """(by, slot, ord, class): the best proposals of each length class, an equal share of ``queries`` for each, laid out class by class.

    Without borders the best of all. Ties by ``ord``; slots of a class with fewer proposals stay empty.
    """
    share = queries // (len(borders) + 1)
    rows = proposals.withColumn("class", length_class(F.col("width"), borders))
    rank = F.row_number().over(Window.partitionBy(by, "class").orderBy(F.desc("score"), "ord"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= share).select(by, (F.col("class") * share + F.col("_n") - 1).alias("slot"), "ord", "class")


def mixed_positions(pieces: DataFrame) -> DataFrame:
    """Pieces (mix_id, piece, src, s, e) of a mixed video with m0 and m1, where they lie in it."""
    before = F.coalesce(F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("mix_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pieces.withColumn("m0", before).withColumn("m1", F.col("m0") + F.col("e") - F.col("s"))


def resolve_order(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """(mix_id, range_id, piece, src, s, e): what a range [begin, end) of a mixed video is in its sources."""
    rows = mixed_positions(pieces).join(ranges, "mix_id").where("m0 < end and m1 > begin")
    low, high = F.greatest("begin", "m0"), F.least("end", "m1")
    return rows.select("mix_id", "range_id", "piece", "src", (F.col("s") + low - F.col("m0")).alias("s"), (F.col("s") + high - F.col("m0")).alias("e")).where("e > s")


def consistency_map(pieces: DataFrame, own: str = "own") -> DataFrame:
    """(mix_id, m0, m1, s, e): pieces of a mixed video that come from the video named by ``own``."""
    return mixed_positions(pieces).where(F.col("src") == F.col(own)).select("mix_id", "m0", "m1", "s", "e")


def interpolated(series: DataFrame, grid: DataFrame) -> DataFrame:
    """``grid`` (video_id, t) with the value that lies on the line between the points (t, value) of ``series`` beside it.

    Beyond the ends the end's value counts; a series of one point is constant; a video without points has 0.
    """
    rows = beside(grid, series.groupBy("video_id", F.col("t").cast("double").alias("t")).agg(F.first("value").alias("value")), "t", ["value"])
    a, b = F.col("_before"), F.col("_after")
    share = (F.col("t") - a["t"]) / (b["t"] - a["t"])
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["t"] == b["t"]), a["value"]).otherwise(a["value"] + share * (b["value"] - a["value"]))
    return rows.withColumn("value", F.coalesce(value, F.lit(0.0))).drop("_before", "_after")


def merged_transcripts(shots: DataFrame, turns: DataFrame, longest: int = 400) -> DataFrame:
    """(video_id, turn_idx, transcript): each shot's text goes to the turn that it overlaps longest (ties: the first).

    A turn's texts come in time order, each once, ``longest`` characters and an ellipsis where more is cut. Shots have shot_idx and text; blank texts are left out.
    """
    from .intervals import assign_by_overlap

    spoken = shots.withColumn("text", _blank("text")).where("text is not null")
    owned = assign_by_overlap(spoken.select("video_id", "shot_idx", "t_start", "t_end"), turns).join(spoken.select("video_id", "shot_idx", "t_start", "text"), ["video_id", "shot_idx"])
    firsts = owned.groupBy("video_id", "turn_idx", "text").agg(F.min(F.struct("t_start", "shot_idx")).alias("at"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    rows = firsts.groupBy("video_id", "turn_idx").agg(said.alias("said"))
    cut = F.when(F.length("said") > longest, F.concat(F.substring("said", 1, longest), F.lit("…"))).otherwise(F.col("said"))
    return turns.select("video_id", "turn_idx").join(rows, ["video_id", "turn_idx"], "left").select("video_id", "turn_idx", F.coalesce(cut, F.lit("")).alias("transcript"))


def zipped(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], by: str) -> DataFrame:
    """The n-th row of ``left`` of each ``by`` beside the n-th of ``right``, numbered by step; rows of ``left`` without one stay."""
    n = lambda df, order: df.withColumn("step", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return n(left, left_order).join(n(right, right_order), [by, "step"], "left")
