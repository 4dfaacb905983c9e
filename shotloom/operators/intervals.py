"""Interval operators over spans of media: merging, padding, grids, packing, suppression, joins.

Spans are rows of (video_id, t_start, t_end, ...). Everything is computed for all videos at once, partitioned by
the key columns given as ``by``; order inside a video is (t_start, ``tie``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import Packing, Splits, Suppression, fold


def island(by: list[str], order: list, starts_new: Column) -> Column:
    """Running number of the island a row is in; ``starts_new`` (null: false) opens one."""
    return F.sum(F.when(starts_new, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def reach(by: list[str], order: list, end: str = "t_end") -> Column:
    """The latest end of the rows before this one."""
    return F.max(end).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def with_islands(df: DataFrame, by: list[str], order: list, gap: float = 0.0, name: str = "island") -> DataFrame:
    """Numbers gaps-and-islands: a row opens one if it starts more than ``gap`` after all ends so far."""
    return df.withColumn("_reach", reach(by, order)).withColumn(name, island(by, order, F.col("t_start") > F.col("_reach") + gap)).drop("_reach")


def merge_contiguous(shots: DataFrame, gap: float = 1.0, tie: str = "shot_idx", text: str = "asr_text") -> DataFrame:
    """Contiguous shots of a video as one clip: bounds, best score, the best shot's index, its texts in time order.

    Of equal scores the earlier shot's index counts. Blank texts are left out.
    """
    order = [F.col("t_start"), F.col(tie)]
    rows = with_islands(shots, ["video_id"], order, gap)
    said = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct("t_start", tie, text))))
    return rows.groupBy("video_id", "island").agg(
        F.min("t_start").alias("t_start"),
        F.max("t_end").alias("t_end"),
        F.max("score").alias("score"),
        F.min_by(tie, F.struct(-F.col("score"), F.col("t_start"), F.col(tie))).alias(tie),
        F.array_join(F.transform(said, lambda x: x[text]), " ").alias(text),
        F.count("*").alias("n_shots"),
    ).drop("island")


def merge_labels(spans: DataFrame, by: str = "video_id", label: str = "label", tie: str = "ord", gap: float = 1.0) -> DataFrame:
    """Neighbouring spans of one label, at most ``gap`` apart, as one; another label in between ends the run."""
    order = [F.col("t_start"), F.col(tie)]
    runs = spans.withColumn("run", island([by], order, ~F.col(label).eqNullSafe(F.lag(label).over(Window.partitionBy(by).orderBy(*order)))))
    rows = with_islands(runs, [by, "run"], order, gap)
    return rows.groupBy(by, label, "run", "island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("score").alias("score"), F.min(tie).alias(tie)).drop("run", "island")


def normalize_turns(turns: DataFrame, least: float = 0.5) -> DataFrame:
    """Merged speaker turns of at least ``least`` seconds, bounds rounded to hundredths."""
    merged = merge_labels(turns, label="speaker")
    return merged.where(F.col("t_end") - F.col("t_start") >= least).withColumns({"t_start": F.round("t_start", 2), "t_end": F.round("t_end", 2)})


def without_dominated(turns: DataFrame, share: float = 0.5, tie: str = "ord") -> DataFrame:
    """Turns that no strictly longer turn of another speaker covers by ``share`` or more; turns meet by time bucket."""
    short = turns.select("video_id", tie, "speaker", "t_start", "t_end")
    pairs = overlap_join(short, short)
    covered, length = F.least("l_t_end", "r_t_end") - F.greatest("l_t_start", "r_t_start"), F.col("l_t_end") - F.col("l_t_start")
    rule = (F.col("l_speaker") != F.col("r_speaker")) & (F.col("r_t_end") - F.col("r_t_start") > length) & (covered >= share * length)
    gone = pairs.where(rule).select(F.col("l_video_id").alias("video_id"), F.col(f"l_{tie}").alias(tie)).distinct()
    return turns.join(gone, ["video_id", tie], "left_anti").select(*turns.columns)


def candidate_windows(spans: DataFrame, pad: float = 15.0, longest: float = 150.0, tie: str = "ord") -> DataFrame:
    """Padded spans merged where they touch and split into pieces of at most ``longest`` seconds."""
    padded = spans.select("video_id", tie, F.greatest(F.lit(0.0), F.col("t_start") - pad).alias("t_start"), (F.col("t_end") + pad).alias("t_end"))
    rows = with_islands(padded, ["video_id"], [F.col("t_start"), F.col(tie)]).groupBy("video_id", "island").agg(F.min("t_start").alias("lo"), F.max("t_end").alias("hi"))
    piece = F.explode(F.expr(f"sequence(0, cast(greatest(ceil((hi - lo) / {longest}), 1) as int) - 1)"))
    return rows.withColumn("piece", piece).select("video_id", (F.col("lo") + F.col("piece") * longest).alias("t_start"), F.least("hi", F.col("lo") + (F.col("piece") + 1) * longest).alias("t_end"))


def sliding_windows(videos: DataFrame, most: int = 75, overlap: float = 0.5) -> DataFrame:
    """(video_id, w_start, w_end) of overlapping windows over ``n`` clips; the last ends at n."""
    stride = max(1, int(most * (1 - overlap)))
    return videos.where("n > 0").withColumn("k", F.explode(F.expr(f"sequence(0, cast(ceil(greatest(0, n - {most}) / {stride}) as int))"))).select("video_id", (F.col("k") * stride).cast("int").alias("w_start"), F.least(F.col("k") * stride + most, "n").cast("int").alias("w_end"))


def covering_windows(clips: DataFrame, most: int = 75, overlap: float = 0.5) -> DataFrame:
    """Clips (video_id, clip_idx, n: clips of the video), once for each of the ``sliding_windows`` that cover them, with its number k."""
    stride = max(1, int(most * (1 - overlap)))
    low = f"greatest(0, cast(ceil((clip_idx - {most} + 1) / {stride}) as long))"
    high = f"least(clip_idx div {stride}, cast(ceil(greatest(0, n - {most}) / {stride}) as long))"
    return clips.withColumn("k", F.explode(F.expr(f"sequence({low}, {high})")))


def max_pool(clips: DataFrame, windows: DataFrame, most: int = 75, overlap: float = 0.5) -> DataFrame:
    """Best score per clip of the windows (video_id, k, w_score) that cover it; clips without a finite one get the least finite score of the video, 0 if none.

    ``clips`` has video_id, clip_idx and n.
    """
    covered = covering_windows(clips.select("video_id", "clip_idx", "n"), most, overlap).join(windows, ["video_id", "k"], "left")
    best = covered.groupBy("video_id", "clip_idx").agg(F.max(F.when(F.abs("w_score") < float("inf"), F.col("w_score"))).alias("score"))
    return best.withColumn("score", F.coalesce("score", F.min("score").over(Window.partitionBy("video_id")), F.lit(0.0)))


def saliency_moments(clips: DataFrame, clip_seconds: float = 2.0, top_k: int = 8) -> DataFrame:
    """Runs of clips whose smoothed saliency reaches the video's mean, best ``top_k`` by their maximum.

    Smoothing is a mean of three with zeros beyond the ends; series of fewer than three clips stay as they are.
    """
    video = Window.partitionBy("video_id")
    line = video.orderBy("clip_idx")
    rows = clips.withColumn("n", F.count("*").over(video)).withColumn("s", F.when(F.col("score") == float("-inf"), 0.0).otherwise(F.col("score")))
    three = F.coalesce(F.lag("s").over(line), F.lit(0.0)) + F.col("s") + F.coalesce(F.lead("s").over(line), F.lit(0.0))
    rows = rows.withColumn("smooth", F.when(F.col("n") >= 3, three / 3.0).otherwise(F.col("s")))
    rows = rows.withColumn("high", F.round("smooth", 9) >= F.round(F.avg("smooth").over(video), 9)).where("high")
    runs = rows.withColumn("run", F.col("clip_idx") - F.row_number().over(line)).groupBy("video_id", "run").agg(F.min("clip_idx").alias("first"), F.max("clip_idx").alias("last"), F.max("smooth").alias("score"))
    ranked = runs.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.round("score", 9).desc(), "first"))).where(F.col("rank") <= top_k)
    return ranked.select("video_id", (F.col("first") * clip_seconds).alias("t_start"), ((F.col("last") + 1) * clip_seconds).alias("t_end"), "score", "rank")


def broadcast_scores(clips: DataFrame, moments: DataFrame, clip_seconds: float = 2.0) -> DataFrame:
    """Each clip with the best score of the moments of its video that overlap it, else 0."""
    c = clips.select("video_id", "clip_idx", (F.col("clip_idx") * clip_seconds).alias("c0"), ((F.col("clip_idx") + 1) * clip_seconds).alias("c1"))
    m = moments.select("video_id", "t_start", "t_end", "score")
    return c.join(m, (c["video_id"] == m["video_id"]) & (m["t_start"] < c["c1"]) & (m["t_end"] > c["c0"]), "left").groupBy(c["video_id"], c["clip_idx"]).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def fixed_grid(videos: DataFrame, least: float = 7.0, most_segments: int = 50) -> DataFrame:
    """Segments of max(``least``, duration / ``most_segments``) seconds; the last is cut at the end."""
    v = videos.where("duration > 0").withColumn("len", F.greatest(F.lit(least), F.col("duration") / most_segments))
    v = v.withColumn("k", F.explode(F.expr("sequence(0, cast(ceil(round(duration / len, 9)) as int) - 1)")))
    return v.select("video_id", F.col("k").alias("segment_idx"), (F.col("k") * F.col("len")).alias("t_start"), F.least("duration", (F.col("k") + 1) * F.col("len")).alias("t_end"))


def beside(points: DataFrame, marks: DataFrame, at: str, payload: list[str]) -> DataFrame:
    """``points`` with structs _before and _after: the last mark of the video at or before ``at`` and the first at or after it (null: none).

    Points and marks (both with video_id and ``at``; marks also ``payload``) are dealt by video once and sorted along the line in both directions.
    """
    own = points.withColumn("_mark", F.lit(None).cast(marks.select(F.struct(at, *payload)).schema[0].dataType))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name not in ("video_id", at)]
    both = own.unionByName(marks.select("video_id", at, *blank, F.struct(at, *payload).alias("_mark")))
    line = lambda way: Window.partitionBy("video_id").orderBy(way(at), F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_before", F.last("_mark", True).over(line(F.asc))).withColumn("_after", F.last("_mark", True).over(line(F.desc)))
    return rows.where(F.col("_mark").isNull()).drop("_mark")


def nearest_within(points: DataFrame, cuts: DataFrame, tolerance: float) -> DataFrame:
    """``points`` (video_id, t) with snapped: the nearest cut within ``tolerance`` (ties: the earlier), else t itself."""
    rows = beside(points, cuts.where("cut is not null").select("video_id", F.col("cut").cast("double").alias("t")).distinct(), "t", [])
    low, high = F.col("t") - F.col("_before.t"), F.col("_after.t") - F.col("t")
    near = F.when(low.isNotNull() & (high.isNull() | (low <= high)), F.when(low <= tolerance, F.col("_before.t"))).otherwise(F.when(high <= tolerance, F.col("_after.t")))
    return rows.withColumn("snapped", F.coalesce(near, "t")).drop("_before", "_after")


def _grid_with_cuts(videos: DataFrame, cuts: DataFrame, tolerance: float, shortest: float, most_segments: int) -> DataFrame:
    """A row per video: duration, len, inner (the number of inner boundaries) and moved, a map from a boundary's number to the nearest cut within ``tolerance`` (ties: the earlier; null: no cuts).

    A cut is offered to the boundaries it is near to, so a video's grid, ``most_segments`` at most, is one row, and only cuts and videos are dealt out.
    """
    v = videos.where("duration > 0").withColumn("len", F.greatest(F.lit(shortest), F.col("duration") / most_segments))
    v = v.select("video_id", F.col("duration").cast("double").alias("duration"), "len", F.expr("cast(ceil(round(duration / len, 9)) as int) - 1").alias("inner"))
    c = cuts.where("cut is not null").select("video_id", F.col("cut").cast("double").alias("cut")).join(v.where("inner > 0"), "video_id")
    c = c.withColumn("low", F.expr(f"cast(greatest(1, ceil((cut - {tolerance}) / len) - 1) as int)")).withColumn("high", F.expr(f"cast(least(inner, floor((cut + {tolerance}) / len) + 1) as int)"))
    c = c.where("low <= high").withColumn("k", F.explode(F.sequence("low", "high"))).withColumn("away", F.abs(F.col("k") * F.col("len") - F.col("cut"))).where(F.col("away") <= tolerance)
    best = c.groupBy("video_id", "k").agg(F.min(F.struct("away", "cut"))["cut"].alias("cut"))
    moved = best.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "cut"))).alias("moved"))
    return v.join(moved, "video_id", "left")


def nearest_in_grid(videos: DataFrame, cuts: DataFrame, tolerance: float, shortest: float = 7.0, most_segments: int = 50) -> DataFrame:
    """(video_id, t, snapped): the inner boundaries of the fixed grid with the nearest cut within ``tolerance`` (ties: the earlier), else t itself."""
    rows = _grid_with_cuts(videos, cuts, tolerance, shortest, most_segments).where("inner > 0").withColumn("k", F.explode(F.expr("sequence(1, inner)")))
    return rows.select("video_id", F.expr("k * len").alias("t"), F.expr("coalesce(moved[k], k * len)").alias("snapped"))


def snap_grid(videos: DataFrame, cuts: DataFrame, tolerance: float = 2.0, least: float = 1.0, shortest: float = 7.0, most_segments: int = 50) -> DataFrame:
    """The fixed grid with inner boundaries moved to near cuts; a boundary must lie ``least`` after the one kept before.

    A video's boundaries are gone through in its row.
    """
    rows = _grid_with_cuts(videos, cuts, tolerance, shortest, most_segments)
    line = "filter(transform(if(inner > 0, sequence(1, inner), cast(array() as array<int>)), k -> coalesce(moved[k], k * len)), t -> t < duration)"
    if shortest - 2 * tolerance > least:  # neighbours stay in order and far enough apart wherever they move
        kept = f"concat(array(0D), {line})"
    else:
        kept = f"aggregate(array_sort({line}), cast(array(0D) as array<double>), (kept, t) -> if(t > element_at(kept, -1) + {least}, array_append(kept, t), kept))"
    rows = rows.select("video_id", "duration", F.expr(kept).alias("kept"))
    rows = rows.select("video_id", "kept", "duration", F.posexplode("kept").alias("segment_idx", "t_start"))
    return rows.select("video_id", "segment_idx", "t_start", F.expr("coalesce(get(kept, segment_idx + 1), duration)").alias("t_end"))


def pack_chunks(spans: DataFrame, seconds: float = 60.0, tie: str = "ord", chunks: int | None = None) -> DataFrame:
    """Spans with chunk: greedy packing; a new chunk opens when a span would end more than ``seconds`` after its chunk began.

    ``chunks`` bounds the chunks of a video; spans of later ones are left out then.
    """
    return fold(spans, ["video_id"], ["t_start", tie], [tie, "t_start", "t_end"], lambda video: Packing(video, seconds, chunks), f"video_id long, {tie} long, t_start double, t_end double, chunk long")


def split_long_shots(shots: DataFrame, words: DataFrame, longest: float = 10.0, least: float = 0.75, pause: float = 0.4) -> DataFrame:
    """(video_id, shot_idx, piece, t_start, t_end): shots above ``longest`` cut where a sentence ends or a pause follows.

    ``words`` has video_id, shot_idx, word, w_start and w_end, those that begin inside the shot. Shots without a usable place are cut evenly.
    """
    line = Window.partitionBy("video_id", "shot_idx").orderBy("w_start", "w_end")
    ends = F.coalesce(F.trim("word").rlike("[.!?]$"), F.lit(False)) | F.coalesce(F.lead("w_start").over(line) - F.col("w_end") >= pause, F.lit(False))
    at = words.where("w_start is not null").withColumn("ends", ends).where("ends").select("video_id", "shot_idx", F.col("w_end").alias("at"))
    rows = shots.select("video_id", "shot_idx", "t_start", "t_end").join(at, ["video_id", "shot_idx"], "left")
    return fold(rows, ["video_id", "shot_idx", "t_start", "t_end"], ["at"], ["at"], lambda v, k, a, b: Splits(v, k, a, b, longest, least), "video_id long, shot_idx long, piece int, t_start double, t_end double")


def merge_roles(chunks: DataFrame, role: str = "role", tie: str = "ord") -> DataFrame:
    """Neighbouring chunks of the same role as one segment, whatever the gap; a null role never merges."""
    order = [F.col("t_start"), F.col(tie)]
    before = F.lag(role).over(Window.partitionBy("video_id").orderBy(*order))
    rows = chunks.withColumn("island", island(["video_id"], order, before.isNull() | F.col(role).isNull() | (before != F.col(role))))
    return rows.groupBy("video_id", role, "island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("n_chunks")).drop("island")


def postprocess_shots(shots: DataFrame, longest: float = 10.0, least: float = 0.75, tie: str = "ord") -> DataFrame:
    """Shots above ``longest`` cut into equal pieces; pieces under ``least`` join the one before."""
    n = f"cast(greatest(ceil(round((t_end - t_start) / {longest}, 9)), 1) as int)"
    pieces = shots.withColumn("n", F.expr(n)).withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    step = (F.col("t_end") - F.col("t_start")) / F.col("n")
    pieces = pieces.select("video_id", tie, "k", (F.col("t_start") + F.col("k") * step).alias("p0"), F.when(F.col("k") == F.col("n") - 1, F.col("t_end")).otherwise(F.col("t_start") + (F.col("k") + 1) * step).alias("p1"))
    order = [F.col("p0"), F.col(tie), F.col("k")]
    first = F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) == 1
    rows = pieces.withColumn("island", island(["video_id"], order, first | (F.round(F.col("p1") - F.col("p0"), 9) >= least)))
    return rows.groupBy("video_id", "island").agg(F.min("p0").alias("t_start"), F.max("p1").alias("t_end"), F.count("*").alias("n_pieces")).drop("island")


def in_window(spans: DataFrame, start: float | None = None, end: float | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Spans with both bounds that overlap [start, end) and last between ``least`` and ``most``."""
    rule, length = F.col("t_start").isNotNull() & F.col("t_end").isNotNull(), F.col("t_end") - F.col("t_start")
    for value, holds in ((start, F.col("t_end") > F.lit(start)), (end, F.col("t_start") < F.lit(end)), (least, length >= F.lit(least)), (most, length <= F.lit(most))):
        if value is not None:
            rule &= holds
    return spans.where(rule)


def in_any_range(spans: DataFrame, ranges: str) -> DataFrame:
    """Spans that overlap any range of a text like ``"0-10,30-45"``; malformed ranges are skipped, without a valid one all stay."""
    parsed = []
    for part in ranges.split(","):
        a, _, b = part.strip().partition("-")
        try:
            low, high = float(a), float(b)
        except ValueError:
            continue
        if high > low:
            parsed.append((low, high))
    if not parsed:
        return spans
    rule = F.lit(False)
    for low, high in parsed:
        rule |= (F.col("t_start") < high) & (F.col("t_end") > low)
    return spans.where(rule)


def temporal_nms(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy suppression inside each ``group``: best score first, then the shorter span, then ``ord``.

    A candidate overlapping a kept one by ``threshold`` (intersection over hull) goes; its family is noted in the
    also_matched of the first such, unless it is that one's own. Spans that do not touch cannot suppress each other, so
    each island of a group is a fold of its own.
    """
    rows = candidates.select("group", "ord", "t_start", "t_end", "score", "family")
    rows = with_islands(rows, ["group"], [F.col("t_start"), F.col("ord")]).withColumn("length", F.col("t_end") - F.col("t_start"))
    schema = "group string, t_start double, t_end double, score double, family string, ord long, also_matched array<string>"
    kept = fold(rows, ["group", "island"], [F.desc("score"), "length", "ord"], ["t_start", "t_end", "score", "family", "ord"], lambda group, island: Suppression(group, island, threshold), schema)
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.col("t_end") - F.col("t_start"), "ord")
    return kept.withColumn("rank", F.row_number().over(order) - 1)


#: Seconds of a cell of the lowest level, and how many cells of a level make one of the next.
UNIT, FACTOR = 4.0, 4


def with_cells(df: DataFrame, p: str, levels: DataFrame) -> DataFrame:
    """One row per cell of a span: those it covers at the level whose cells are just as long as it is (its own), and at each level above that is in use."""
    size = f"({UNIT} * pow({FACTOR}, v))"
    cells = f"transform(sequence(cast(floor({p}_t_start / {size}) as long), cast(floor(greatest({p}_t_start, {p}_t_end) / {size}) as long)), c -> struct(v as level, c as cell, v = {p}_level as {p}_own))"
    rows = df.crossJoin(F.broadcast(levels)).withColumn("_c", F.explode(F.expr(f"flatten(transform(filter(levels, v -> v >= {p}_level), v -> {cells}))")))
    return rows.select(*df.columns, "_c.*")


def _level(p: str) -> Column:
    return F.expr(f"cast(greatest(0, ceil(log({FACTOR}, greatest({p}t_end - {p}t_start, {UNIT}) / {UNIT}))) as int)")


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a left span (l_*) and a right span (r_*) of one video that overlap, open at the ends.

    Spans lie in cells of levels: a span has two cells at most at the level of its length, and two at each higher level that any span has. A pair meets at the level of the longer one,
    in the cell where the later of the two begins; so short spans meet those close to them and a span of years costs a few rows.
    """
    bounds = [df.select(_level("").alias("v")) for df in (left, right)]
    levels = bounds[0].unionByName(bounds[1]).agg(F.array_sort(F.collect_set("v")).alias("levels"))  # one row
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)).withColumn(f"{p}_level", _level(f"{p}_"))
    x = with_cells(named(left, "l"), "l", levels)
    y = with_cells(named(right, "r"), "r", levels).withColumnsRenamed({"level": "_level", "cell": "_cell"})
    begin = F.floor(F.greatest("l_t_start", "r_t_start") / (F.lit(UNIT) * F.pow(F.lit(FACTOR), F.col("level")))).cast("long")
    meet = (F.col("l_video_id") == F.col("r_video_id")) & (F.col("level") == F.col("_level")) & (F.col("cell") == F.col("_cell"))
    pairs = x.join(y, meet & (F.col("l_own") | F.col("r_own")) & (F.col("l_t_start") < F.col("r_t_end")) & (F.col("l_t_end") > F.col("r_t_start")) & (F.col("cell") == begin))
    return pairs.drop("level", "cell", "_level", "_cell", "l_own", "r_own", "l_level", "r_level")


def overlap_texts(events: DataFrame, segments: DataFrame, longest: int = 1000) -> DataFrame:
    """Each event with the texts of the segments it overlaps, in order, joined by ' | ' and cut at ``longest``."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_t_start", "r_idx", "r_text"))), lambda x: x["r_text"]), " | ")
    return overlap_join(events, segments).groupBy("l_video_id", "l_ord").agg(F.substring(said, 1, longest).alias("text"), F.count("*").alias("n_segments")).select(F.col("l_video_id").alias("video_id"), F.col("l_ord").alias("ord"), "text", "n_segments")


def assign_by_overlap(shots: DataFrame, turns: DataFrame) -> DataFrame:
    """Each shot with the one turn that overlaps it longest (ties: the first turn)."""
    pairs = overlap_join(shots, turns).withColumn("overlap", F.least("l_t_end", "r_t_end") - F.greatest("l_t_start", "r_t_start"))
    return pairs.groupBy(F.col("l_video_id").alias("video_id"), F.col("l_shot_idx").alias("shot_idx")).agg(F.min_by(F.struct("r_turn_idx", "overlap"), F.struct(-F.round("overlap", 9), F.col("r_turn_idx"))).alias("b")).select("video_id", "shot_idx", F.col("b.r_turn_idx").alias("turn_idx"), F.col("b.overlap").alias("overlap"))


def nearest_midpoint(cites: DataFrame, segments: DataFrame) -> DataFrame:
    """Each citation (video_id, ord, mid) with the segment (idx, s_mid) of its video whose middle is nearest (ties: the first), -1 if the video has none."""
    marks = segments.where("s_mid is not null").groupBy("video_id", F.col("s_mid").cast("double").alias("mid")).agg(F.min("idx").alias("idx"))
    rows = beside(cites, marks, "mid", ["idx"])
    low, high = (F.round(F.abs(F.col(f"{side}.mid") - F.col("mid")), 9) for side in ("_before", "_after"))
    nearer = F.when(low.isNull(), F.col("_after.idx")).when(high.isNull(), F.col("_before.idx")).when(low == high, F.least("_before.idx", "_after.idx")).when(low < high, F.col("_before.idx")).otherwise(F.col("_after.idx"))
    return rows.select("video_id", "ord", F.coalesce(nearer, F.lit(-1)).alias("segment_idx"))


def split_where_unlike(shots: DataFrame, least: float = 0.78) -> DataFrame:
    """Shots with group: a new one where the cosine with the shot before is under ``least``; no vector counts as 0."""
    order = [F.col("shot_idx")]
    before = F.lag("vector").over(Window.partitionBy("video_id").orderBy(*order))
    from .vectors import cosine

    rows = shots.withColumn("_before", before).withColumn("_cos", F.when(F.col("_before").isNotNull(), cosine("_before", "vector")).otherwise(0.0))
    first = F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) == 1
    return rows.withColumn("group", island(["video_id"], order, ~first & (F.round("_cos", 9) < least))).drop("_before", "_cos")


def rolling_order_ok(steps: DataFrame) -> DataFrame:
    """Per sequence whether all steps were found and their times do not decrease; steps are (seq, ord, found, t_start)."""
    late = F.lag("t_start").over(Window.partitionBy("seq").orderBy("ord"))
    return steps.withColumn("fine", F.coalesce(F.col("found"), F.lit(False)) & F.coalesce(late <= F.col("t_start"), late.isNull())).groupBy("seq").agg(F.every("fine").alias("in_order"), F.count("*").alias("n_steps"))
