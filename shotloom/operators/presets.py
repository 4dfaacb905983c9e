"""Named ways to cut a video into segments, and fields that a user defines for them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import intervals, spans, timeline
from .isolation import isolated

MOST_DEFINITIONS = 10


def topic_changes(shots: DataFrame) -> DataFrame:
    rows = intervals.split_where_unlike(shots).withColumnRenamed("group", "segment_idx")
    return spans.described_groups(rows, ["video_id", "segment_idx"]).select("video_id", "segment_idx", "t_start", "t_end", F.col("title").alias("label"))


def plays(shots: DataFrame) -> DataFrame:
    return timeline.sports_plays(shots).select("video_id", F.col("shot_idx").alias("segment_idx"), "t_start", "t_end", F.col("event").alias("label"))


def packed(shots: DataFrame) -> DataFrame:
    """Chunks of a minute, at most 32; the way for whatever has no name of its own."""
    chunks = intervals.pack_chunks(shots.select("video_id", F.col("shot_idx").alias("ord"), "t_start", "t_end"), 60.0, chunks=32)
    return chunks.groupBy("video_id", F.col("chunk").alias("segment_idx")).agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.lit(None).cast("string").alias("label"))


def shot_by_shot(shots: DataFrame) -> DataFrame:
    return shots.select("video_id", F.col("shot_idx").alias("segment_idx"), "t_start", "t_end", F.trim(F.coalesce("chunk_caption", F.lit(""))).alias("label"))


def shown_texts(shots: DataFrame) -> DataFrame:
    """Shots in which text is read."""
    text = F.trim(F.coalesce("ocr_text", F.lit("")))
    return shots.where(text != "").select("video_id", F.col("shot_idx").alias("segment_idx"), "t_start", "t_end", text.alias("label"))


def spoken_turns(turns: DataFrame) -> DataFrame:
    """Speaker turns, merged, without those that a longer one covers, numbered in time."""
    clean = intervals.normalize_turns(intervals.without_dominated(intervals.normalize_turns(turns)))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t_start", "ord")) - 1
    return clean.select("video_id", n.alias("segment_idx"), "t_start", "t_end", F.col("speaker").alias("label"))


def editorial(shots: DataFrame) -> DataFrame:
    """Chunks of a minute and a half, at most 24, under the first role (``role``) that one of their shots has; neighbours of one role are one."""
    chunks = intervals.pack_chunks(shots.select("video_id", F.col("shot_idx").alias("ord"), "t_start", "t_end"), 90.0, chunks=24)
    roles = shots.select("video_id", F.col("shot_idx").alias("ord"), "role")
    rows = chunks.join(roles, ["video_id", "ord"]).groupBy("video_id", "chunk")
    rows = rows.agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("t_start", "ord"))).alias("role"))
    merged = intervals.merge_roles(rows, "role", "chunk")
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t_start")) - 1
    return merged.select("video_id", n.alias("segment_idx"), "t_start", "t_end", F.col("role").alias("label"))


def persons(shots: DataFrame) -> DataFrame:
    """Runs of shots with the same main person (``person``); a shot without one ends the run."""
    order = [F.col("t_start"), F.col("shot_idx")]
    before = F.lag("person").over(Window.partitionBy("video_id").orderBy(*order))
    rows = shots.withColumn("_run", intervals.island(["video_id"], order, ~F.col("person").eqNullSafe(before))).where("person is not null")
    rows = rows.groupBy("video_id", "_run", "person").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("_run")) - 1
    return rows.select("video_id", n.alias("segment_idx"), "t_start", "t_end", F.col("person").alias("label"))


#: Ways by name: shots (video_id, shot_idx, t_start, t_end, vector, chunk_caption, asr_text, ocr_text, tags, role, person, as the way needs) -> segments.
SEGMENTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "topic_changes": topic_changes, "sports_highlights": plays, "write_my_own": packed, "shot_detection": shot_by_shot, "ocr": shown_texts, "editorial_segment": editorial, "person_of_focus": persons,
}
SEGMENTS = "definition string, video_id long, segment_idx long, t_start double, t_end double, label string"


def _ways(shots: DataFrame, definitions: list[dict], turns: DataFrame | None) -> dict[str, Callable[[], DataFrame]]:
    if not 1 <= len(definitions) <= MOST_DEFINITIONS:
        raise ValueError(f"1 to {MOST_DEFINITIONS} definitions")

    def one(d: dict, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
        part = spoken_turns(turns) if d["id"] == "speaker_diarization" and turns is not None else fn(shots)
        part = intervals.in_any_range(part, d["ranges"]) if d.get("ranges") else part
        return part.select(F.lit(d["id"]).alias("definition"), "video_id", F.col("segment_idx").cast("long").alias("segment_idx"), "t_start", "t_end", "label")

    none = lambda df: packed(df).where("false")
    return {d["id"]: lambda d=d: one(d, SEGMENTERS.get(d["id"], none if d["id"] == "speaker_diarization" else packed)) for d in definitions}


def segments(shots: DataFrame, definitions: list[dict], turns: DataFrame | None = None) -> DataFrame:
    """Segments by each definition (id and, as you like, ranges like "0-10,30-45"), marked with its id; an id without a way of its own is packed.

    "speaker_diarization" takes ``turns`` (video_id, ord, speaker, t_start, t_end, score), without them it gives nothing.
    """
    return reduce(DataFrame.unionByName, (way() for way in _ways(shots, definitions, turns).values()))


def segments_isolated(shots: DataFrame, definitions: list[dict], turns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``segments`` where a way that fails gives packed segments instead, and the status of each definition (see ``isolated``)."""
    ways = _ways(shots, definitions, turns)
    plain = {d["id"]: lambda d=d: packed(shots).select(F.lit(d["id"]).alias("definition"), "video_id", F.col("segment_idx").cast("long").alias("segment_idx"), "t_start", "t_end", "label") for d in definitions}
    rows, status = isolated(shots.sparkSession, ways, SEGMENTS, plain)
    return rows.drop("kind"), status


def with_fields(rows: DataFrame, raw: str, fields: list[dict]) -> DataFrame:
    """Rows with ``metadata``: the fields (name, type, enum) that the map of texts ``raw`` has and that fit their type and list; the others are left out."""
    pairs = [F.struct(F.lit(f["name"]).alias("key"), T.coerced(F.element_at(raw, f["name"]), f.get("type", "string"), tuple(f.get("enum", ()))).cast("string").alias("value")) for f in fields]
    return rows.withColumn("metadata", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())))
