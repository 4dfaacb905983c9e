"""What a probe says of media files: which kind they are, and which frames to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FALLBACK_SECONDS = 300.0


def with_modality(probes: DataFrame) -> DataFrame:
    """Probed files (video_id, probed, codecs: array of the streams' types, duration: text) with modality, has_video, has_audio and duration_s.

    A file whose probe failed (probed false or null) counts as one with both and no duration; one without any stream as audio, so that speech is looked for. A duration that is
    no number is 0.
    """
    failed = ~F.coalesce("probed", F.lit(False))
    streams = F.coalesce("codecs", F.array().cast("array<string>"))
    seen, heard = failed | F.array_contains(streams, "video"), failed | F.array_contains(streams, "audio")
    label = F.when(seen & heard, "video_audio").when(seen, "video_only").otherwise("audio_only")
    seconds = F.when(failed, 0.0).otherwise(F.coalesce(F.expr("try_cast(duration as double)"), F.lit(0.0)))
    return probes.withColumns({"modality": label, "has_video": seen, "has_audio": heard, "duration_s": seconds})


def seconds_of(frames: str, fps: str) -> Column:
    """Length of a file by its frames and their rate; five minutes where the rate is unknown."""
    return F.coalesce(F.when(F.col(fps) > 0, F.col(frames) / F.col(fps)), F.lit(FALLBACK_SECONDS))


def frame_numbers(clips: DataFrame, most: int = 8) -> DataFrame:
    """Clips (start_s, end_s, fps, n_frames) with ``frames``: at most ``most`` frame numbers, evenly from the first to the last; of the whole file where the clip has none."""
    rows = clips.withColumn("_a", F.expr("cast(start_s * fps as long)")).withColumn("_b", F.expr("least(cast(end_s * fps as long), n_frames)"))
    none = F.col("_b") - F.col("_a") <= 0
    rows = rows.withColumns({"_a": F.when(none, 0).otherwise(F.col("_a")), "_b": F.when(none, F.col("n_frames")).otherwise(F.col("_b"))})
    n = f"least({most}L, _b - _a)"
    even = f"case when {n} < 1 then cast(array() as array<long>) when {n} = 1 then array(_a) else transform(sequence(0L, {n} - 1), k -> if(k = {n} - 1, _b - 1, cast(floor(k * ((_b - 1 - _a) / cast({n} - 1 as double)) + _a) as long))) end"
    return rows.withColumn("frames", F.expr(even)).drop("_a", "_b")
