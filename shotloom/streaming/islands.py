"""Contiguous clips of a stream: spans that come in any order within a bound, joined as soon as nothing can join them any more."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROW = "t_start double, t_end double, score double, shot_idx long, asr_text string"
CLIP = "video_id long, t_start double, t_end double, score double, shot_idx long, asr_text string, n_shots long"


def islands(rows: list[tuple], gap: float) -> list[list[tuple]]:
    """Rows (t_start, t_end, score, shot_idx, asr_text) in the order of time, cut where one starts more than ``gap`` after all ends before."""
    out: list[list[tuple]] = []
    reach = -math.inf
    for row in sorted(rows, key=lambda r: (r[0], r[3])):
        if not out or row[0] > reach + gap:
            out.append([])
        out[-1].append(row)
        reach = max(reach, row[1])
    return out


def clip(video_id: int, rows: list[tuple]) -> tuple:
    """One clip of an island's rows: bounds, best score, the first shot that has it, texts that are not blank, number of shots."""
    best = min(rows, key=lambda r: (-r[2], r[0], r[3]))
    said = " ".join(r[4] for r in rows if r[4] and r[4].strip(" "))
    return video_id, rows[0][0], max(r[1] for r in rows), best[2], best[3], said, len(rows)


class Islands(StatefulProcessor):
    """Holds the rows of a video's open islands; each goes out when the watermark has passed the last time at which a row could still join it."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROW)

    def _due(self, island: list[tuple]) -> int:
        return math.floor((max(r[1] for r in island) + self.gap) * 1000) + 1

    def _set_timers(self, parts: list[list[tuple]]) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        for at in {self._due(p) for p in parts}:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(r.t_start, r.t_end, r.score, int(r.shot_idx), r.asr_text) for frame in rows for r in frame.itertuples(index=False)]
        self.rows.appendList(new)
        self._set_timers(islands([tuple(r) for r in self.rows.get()], self.gap))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = islands([tuple(r) for r in self.rows.get()], self.gap)
        done = [p for p in parts if self._due(p) <= now]
        left = [r for p in parts if self._due(p) > now for r in p]
        if left:
            self.rows.put(left)
        else:
            self.rows.clear()
        if done:
            yield pd.DataFrame([clip(key[0], p) for p in done], columns=[c.split()[0] for c in CLIP.split(", ")])

    def close(self) -> None:
        pass


def merged_stream(spans: DataFrame, gap: float = 1.0, late: str = "60 seconds") -> DataFrame:
    """Clips of a stream of spans (video_id, shot_idx, t_start, t_end, score, asr_text), times in seconds since 1970; for the output mode "append".

    The rows are those of ``merge_contiguous`` over all spans in time. A span is late, and left out, if it starts more than ``late`` before the latest start that
    an earlier batch had. Spans without video or bounds are left out; a null score counts as the lowest. The last islands stay open until later spans come. Needs the RocksDB state store.
    """
    rows = spans.where("video_id is not null and t_start is not null and t_end is not null").withColumn("at", F.timestamp_millis(F.floor(F.col("t_start") * 1000)))
    rows = rows.withWatermark("at", late).select("video_id", "at", "t_start", "t_end", F.coalesce("score", F.lit(float("-inf"))).alias("score"), "shot_idx", F.coalesce("asr_text", F.lit("")).alias("asr_text"))
    return rows.groupBy("video_id").transformWithStateInPandas(Islands(gap), CLIP, "append", "eventTime")
