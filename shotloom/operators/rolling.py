"""Order statistics along a series that streams through a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Medians:
    """Medians of the ``points`` values around each value of a series that comes in pieces, edges repeated; of the whole series if it has fewer.

    Holds as many values as a window has, besides the piece at hand.
    """

    def __init__(self, points: int):
        self.points, self.left, self.n, self.held = points, points // 2, 0, np.zeros(0)

    def _windows(self) -> np.ndarray:
        if len(self.held) < self.points or self.n < self.points:
            return np.zeros(0)
        w = np.sort(np.lib.stride_tricks.sliding_window_view(self.held, self.points), axis=1)
        self.held = self.held[len(w) :]
        return (w[:, (self.points - 1) // 2] + w[:, self.points // 2]) / 2

    def push(self, values: np.ndarray) -> np.ndarray:
        """The medians that are certain now, in order, from where the last call ended."""
        if not len(values):
            return np.zeros(0)
        edge = np.repeat(values[:1], 0 if self.n else self.left)
        self.n += len(values)
        self.held = np.concatenate((self.held, edge, values))
        return self._windows()

    def close(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0)
        if self.n < self.points:
            s = np.sort(self.held[self.left :])
            return np.full(self.n, (s[(self.n - 1) // 2] + s[self.n // 2]) / 2)
        self.held = np.concatenate((self.held, np.repeat(self.held[-1:], self.points - 1 - self.left)))
        return self._windows()


class Spread:
    """For each (place, value): the rolling median of the values and that of the distances from it."""

    def __init__(self, points: int):
        self.floors, self.offs = Medians(points), Medians(points)
        self.rows = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # place, value, floor (as far as known)

    def _take(self, floors: np.ndarray, last: bool) -> list[np.ndarray]:
        at, value, known = self.rows
        known = np.concatenate((known, floors))
        off = np.abs(value[len(known) - len(floors) : len(known)] - floors)
        mads = self.offs.push(off)
        if last:
            mads = np.concatenate((mads, self.offs.close()))
        n = len(mads)
        self.rows = [at[n:], value[n:], known[n:]]
        return [at[:n], value[:n], known[:n], mads]

    def push(self, at: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        self.rows = [np.concatenate((self.rows[0], at)), np.concatenate((self.rows[1], value)), self.rows[2]]
        return self._take(self.floors.push(value), False)

    def close(self) -> list[np.ndarray]:
        return self._take(self.floors.close(), True)


class Line:
    """For each (place, value): the rolling median."""

    def __init__(self, points: int):
        self.medians, self.rows = Medians(points), [np.zeros(0, np.int64), np.zeros(0)]

    def _take(self, medians: np.ndarray) -> list[np.ndarray]:
        n = len(medians)
        out, self.rows = [x[:n] for x in self.rows], [x[n:] for x in self.rows]
        return [*out, medians]

    def push(self, at: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        self.rows = [np.concatenate(x) for x in zip(self.rows, (at, value), strict=True)]
        return self._take(self.medians.push(value))

    def close(self) -> list[np.ndarray]:
        return self._take(self.medians.close())


def _streamed(series: DataFrame, value: str, start: Callable[[], Line | Spread], names: list[str]) -> DataFrame:
    """What ``start()`` makes of each video's places (clip_idx) and values in order, under ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        out: list[tuple[int, list[np.ndarray]]] = []

        def packed() -> pa.RecordBatch:
            videos = np.repeat(np.array([v for v, _ in out], np.int64), [len(p[0]) for _, p in out])
            return pa.RecordBatch.from_arrays([pa.array(videos), *(pa.array(np.concatenate([p[i] for _, p in out])) for i in range(len(names)))], names=["video_id", *names])

        for batch in batches:
            who, at, x = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero(who[1:] != who[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(who)], strict=True):
                if a == b:
                    continue
                if state is None or who[a] != video:
                    if state is not None:
                        out.append((video, state.close()))
                    video, state = int(who[a]), start()
                out.append((video, state.push(at[a:b], x[a:b])))
            if out:
                yield packed()
                out.clear()
        if state is not None:
            out.append((video, state.close()))
            yield packed()

    rows = series.where(F.col(value).isNotNull() & F.col("video_id").isNotNull()).select(F.col("video_id").cast("long").alias("video_id"), F.col("clip_idx").cast("long").alias("clip_idx"), F.col(value).cast("double").alias("x"))
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "clip_idx")
    return rows.mapInArrow(run, ", ".join(["video_id long", f"`{names[0]}` long", *(f"`{n}` double" for n in names[1:])]))


def rolling_spread(series: DataFrame, points: int) -> DataFrame:
    """(video_id, clip_idx, score, floor, mad) of ``series`` (video_id, clip_idx, score), sorted within each video: the median of ``points`` scores around each and of the distances from those medians.

    Rows without a score go. A series of any length streams through one task.
    """
    return _streamed(series, "score", lambda: Spread(points), ["clip_idx", "score", "floor", "mad"])


def rolling_median(rows: DataFrame, value: str, name: str, points: int) -> DataFrame:
    """(video_id, clip_idx, ``value``, ``name``): the median of ``points`` values around each, edges repeated; of the whole series if it has fewer than ``points`` or those are fewer than three. Rows without a value go."""
    if points < 3:
        whole = F.percentile(value, F.lit(0.5)).over(Window.partitionBy("video_id"))
        return rows.where(F.col(value).isNotNull()).select("video_id", "clip_idx", F.col(value).cast("double").alias(value), whole.alias(name))
    return _streamed(rows, value, lambda: Line(points), ["clip_idx", value, name])
