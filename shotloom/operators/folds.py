"""Order-dependent folds: sorted groups stream through a task, which holds the state of one group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, by: list[str], order: list, columns: list[str], start: Callable, schema: str) -> DataFrame:
    """The rows (``schema``) that a fold gives out for each group of ``by``, whose rows come sorted by ``order``.

    ``start(*key)`` begins a group: an object with add(*values of ``columns``) and end(), each of which gives
    out an iterable of rows. A group of any length passes through one task without being held.
    """
    rows = df.repartition(*by).sortWithinPartitions(*by, *order).select(*by, *columns)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    n = len(by)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[:n] != key:
                    if state is not None:
                        out += state.end()
                    key, state = row[:n], start(*row[:n])
                out += state.add(*row[n:])
            if out:
                yield pack(out)
                out = []
        if state is not None:
            out += state.end()
        if out:
            yield pack(out)

    return rows.mapInArrow(run, schema)


class Packing:
    """Greedy packing: a chunk closes when a span would end more than ``seconds`` after its begin; chunks past ``chunks`` are left out."""

    def __init__(self, video, seconds: float, chunks: int | None = None):
        self.video, self.seconds, self.chunks = video, seconds, chunks
        self.chunk, self.begin = -1, None

    def add(self, tie, a, b):
        if self.begin is None or b - self.begin > self.seconds:
            self.chunk, self.begin = self.chunk + 1, a
        return [(self.video, tie, a, b, self.chunk)] if self.chunks is None or self.chunk < self.chunks else []

    def end(self):
        return []


class Suppression:
    """Greedy suppression of the spans of an island, best first; a suppressed one's family is noted at the first that covers it."""

    def __init__(self, group, island, threshold: float):
        self.group, self.threshold, self.kept = group, threshold, []

    def add(self, a, b, score, family, tie):
        for k in self.kept:
            hull = max(b, k[2]) - min(a, k[1])
            if hull > 0 and (min(b, k[2]) - max(a, k[1])) / hull >= self.threshold:
                if family != k[4] and family not in k[6]:
                    k[6].append(family)
                return []
        self.kept.append([self.group, a, b, score, family, tie, []])
        return []

    def end(self):
        return [tuple(k) for k in self.kept]


class Apart:
    """Peaks at least ``gap`` seconds apart; of two closer ones the higher stays."""

    def __init__(self, video, gap: float):
        self.video, self.gap, self.last = video, gap, None

    def add(self, clip, t, value, z):
        if self.last is None or t - self.last[1] >= self.gap:
            out = self.end()
            self.last = (clip, t, value, z)
            return out
        if value > self.last[2]:
            self.last = (clip, t, value, z)
        return []

    def end(self):
        return [(self.video, self.last[0], self.last[3])] if self.last else []


class Splits:
    """Cuts of a long shot where a sentence or a pause ends, decided while the places come in order.

    A piece should end in its second half, counted by ``longest``, at the latest place there; failing that at the latest place within one and a half; failing that at ``longest``. Only the latest
    place of either kind since the last cut is held. Places nearer than ``least`` to the shot's ends don't count; a shot without any is cut evenly.
    """

    def __init__(self, video, shot, begin, end_, longest: float, least: float):
        self.key, self.begin, self.end_, self.longest, self.least = (video, shot), begin, end_, longest, least
        self.cut, self.pieces, self.good, self.other, self.any = begin, 0, None, None, False

    def _piece(self, to):
        row = (*self.key, self.pieces, self.cut, to)
        self.cut, self.pieces, self.good, self.other = to, self.pieces + 1, None, None
        return row

    def _next(self):
        return self._piece(next((p for p in (self.good, self.other) if p is not None), self.cut + self.longest))

    def add(self, t):
        if t is None or t - self.begin < self.least or self.end_ - t < self.least:
            return []
        self.any, out = True, []
        # a place beyond what the piece can still use settles where it ends
        while self.end_ - self.cut > self.longest and t > self.cut + self.longest * (1.0 if self.good is not None else 1.5):
            out.append(self._next())
        if self.cut + self.longest * 0.5 <= t <= self.cut + self.longest:
            self.good = t
        elif t > self.cut:
            self.other = t
        return out

    def end(self):
        length = self.end_ - self.begin
        if length > self.longest and not self.any:
            n = math.ceil(length / self.longest)
            return [self._piece(self.begin + (k + 1) * (length / n)) for k in range(n)]
        out = []
        while self.end_ - self.cut > self.longest:
            out.append(self._next())
        if self.end_ - self.cut > 1e-3 or not self.pieces:
            out.append(self._piece(self.end_))
        return out
