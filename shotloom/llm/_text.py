"""Vectorised word and shingle fingerprints over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Everything works on
the UTF-8 bytes of a slice of rows at once, so a task holds one slice (``SLICE_BYTES``, or one
longer text), never a partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
ROWS_PER_BATCH = 1000
SHINGLE = 5

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = _U(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2**64, grown on demand."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    x = np.full(n, base, dtype=np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a slice: per word its fingerprint, row and byte range; per row the word offsets."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of row i
    data: np.ndarray
    offset: np.ndarray  # byte offsets of the rows


def small_batches(spark) -> None:
    """Lets Spark hand texts to Python in batches of at most ROWS_PER_BATCH rows; both sides hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, ROWS_PER_BATCH)


def release() -> None:
    """Gives memory that a Python worker holds without use back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes each (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, total = 0, np.concatenate(([0], np.cumsum(sizes)))
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to
    release()


def words(texts: pa.Array) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(n + 1, np.int64), data, off)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _Powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + _U(1)) * up[:-1], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _FOLD)
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(n), np.diff(first))
    return Words(h, row, start, end, first, data, off)


@dataclass
class Shingles:
    """Shingles in text order: fingerprint, row and index of the first word; first[i]:first[i+1] is row i."""

    hash: np.ndarray
    row: np.ndarray
    word: np.ndarray
    first: np.ndarray


def shingles(w: Words, size: int = SHINGLE) -> Shingles:
    """``size``-word shingles of each row; a row of fewer words gives its whole sequence as one."""
    n, rows = len(w.hash), len(w.first) - 1
    counts = np.diff(w.first)
    with np.errstate(over="ignore"):
        if n >= size:
            acc = w.hash[: n - size + 1].copy()
            for k in range(1, size):
                acc *= _FOLD
                acc += w.hash[k : n - size + 1 + k]
            whole = w.row[: n - size + 1] == w.row[size - 1 :]
            h, row, word = mix(acc[whole]), w.row[: n - size + 1][whole], np.flatnonzero(whole)
        else:
            h, row, word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            at, extra = w.first[short], np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                on = counts[short] > k
                extra[on] = extra[on] * _FOLD + w.hash[at[on] + k]
            extra = mix(extra + counts[short].astype(np.uint64))
            h, row, word = np.concatenate((h, extra)), np.concatenate((row, short)), np.concatenate((word, at))
            order = np.argsort(word, kind="stable")
            h, row, word = h[order], row[order], word[order]
    first = np.searchsorted(row, np.arange(rows + 1))
    return Shingles(h, row, word - w.first[row], first)


def distinct_per_row(s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each row: (hash, row, first)."""
    order = np.lexsort((s.hash, s.row))
    h, row = s.hash[order], s.row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, row, np.searchsorted(row, np.arange(len(s.first)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; empty ranges give 0."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
        return total[first[1:]] - total[first[:-1]]


def set_digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row's fingerprint set, independent of order (0 for an empty set)."""
    n = np.diff(first).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = mix(sums(mix(h ^ _FOLD), first) ^ (n * _U(_BASE)))
    out[n == 0] = 0
    return out
