"""Quality classifier: a second-order factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_j x_j + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2)): the
pairwise interactions cost time linear in the non-zero features. Features are word hashes
(L2-normalised counts) and structure statistics of the text and its length, each one-hot in quantile bins.
Labels, language, source and id are not features.

The machine is fitted on the driver from the features of at most ``SAMPLE`` labelled documents outside the held-out fold,
drawn by a hash of the id; everything else is scored where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Words, shingles, slices, small_batches, words

SAMPLE, BUCKETS, RANK, BINS = 6000, 1 << 13, 6, 10
_U = np.uint64
#: Byte classes: letters a-z, A-Z, digits, white space, newline, sentence marks, exclamation, pipe, other signs, beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
for _i, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-()", b"!", b"|")):
    _CLASS[list(_s)] = _i
_CLASS[128:] = 9
_CLASSES = 10
STATS = _CLASSES + 6


@dataclass
class Features:
    """Rows of a slice: word features (bucket, value) with row offsets, and dense statistics."""

    bucket: np.ndarray
    value: np.ndarray
    first: np.ndarray
    stats: np.ndarray


def _distinct(rows: np.ndarray, values: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Distinct ``values`` (below 2**bits) per row."""
    keys = np.unique((rows.astype(np.uint64) << _U(bits)) | values)
    return np.bincount((keys >> _U(bits)).astype(np.int64), minlength=count)


def features(w: Words) -> Features:
    count, n = len(w.first) - 1, np.diff(w.first)
    size = np.diff(w.offset)
    kinds = np.bincount(np.repeat(np.arange(count), size) * _CLASSES + _CLASS[w.data], minlength=count * _CLASSES).reshape(count, _CLASSES)
    s = shingles(w, 3)
    many = np.maximum(n, 1)
    runs = np.diff(s.first)
    stats = np.empty((count, STATS))
    stats[:, :_CLASSES] = kinds / np.maximum(size, 1)[:, None]
    stats[:, _CLASSES] = np.log1p(n)
    stats[:, _CLASSES + 1] = np.log1p(size)
    stats[:, _CLASSES + 2] = kinds[:, [0, 1, 9]].sum(1) / many
    stats[:, _CLASSES + 3] = _distinct(w.row, w.hash >> _U(32), count, 32) / many
    stats[:, _CLASSES + 4] = _distinct(s.row, s.hash >> _U(32), count, 32) / np.maximum(runs, 1)
    stats[:, _CLASSES + 5] = n / (kinds[:, 4] + 1)
    keys, times = np.unique((w.row.astype(np.uint64) << _U(16)) | (w.hash % _U(BUCKETS)), return_counts=True)
    row = (keys >> _U(16)).astype(np.int64)
    norm = np.sqrt(np.bincount(row, times.astype(float) ** 2, minlength=count))
    return Features((keys & _U(0xFFFF)).astype(np.int64), times / norm[row], np.searchsorted(row, np.arange(count + 1)), stats)


@dataclass
class Machine:
    """Fitted parameters: bin edges of the statistics, bias, linear weights, factors."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of all non-zero features."""
        count = len(f.first) - 1
        bins = (f.stats[:, :, None] > self.edges[None]).sum(2) + BUCKETS + np.arange(STATS) * (BINS + 1)
        row = np.concatenate((np.repeat(np.arange(count), np.diff(f.first)), np.repeat(np.arange(count), STATS)))
        return row, np.concatenate((f.bucket, bins.reshape(-1))), np.concatenate((f.value, np.full(count * STATS, 1 / STATS**0.5)))

    def score(self, f: Features) -> np.ndarray:
        count = len(f.first) - 1
        row, col, x = self.rows(f)
        out = np.bincount(row, self.linear[col] * x, minlength=count) + self.bias
        for k in range(self.factors.shape[1]):
            vx = self.factors[col, k] * x
            out += 0.5 * (np.bincount(row, vx, minlength=count) ** 2 - np.bincount(row, vx * vx, minlength=count))
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(texts: list[str | None], labels: np.ndarray, **how) -> Machine:
    """``fit_features`` of whole texts."""
    array = pa.array(texts, pa.large_string())
    return fit_features([features(words(array.slice(a, b - a))) for a, b in slices(array)], labels, **how)


def fit_features(parts: list[Features], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in mini-batches. Without labels of both kinds the prior is the score."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATS * (BINS + 1)
    stats = np.concatenate([p.stats for p in parts]) if parts else np.zeros((0, STATS))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T if len(stats) else np.zeros((STATS, BINS))
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    rows, cols, xs, base = [], [], [], 0
    for p in parts:
        r, c, x = m.rows(p)
        rows.append(r + base)
        cols.append(c)
        xs.append(x)
        base += len(p.first) - 1
    row, col, x = (np.concatenate(v) for v in (rows, cols, xs))
    order = np.argsort(row, kind="stable")
    row, col, x = row[order], col[order], x[order]
    first = np.searchsorted(row, np.arange(base + 1))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(base), max(1, base // 128)):
            n = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            r, c, v = np.repeat(np.arange(len(batch)), n), col[at], x[at]
            vx = m.factors[c] * v[:, None]
            ends = np.concatenate(([0], np.cumsum(n)))[:-1]
            total = np.add.reduceat(vx, ends, axis=0)
            out = m.bias + np.bincount(r, m.linear[c] * v, minlength=len(batch)) + 0.5 * (total**2).sum(1) - 0.5 * np.bincount(r, (vx * vx).sum(1), minlength=len(batch))
            g = 1 / (1 + np.exp(-np.clip(out, -35, 35))) - labels[batch]
            cols_now, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, g[r] * v) + ridge * len(batch) * m.linear[cols_now]
            dv = np.stack([np.bincount(back, g[r] * v * (total[r, k] - vx[:, k])) for k in range(RANK)], 1) + ridge * len(batch) * m.factors[cols_now]
            gw[cols_now] += dw**2
            gv[cols_now] += dv**2
            gb += g.sum() ** 2
            m.linear[cols_now] -= rate * dw / np.sqrt(gw[cols_now])
            m.factors[cols_now] -= 0.3 * rate * dv / np.sqrt(gv[cols_now])
            m.bias -= rate * g.sum() / gb**0.5
    return m


def fold(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty."""
    return F.expr(f"cast(crc32(cast(coalesce(cast({doc_id} as string), '') as binary)) % {folds} as int)")


_SHOWN = "doc_id long, quality int, bucket array<smallint>, value array<float>, stats array<double>"


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, a row each."""
    for batch in batches:
        for a, b in slices(batch.column(2)):
            f = features(words(batch.column(2).slice(a, b - a)))
            ends = pa.array(f.first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(f.bucket.astype(np.int16))), pa.ListArray.from_arrays(ends, pa.array(f.value.astype(np.float32)))]
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, f.stats.size + 1, STATS, dtype=np.int32)), pa.array(f.stats.reshape(-1))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), *lists], names=["doc_id", "quality", "bucket", "value", "stats"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled documents outside fold 0, drawn by a hash of the id.

    Null ids and labels other than 0 and 1 are ignored; the worst of repeated labels and the least of repeated texts
    count. Without documents or labels the score is one half. The driver gets a row of features (at most one number for each bucket) for each document of the sample.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality in (0, 1)").where(fold() != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by the sample
    own = own.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = own.select("doc_id", "quality", "text").mapInArrow(_shown, _SHOWN).toArrow()
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))).combine_chunks()
    if not got.num_rows:
        return fit([], np.zeros(0))
    bucket, value, stats = (got.column(c).combine_chunks() for c in ("bucket", "value", "stats"))
    first = np.concatenate(([0], np.cumsum(np.asarray(bucket.value_lengths()).astype(np.int64))))
    shown = Features(np.asarray(bucket.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(float), first, np.asarray(stats.flatten()).reshape(-1, STATS))
    return fit_features([shown], got.column("quality").to_numpy().astype(float))


def score_quality(docs: DataFrame, machine: Machine, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= ``cut``) for every row of ``docs``.

    A null text is scored as an empty one; repeated rows come back as often; an empty table gives an
    empty result; other columns are ignored. Each task scores slices of whole texts.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                s = machine.score(features(words(batch.column(2).slice(a, b - a))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")



def keep_good(docs: DataFrame, machine: Machine, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``cut`` or more; documents are filtered where they lie.

    A null text is scored as an empty one; repeated rows are judged alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(machine.score(features(words(part.column(at)))) >= cut))

    return docs.mapInArrow(run, docs.schema)
