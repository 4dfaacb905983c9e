"""Benchmark decontamination by SimHash of item-sized windows.

For an item of n words, every window of n words of a document is compared with it. A window at the wanted
similarity must hold at least 2s/(1+s) of its shingles from the benchmark, so windows with fewer are set aside
first, without loss. The others get a 64-bit SimHash of their shingle counts. Fingerprints fall apart into four 16-bit
blocks: two within ``RADIUS`` bits agree in at least one block to within ``RADIUS // 4``, so looking up, in the items'
values of each block, those that near to the window's finds all of them. Candidates
within the radius are compared exactly: weighted Jaccard of the shingle counts. A document shorter than an item is one
window, compared exactly where enough of its shingles are the benchmark's.

Documents are read once per ``ITEMS`` items (or ``ITEM_BYTES`` of them) and never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SHINGLE, mix, shingles, slices, small_batches, words

SIMILARITY, RADIUS, ITEMS, ITEM_BYTES, STRETCH, AT_ONCE = 0.75, 23, 16_384, 8 << 20, 1 << 14, 256
BLOCKS, BITS = 4, 16
_U = np.uint64


def simhash(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHashes of hashes[f:f + size] for each f of ``first``; repeated hashes weigh as often."""
    lines = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=lines[1:])
    ones = lines[first + size] - lines[first]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").reshape(-1).view("<u8").astype(_U)


@dataclass
class Index:
    """Items of the benchmark: shingles with counts, sizes, fingerprints and the blocks of each size of item."""

    ids: list
    words: np.ndarray  # per item
    shingle: np.ndarray  # sorted per item
    count: np.ndarray
    first: np.ndarray
    known: np.ndarray  # sorted shingles of all items
    prints: np.ndarray
    blocks: dict  # size of item -> per block (distinct values, where their items begin, items)


def build(ids: list, texts: list[str | None]) -> Index:
    """The index of one block of items; items without words match nothing."""
    w = words(pa.array([t or "" for t in texts], pa.large_string()))
    s = shingles(w)
    sizes, kept, counts, first, prints = np.diff(w.first), [], [], [0], []
    for i in range(len(texts)):
        own = mix(s.hash[s.first[i] : s.first[i + 1]])
        h, c = np.unique(own, return_counts=True)
        kept.append(h)
        counts.append(c)
        first.append(first[-1] + len(h))
        prints.append(simhash(own, np.zeros(1, np.int64), len(own))[0] if len(own) else _U(0))
    prints, blocks = np.array(prints, _U), {}
    for n in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == n)
        tables = []
        for b in range(BLOCKS):
            values = ((prints[own] >> _U(BITS * b)) & _U(0xFFFF)).astype(np.uint16)
            order = np.argsort(values, kind="stable")
            distinct, begin = np.unique(values[order], return_index=True)
            tables.append((distinct, np.append(begin, len(own)), own[order]))
        blocks[int(n)] = tables
    empty = np.zeros(0, _U)
    shingle = np.concatenate(kept) if kept else empty
    return Index(ids, sizes, shingle, np.concatenate(counts) if counts else empty.astype(np.int64), np.array(first), np.unique(shingle), prints, blocks)


def _candidates(index: Index, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) within the radius, by the blocks of items of ``size`` words."""
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(prints), AT_ONCE):
        some = prints[at : at + AT_ONCE]
        for b, (values, begin, owner) in enumerate(index.blocks[size]):
            v = ((some >> _U(BITS * b)) & _U(0xFFFF)).astype(np.uint16)
            row, value = np.nonzero(np.bitwise_count(v[:, None] ^ values[None]) <= RADIUS // BLOCKS)
            n = begin[value + 1] - begin[value]
            rows.append(at + np.repeat(row, n))
            items.append(owner[np.repeat(begin[value] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    pair = np.unique(np.concatenate(rows) * len(index.ids) + np.concatenate(items))
    row, item = pair // len(index.ids), pair % len(index.ids)
    near = np.bitwise_count(prints[row] ^ index.prints[item]) <= RADIUS
    return row[near], item[near]


def _similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Weighted Jaccard of shingle counts."""
    h, c = np.unique(window, return_counts=True)
    a, b = index.first[item], index.first[item + 1]
    own, times = index.shingle[a:b], index.count[a:b]
    at = np.minimum(np.searchsorted(own, h), b - a - 1)
    shared = np.minimum(c, times[at])[own[at] == h].sum()
    return shared / (len(window) + times.sum() - shared)


def _matches(index: Index, w, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(row, item, first word, similarity) of the windows of a slice."""
    if not len(w.hash) or not len(index.known):
        return
    tables = []
    if (index.words >= SHINGLE).any():
        s = shingles(w)
        long_ = np.diff(w.first)[s.row] >= SHINGLE if len(s.row) else np.zeros(0, bool)
        tables.append((mix(s.hash[long_]), s.row[long_], s.word[long_], [n for n in index.blocks if n >= SHINGLE]))
    for n in (n for n in index.blocks if n < SHINGLE):  # a short item is one shingle: windows of just its words
        whole = np.flatnonzero(w.row[: len(w.row) - n + 1] == w.row[n - 1 :]) if len(w.row) >= n else np.zeros(0, np.int64)
        extra = np.zeros(len(whole), _U)
        with np.errstate(over="ignore"):
            for k in range(n):
                extra = extra * _U(0xD6E8FEB86659FD93) + w.hash[whole + k]
            h = mix(mix(extra + _U(n)))
        tables.append((h, w.row[whole], whole - w.first[w.row[whole]], [n]))
    for h, row, word, sizes in tables:
        at = np.minimum(np.searchsorted(index.known, h), len(index.known) - 1)
        hit = index.known[at] == h
        if not hit.any():
            continue
        total = np.concatenate(([0], np.cumsum(hit)))
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        length = np.diff(np.append(begin, len(row)))
        for n in sizes:
            m = max(1, n - SHINGLE + 1)
            if n >= SHINGLE:
                fit = (length < m) & (length >= least * m - 1e-9) & (total[begin + length] - total[begin] >= least / (1 + least) * (length + m) - 1e-9)
                for i, k in zip(begin[fit], length[fit], strict=True):
                    for item in np.flatnonzero(index.words == n):
                        if (got := _similarity(index, item, h[i : i + k])) >= least - 1e-12:
                            yield int(row[i]), int(item), int(word[i]), float(got)
            if len(h) < m:
                continue
            need = int(np.ceil(2 * least / (1 + least) * m - 1e-9))
            start = np.flatnonzero((total[m:] - total[:-m] >= need) & (row[: len(h) - m + 1] == row[m - 1 :]))
            for a in range(0, len(start), STRETCH):
                some = start[a : a + STRETCH]
                spans = np.unique((some[:, None] + np.arange(m)[None]).reshape(-1)) if len(some) * m < 4 * (some[-1] + m - some[0]) else np.arange(some[0], some[-1] + m)
                prints = simhash(h[spans], np.searchsorted(spans, some), m)
                for r, item in zip(*_candidates(index, n, prints), strict=True):
                    i = some[r]
                    if (got := _similarity(index, item, h[i : i + m])) >= least - 1e-12:
                        yield int(row[i]), int(item), int(word[i]), float(got)


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark's items in blocks of at most ``ITEMS`` items and about ``ITEM_BYTES`` (a longer item stands alone), each brought to the driver alone."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-count // ITEMS), -(-size // ITEM_BYTES))
    own = own.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {max(1, blocks)})"))
    for k in range(blocks):
        got = sorted(((r[0], r[1]) for r in own.where(F.col("block") == k).select("item_id", "text").toLocalIterator()), key=str)
        for a in range(0, len(got), ITEMS):
            yield build([i for i, _ in got[a : a + ITEMS]], [t for _, t in got[a : a + ITEMS]])


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document and item it contains.

    Null or empty texts match nothing; a benchmark item without words matches nothing; an item of
    fewer than five words matches windows of just these words; a document shorter than the item is one window. Of windows alike the first counts. Repeated rows come back as
    often. An empty table on either side gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words int"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = own.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column(0)
                rows = []
                for a, b in slices(batch.column(1)):
                    best: dict[tuple[int, int], tuple[float, int]] = {}
                    w = words(batch.column(1).slice(a, b - a))
                    size = np.diff(w.first)
                    for r, item, word, got in _matches(index, w, least):
                        best[r, item] = max(best.get((r, item), (0.0, 0)), (got, -word))
                    rows += [(ids[a + r].as_py(), index.ids[item], got, -word, int(min(index.words[item], size[r]))) for (r, item), (got, word) in sorted(best.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = found.unionByName(own.mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; documents are filtered where they lie.

    Null and empty texts hold none and stay; repeated rows are judged alike; an empty table on either side takes nothing away.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, b in slices(batch.column(at)):
                    keep[[a + r for r, *_ in _matches(shared.value, words(batch.column(at).slice(a, b - a)), least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
