"""A stored index for cosine search: vectors in cells around centres, read cell by cell.

Building fits centres on a bounded sample and writes each vector into the cell of its nearest centre, one bucket of a versioned table
per cell; the manifest keeps how many vectors a cell has and the widest angle to its centre. A question is compared with the centres only; by the angle
between it and a centre, less the cell's widest angle, no vector of the cell can be nearer than a known bound. So a search reads the few nearest cells
first, and then, for questions whose k-th score another cell could still reach, those cells: the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import snapshots
from ..sources.folders import durable
from .vectors import ITEM_BLOCK, _columns, _matrix, _nearest, _unit

SAMPLE = 20_000  # vectors that centres are fitted on, at most
CELLS = 4096
SLACK = 1e-9


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit ``vectors`` by spherical k-means; a centre without vectors moves to the vector farthest from its own."""
    x = _unit(np.asarray(vectors, np.float64))
    first = [0]
    best = x @ x[0]
    while len(first) < min(cells, len(x)):  # each the farthest from those before
        at = int(best.argmin())
        if best[at] > 1 - 1e-12:
            break
        first.append(at)
        best = np.maximum(best, x @ x[at])
    c = x[first]
    for _ in range(rounds):
        at, near = _cells_of(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(near)[: len(empty)]]
        c = _unit(sums)
    return c


def _cells_of(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    at, near = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ centres.T
        at[a : a + step] = s.argmax(1)
        near[a : a + step] = s.max(1)
    return at, near


def _rows(batch: pa.RecordBatch, name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``dim`` components, and those as unit vectors."""
    vectors = batch.column(batch.schema.get_field_index(name))
    on = np.flatnonzero(np.asarray(vectors.value_lengths().fill_null(-1)) == dim)
    return on, _matrix(vectors, on, dim) if len(on) else np.zeros((0, dim))


def sampled_centres(items: DataFrame, cells: int = 0, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the vectors of ``items`` (item_id, vector), fitted on those of ``sample`` ids that hash lowest; ``cells`` 0: the root of the number of vectors, ``CELLS`` at most."""
    fit = items.where(F.expr("vector is not null and exists(vector, x -> x <> 0)"))
    drawn = fit.select("vector", F.xxhash64("item_id").alias("h")).orderBy("h").limit(sample).toArrow().column("vector").combine_chunks()
    if not len(drawn):
        return np.zeros((0, 0))
    sizes = np.asarray(drawn.value_lengths())
    dim = int(sizes.max())
    return fit_centres(_matrix(drawn, np.flatnonzero(sizes == dim), dim), cells or min(CELLS, max(1, round(fit.count() ** 0.5))))


def assigned(items: DataFrame, centres: np.ndarray, name: str = "bucket") -> DataFrame:
    """``items`` with the number of the nearest centre and the cosine with it (near); a zero vector gets the number behind the last. Vectors of another dimension are left out."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, x = _rows(batch, "vector", dim)
            at, near = _cells_of(x, centres)
            zero = ~x.any(1)
            at[zero], near[zero] = len(centres), 1.0
            out = batch.take(pa.array(on))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(at.astype(np.int32)), pa.array(near)], names=[*out.schema.names, name, "near"])

    return items.mapInArrow(run, _with(items, f"{name} int, near double"))


def _with(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _cells(spark: SparkSession, path: str) -> dict:
    found = snapshots.manifest(spark, path)
    if found is None:
        raise ValueError(f"no index at {path}")
    return found["meta"]


def _measured(rows: DataFrame, before: dict, touched: list[int] | None) -> dict:
    """Numbers and least cosines of the cells, renewed for the ``touched`` ones (one row per cell)."""
    new = {str(r["bucket"]): [r["n"], r["least"]] for r in rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("near").alias("least")).collect()}
    if touched is None:
        return new
    return {b: x for b, x in before.items() if int(b) not in touched} | new


def build_index(items: DataFrame, path: str, cells: int = 0, sample: int = SAMPLE) -> int:
    """Writes an index of ``items`` (item_id, vector, and whatever searches filter by) to ``path`` and gives its version.

    All vectors must have the dimension that the longest of the sample has; null vectors and others are left out. No vectors make an index without cells.
    """
    centres = sampled_centres(items, cells, sample)
    rows = items.where("vector is not null").withColumn("item_id", F.col("item_id").cast("long"))
    rows = durable(assigned(rows, centres)) if len(centres) else rows.withColumns({"bucket": F.lit(0), "near": F.lit(0.0)}).limit(0)
    return snapshots.publish(rows, path, None, {"centres": centres.tolist(), "cells": _measured(rows, {}, None)})


def upsert_index(new: DataFrame, path: str, token: str | None = None) -> int:
    """Adds or replaces items by item_id; the cells they leave and enter are written anew, the centres stay. One row per item_id must be in ``new``."""
    spark = new.sparkSession
    meta = _cells(spark, path)
    centres = np.array(meta["centres"], np.float64)
    rows = new.where("vector is not null").withColumn("item_id", F.col("item_id").cast("long"))
    rows = durable(assigned(rows, centres))
    ids = rows.select("item_id").distinct()
    left = snapshots.load(spark, path).select("item_id", "bucket").join(ids, "item_id", "left_semi").select("bucket")
    touched = [r[0] for r in left.union(rows.select("bucket")).distinct().collect()]
    stored = snapshots.load(spark, path, touched).join(ids, "item_id", "left_anti")
    whole = durable(stored.unionByName(rows.select(*stored.columns)))
    return snapshots.publish(whole, path, touched, {"cells": _measured(whole, meta["cells"], touched)}, token)


def _bounds(q: np.ndarray, centres: np.ndarray, cells: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the cells with vectors, and the largest cosine that each question can have in each."""
    numbers = np.array(sorted(map(int, cells)), np.int64)
    out = np.zeros((len(q), len(numbers)))  # a zero vector's cosine is 0
    real = numbers < len(centres)
    if real.any():
        wide = np.arccos(np.clip([cells[str(n)][1] for n in numbers[real]], -1, 1))
        angle = np.arccos(np.clip(q @ centres[numbers[real]].T, -1, 1)) - wide
        out[:, real] = np.where(q.any(1)[:, None], np.cos(np.maximum(0, angle)), 0.0)
    return numbers, out


def _probe(queries: DataFrame, meta: dict, probes: int, known: bool) -> DataFrame:
    """``queries`` with a bucket to read, one row each: the ``probes`` of the largest bounds, or with ``known`` all others whose bound reaches ``kth`` (null: any)."""
    centres, cells = np.array(meta["centres"], np.float64), meta["cells"]
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on, q = _rows(batch, "vector", dim)
            numbers, bound = _bounds(q, centres, cells)
            order = np.argsort(-bound, axis=1, kind="stable")
            want = np.zeros(bound.shape, bool)
            np.put_along_axis(want, order[:, :probes], True, axis=1)
            if known:
                kth = np.array([-2.0 if x is None else x for x in batch.column(batch.schema.get_field_index("kth")).to_pylist()])[on]
                want = ~want & (bound >= kth[:, None] - SLACK)
            i, j = np.nonzero(want)
            out = batch.take(pa.array(on[i]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers[j].astype(np.int32))], names=[*out.schema.names, "bucket"])

    return queries.mapInArrow(run, _with(queries, "bucket int"))


def _scan(spark: SparkSession, path: str, version: int, asked: DataFrame, k: int, where: str, cells: dict) -> DataFrame:
    """(q_id, item_id, score): the k best of each cell and question in ``asked`` (q_id, vector, bucket); only their cells are read."""
    wanted = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as there are cells at most
    items = snapshots.load(spark, path, wanted, version).where(where).select("item_id", F.col("vector").alias("_x"), "bucket")
    slots = {int(b): -(-n // ITEM_BLOCK) for b, (n, _) in cells.items() if n > ITEM_BLOCK}  # large cells are read by several tasks
    large = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair]) if slots else None
    n = F.coalesce(large[F.col("bucket")], F.lit(1)) if slots else F.lit(1)
    left = items.withColumn("_slot", F.pmod(F.xxhash64("item_id"), n).cast("int"))
    right = asked.select(F.col("q_id").cast("long").alias("q_id"), F.col("vector").alias("_q"), F.col("bucket").alias("bucket")).withColumn("_slot", F.explode(F.sequence(F.lit(0), n - 1)))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            (ids, vs, sizes), (who, qs, _) = _columns(left, "item_id", "_x"), _columns(right, "q_id", "_q")
            width = int(sizes[0])
            for a in range(0, len(who), 1024):
                rows = np.arange(a, min(a + 1024, len(who)))
                for out, part in zip(found, _nearest(who[rows], _matrix(qs, rows, width), ids, vs, np.arange(len(ids)), width, k), strict=True):
                    out.append(part)
        return pa.table(dict(zip(("q_id", "item_id", "score"), map(np.concatenate, found), strict=True)))

    return left.groupBy("bucket", "_slot").cogroup(right.groupBy("bucket", "_slot")).applyInArrow(lambda l, r: best(l, r), "q_id long, item_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("score", 9).desc(), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, where: str = "true", probes: int = 4, exact: bool = True, read: list | None = None) -> DataFrame:
    """(q_id, item_id, score, rank): the ``k`` items nearest by cosine to each of ``queries`` (q_id, vector), ties by item_id.

    ``where`` is a condition on the stored columns, which the cells' files are read with. ``exact`` False stops after the ``probes`` cells of the largest bounds. Queries
    of another dimension find nothing; one row per q_id. ``read`` gets (q_id, bucket) frames of the cells read.
    """
    found = snapshots.manifest(spark, path)
    if found is None:
        raise ValueError(f"no index at {path}")
    meta, version = found["meta"], found["version"]
    if not meta["cells"]:
        return spark.createDataFrame([], "q_id long, item_id long, score double, rank int")
    asked = queries.where("vector is not null").select(F.col("q_id").cast("long").alias("q_id"), "vector")
    first = _probe(asked, meta, probes, False)
    hits = _ranked(_scan(spark, path, version, first, k, where, meta["cells"]), k)
    parts = [first.select("q_id", "bucket")]
    if exact:
        hits = durable(hits)
        kth = hits.where(F.col("rank") == k).select("q_id", F.col("score").alias("kth"))
        rest = durable(_probe(asked.join(kth, "q_id", "left"), meta, probes, True))
        parts.append(rest.select("q_id", "bucket"))
        more = _scan(spark, path, version, rest.drop("kth"), k, where, meta["cells"])
        hits = _ranked(hits.drop("rank").unionByName(more), k)
    if read is not None:
        read.append(reduce(DataFrame.unionByName, parts))
    return hits
