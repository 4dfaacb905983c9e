"""Cosine search and pooling over vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ITEM_BLOCK, LEAST_BLOCK, AT_ONCE = 4096, 1 << 16, 2048, 1024


def cosine(a: str, b: str) -> Column:
    """Cosine in double precision; 0 if either norm is 0."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, v) -> s + v)"
    return F.expr(f"coalesce(try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 0D)")


def top_k(items: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(q_id, item_id, score, rank): the ``k`` items nearest by cosine to each query, ties by item_id.

    ``items`` has item_id and vector, ``queries`` q_id and vector; with ``by``, a column of both, a query meets only
    items of its own value. A task compares a block of queries with a block of items and gives out k items per query, so
    no side is held whole anywhere. Vectors that are null or of another dimension than the query score nothing; a zero norm scores 0.
    """
    own = [by] if by else []
    x = items.where("vector is not null").select(*own, F.col("item_id").cast("long").alias("item_id"), F.col("vector").alias("_x"))
    q = queries.where("vector is not null").select(*own, F.col("q_id").cast("long").alias("q_id"), F.col("vector").alias("_q"))
    n, m = x.count(), q.count()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots, blocks = max(1, -(-n // ITEM_BLOCK), min(parts, n // LEAST_BLOCK)) if not by else max(1, -(-n // ITEM_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = x.withColumn("_slot", F.expr(f"cast(pmod(xxhash64(item_id), {slots}) as int)")).withColumn("_block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    right = q.withColumn("_block", F.expr(f"cast(pmod(xxhash64(q_id), {blocks}) as int)")).withColumn("_slot", F.explode(F.expr(f"sequence(0, {slots - 1})")))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            (ids, vs, sizes), (asked, qs, wanted) = _columns(left, "item_id", "_x"), _columns(right, "q_id", "_q")
            for width in np.intersect1d(sizes, wanted):
                mine, theirs = np.flatnonzero(sizes == width), np.flatnonzero(wanted == width)
                for a in range(0, len(theirs), AT_ONCE):
                    rows = theirs[a : a + AT_ONCE]
                    for out, part in zip(found, _nearest(asked[rows], _matrix(qs, rows, width), ids, vs, mine, width, k), strict=True):
                        out.append(part)
        return pa.table(dict(zip(("q_id", "item_id", "score"), map(np.concatenate, found), strict=True)))

    key = [*own, "_slot", "_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda l, r: best(l, r), "q_id long, item_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("score", 9).desc(), "item_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _columns(table: pa.Table, name: str, vector: str) -> tuple:
    vectors = table.column(vector).combine_chunks()
    return np.asarray(table.column(name).combine_chunks()), vectors, np.asarray(vectors.value_lengths())


def _matrix(vectors: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return _unit(np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(-1, width))


def _nearest(asked, q, ids, vectors, rows, width: int, k: int) -> tuple:
    """The ``k`` best of some items for each of some queries: (query, item, score)."""
    best, who = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
    for a in range(0, len(rows), AT_ONCE):
        part = rows[a : a + AT_ONCE]
        s = np.concatenate((best, q @ _matrix(vectors, part, width).T), axis=1)
        w = np.concatenate((who, np.broadcast_to(ids[part], (len(q), len(part)))), axis=1)
        order = np.lexsort((w, -np.round(s, 9)), axis=1)[:, :k]
        best, who = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
    return np.repeat(asked, best.shape[1]), who.reshape(-1), best.reshape(-1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def first_per(hits: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The best hit per query and ``key`` of ranked hits, ranked anew, ``limit`` of them."""
    firsts = hits.withColumn("_n", F.row_number().over(Window.partitionBy("q_id", *key).orderBy("rank"))).where("_n = 1").drop("_n")
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("rank") <= limit)


KEYS = 4096  # keys whose sums a task holds before it hands them on


def mean_pool(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Mean vector per ``key``, component by component, over the vectors that have it; null vectors and components don't count.

    A task adds up whole vectors, so a row per key and task is dealt out; those are added up per key.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "n", "total"]

    def add(into: dict, k, n: np.ndarray, total: np.ndarray) -> None:
        if k in into:
            n0, total0 = into[k]
            if len(n0) < len(n):
                (n, total), (n0, total0) = (n0, total0), (n.copy(), total.copy())
            n0[: len(n)] += n
            total0[: len(total)] += total
        else:
            n0, total0 = n.copy(), total.copy()
        into[k] = n0, total0

    def packed(sums: dict) -> list[pa.Array]:
        return [pa.array([n for n, _ in sums.values()], pa.list_(pa.int64())), pa.array([t for _, t in sums.values()], pa.list_(pa.float64()))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            named, code = codes.dictionary.to_pylist(), np.asarray(codes.indices.fill_null(-1))
            vectors = batch.column(1)
            sizes = np.asarray(vectors.value_lengths().fill_null(-1))
            for width in np.unique(sizes[sizes > 0]):
                on = np.flatnonzero(sizes == width)
                flat = vectors.take(pa.array(on)).flatten()
                there, x = np.asarray(flat.is_valid()).reshape(-1, width), np.asarray(flat.cast(pa.float64()).fill_null(0.0)).reshape(-1, width)
                own, at = np.unique(code[on], return_inverse=True)
                n, total = np.zeros((len(own), width), np.int64), np.zeros((len(own), width))
                np.add.at(n, at, there)
                np.add.at(total, at, x)
                for k, a, b in zip(own, n, total, strict=True):
                    add(sums, None if k < 0 else named[k], a, b)
            if len(sums) > KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.column(0).type), *packed(sums)], names=names)
                sums = {}
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), batch.column(0).type), *packed(sums)], names=names)

    def merge(group: pa.Table) -> pa.Table:
        sums: dict = {}
        for n, total in zip(group.column("n").to_pylist(), group.column("total").to_pylist(), strict=True):
            add(sums, 0, np.array(n), np.array(total))
        n, total = sums[0]
        return pa.table({key: group.column(key).slice(0, 1), vector: pa.array([[float(t / m) if m else None for m, t in zip(n, total, strict=True)]], pa.list_(pa.float64()))})

    parts = rows.select(key, vector).mapInArrow(partial, f"`{key}` {kind}, n array<long>, total array<double>")
    return parts.groupBy(key).applyInArrow(merge, f"`{key}` {kind}, `{vector}` array<double>")


def normalized(vector: str) -> Column:
    """The vector by its norm, at least 1e-12."""
    return F.expr(f"transform({vector}, x -> cast(x as double) / greatest(sqrt(aggregate({vector}, 0D, (s, v) -> s + cast(v as double) * v)), 1e-12D))")


def softly_normalized(vector: str, added: float = 1e-8) -> Column:
    """The vector by its norm and a little ``added`` to it, so that a zero vector stays one."""
    return F.expr(f"transform({vector}, x -> cast(x as double) / (sqrt(aggregate({vector}, 0D, (s, v) -> s + cast(v as double) * v)) + {added}D))")


#: Types of entities that are no topics.
NO_TOPICS = ("person", "organization", "location", "event", "tool")


def concepts(entities: DataFrame, asked: DataFrame, counts: DataFrame, k: int, types: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """The ``k`` entities (entity_id, type, vector) nearest to each query, of the given types, else of any but ``NO_TOPICS`` (no type is fine), with their counts (entity_id, mentions, videos; 0 if missing)."""
    rule = F.col("type").isin(*types) if types else F.coalesce(~F.col("type").isin(*NO_TOPICS), F.lit(True))
    found = top_k(entities.where(rule).withColumnRenamed("entity_id", "item_id"), asked, k, by).withColumnRenamed("item_id", "entity_id")
    return found.join(entities.select("entity_id", "type"), "entity_id").join(counts, "entity_id", "left").na.fill(0, ["mentions", "videos"])
