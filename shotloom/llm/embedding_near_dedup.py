"""Near duplicates of embeddings by a robust-pruned flat graph.

Equal vectors are one node. k-means centres, fitted on a bounded sample, give each node its nearest
clusters: overlapping shards. How many is measured: the true links of ``AUDITED`` nodes with all others tell how many nearest clusters each node must
have so that at most a thousandth of the links have no shard in common (``OVERLAP`` at least). Where that is so many that the shards would cost more than comparing all,
all nodes are one shard. A shard above ``BLOCK`` nodes is clustered again by centres of its own, if a sample of it shows that
at most a thousandth of its links would be lost; a dense one falls apart into blocks by a hash, all pairs of which are searched. Each shard or block builds a flat graph: its nodes'
nearest neighbours in it, robust-pruned, and the reverse edges; the nodes nearest to a few centres are its medoids. The adjacency lists of a node from all its shards are
united. Every node then searches its shards on
the united graph: a greedy beam search from the medoids, which after that expands every node in
range until no new one turns up. A pair of blocks is one task and searches both ways, so links are
symmetric; a pair of nodes counts in the first shard that they share. Cosines are checked in double precision.
What a task gives out is a count for each node and the edges of a spanning forest, never all pairs of a group.
Dimensions with at most ``BLOCK`` nodes are one shard each.

``audit_recall`` compares with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import connected_components, contract, durable

SAMPLE, NODES_PER_CENTRE, MOST_CENTRES = 20_000, 1000, 8192
OVERLAP, BLOCK, DEGREE, POOL, ALPHA, BEAM, MEDOIDS = 3, 4096, 24, 48, 1.2, 24, 12
AUDITED = 1024  # nodes whose links are looked up among all
SUB_SAMPLE, MOST_LOST, SUB = 4096, 0.001, 20  # SUB: bits of a shard number for the parts of a shard
_FINE = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _centres(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its centre."""
    if count <= 1 or len(x) <= count:
        return x[:count] if len(x) else np.zeros((1, x.shape[1]))
    c = x[np.random.default_rng(seed).choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
        total = np.add.reduceat(x[order], firsts, axis=0)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = c.copy()
        c[own[order][firsts]] = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c[own[order][firsts]])
    return c


def _own(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The nearest centres of each vector, by number."""
    most = min(most, len(centres))
    return np.sort(np.argpartition(-(x @ centres.T), most - 1, axis=1)[:, :most], axis=1).astype(np.int64)


def _ranks(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each vector: 0 for the nearest centre, 1 for the next, and so on."""
    return np.argsort(np.argsort(-(x @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")


def clusters_needed(groups: DataFrame, width: int, least: float, centres: np.ndarray) -> list[int]:
    """How many links of ``AUDITED`` nodes with any node share a cluster if each node has its nearest 1, 2, ... clusters, the links of each number alone.

    ``groups`` has node and v; every node is compared with the audited ones, and only numbers come to the driver.
    """
    audited = groups.select("node", "v").orderBy(F.xxhash64("v", F.lit("audit")), "node").limit(AUDITED).toArrow()
    asked = np.asarray(audited.column("node").combine_chunks())
    q = _unit(_matrix(audited.column("v"), width))
    q_ranks = _ranks(q, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres), np.int64)
        for batch in batches:
            node, x = np.asarray(batch.column(0)), _unit(_matrix(batch.column(1), width)) if batch.num_rows else np.zeros((0, width))
            i, j = np.nonzero((x @ q.T >= least) & (node[:, None] != asked))
            rows, at = np.unique(i, return_inverse=True)
            ranks = _ranks(x[rows], centres)
            for a in range(0, len(i), step := max(1, 4_000_000 // len(centres))):
                need = np.maximum(ranks[at[a : a + step]], q_ranks[j[a : a + step]]).min(1)
                total += np.bincount(need, minlength=len(centres))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["need", "n"])

    found = groups.select("node", "v").mapInArrow(run, "need long, n long").groupBy("need").agg(F.sum("n").alias("n")).collect()
    out = [0] * len(centres)
    for r in found:
        out[r["need"]] = r["n"]
    return out


def overlap_for(needed: list[int]) -> int:
    """The nearest clusters that each node must have so that at most ``MOST_LOST`` of the links are torn."""
    got, links = np.cumsum(needed), sum(needed)
    return max(OVERLAP, int(np.searchsorted(got, links * (1 - MOST_LOST))) + 1)


def _assign(centres: np.ndarray, overlap: int):
    names = ["node", "v", "shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, most = centres.shape[1], min(overlap, len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1), width))
            near = _own(x, centres, most) << SUB
            ends = np.arange(0, len(x) * most + 1, most, dtype=np.int32)
            units = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), units, pa.ListArray.from_arrays(pa.array(ends), pa.array(near.reshape(-1)))], names=names)

    return run


def robust_prune(x: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Of each row of ``pool`` (neighbours, nearest first; -1: none), at most ``degree`` that no nearer kept one covers."""
    out = np.full((len(pool), degree), -1, np.int64)
    for a in range(0, len(pool), 256):
        ids = pool[a : a + 256]
        rows, vectors = np.arange(len(ids)), x[ids]
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", x[a : a + 256], vectors)))
        alive = ids >= 0
        for k in range(degree):
            at = alive.argmax(1)
            has = alive[rows, at]
            if not has.any():
                break
            out[a : a + 256][has, k] = ids[rows, at][has]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", vectors[rows, at], vectors)))
            alive &= alpha * apart > away
            alive[rows, at] = False
    return out


def _nearest(x: np.ndarray, count: int) -> np.ndarray:
    """Ids of the nearest others in the block, nearest first."""
    count = min(count, len(x) - 1)
    out = np.full((len(x), max(count, 1)), -1, np.int64)
    for a in range(0, len(x), 512) if count > 0 else ():
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, count - 1, axis=1)[:, :count]
        out[a : a + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def _graph_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges as a * n + b, sorted; which nodes are medoids) of one shard or block."""
    kept = robust_prune(x, _nearest(x, POOL))
    a, k = np.nonzero(kept >= 0)
    b = kept[a, k]
    start = _centres(x, min(max(MEDOIDS, len(x) // 64), len(x)), rounds=3)
    medoid = np.zeros(len(x), bool)
    medoid[(start @ x.T).argmax(1)] = True
    return np.unique(np.concatenate((a * len(x) + b, b * len(x) + a))), medoid


def _build(width: int):
    """Adjacency lists of one shard or block: pruned neighbours and reverse edges; its medoids are marked."""

    def run(key, table):
        node = np.asarray(table.column("node").combine_chunks())
        order = np.argsort(node)
        node, x = node[order], _matrix(table.column("v"), width)[order]
        both, medoid = _graph_of(x)
        ends = np.searchsorted(both // len(node), np.arange(len(node) + 1)).astype(np.int32)
        starts = pa.array([[key[0].as_py()] if m else [] for m in medoid], pa.list_(pa.int64()))
        return pa.table({"node": node, "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(node[both % len(node)])), "starts": starts})

    return run


def _padded(node: np.ndarray, near: pa.ListArray) -> np.ndarray:
    """Adjacency as positions in the sorted ``node``; neighbours elsewhere drop out."""
    ids = np.asarray(near.flatten())
    row = np.repeat(np.arange(len(near)), np.diff(np.asarray(near.offsets)))
    at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
    inside = node[at] == ids
    row, at = row[inside], at[inside]
    n = np.bincount(row, minlength=len(near))
    out = np.full((len(near), max(1, int(n.max(initial=0)))), -1, np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)] = at
    return out


QUERIES = 512  # searched at once


def range_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, medoids: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) found at cosine ``least`` or more, some queries at a time."""
    for at in range(0, len(q), QUERIES):
        i, j = np.nonzero(_search_some(q[at : at + QUERIES], x, near, medoids, least))
        yield at + i, j


def _search_some(q: np.ndarray, x: np.ndarray, near: np.ndarray, start: np.ndarray, least: float) -> np.ndarray:
    """Which of ``x`` (with its graph) each of ``q`` finds: a matrix of booleans."""
    nq, n = len(q), len(x)
    seen, found, done = (np.zeros((nq, n), bool) for _ in range(3))
    near_start = q @ x[start].T
    seen[:, start] = True
    found[:, start] = near_start >= least
    top = np.argpartition(-near_start, min(BEAM, len(start)) - 1, axis=1)[:, :BEAM]
    ids, sims, closed = np.full((nq, BEAM), -1, np.int64), np.full((nq, BEAM), -np.inf), np.ones((nq, BEAM), bool)
    ids[:, : top.shape[1]], sims[:, : top.shape[1]], closed[:, : top.shape[1]] = start[top], np.take_along_axis(near_start, top, 1), False
    while True:
        best = np.where(closed, -np.inf, sims)
        at = best.argmax(1)
        on = np.flatnonzero(~closed[np.arange(nq), at])
        if not len(on):
            break
        node = ids[on, at[on]]
        closed[on, at[on]] = True
        done[on, node] = True
        nb = near[node]
        new = (nb >= 0) & ~seen[on[:, None], nb]
        r, c = np.nonzero(new)
        seen[on[r], nb[r, c]] = True
        s = np.full(nb.shape, -np.inf)
        s[r, c] = np.einsum("nd,nd->n", q[on[r]], x[nb[r, c]])
        found[on[r], nb[r, c]] = s[r, c] >= least
        s = np.concatenate((sims[on], s), axis=1)
        top = np.argpartition(-s, BEAM - 1, axis=1)[:, :BEAM]
        ids[on] = np.take_along_axis(np.concatenate((ids[on], nb), axis=1), top, 1)
        closed[on] = np.take_along_axis(np.concatenate((closed[on], ~new), axis=1), top, 1)
        sims[on] = np.take_along_axis(s, top, 1)
    while (todo := found & ~done).any():
        qs, nodes = np.nonzero(todo)
        done |= todo
        for i in range(0, len(qs), 20_000):
            nb = near[nodes[i : i + 20_000]]
            new = (nb >= 0) & ~seen[qs[i : i + 20_000, None], nb]
            r, c = np.nonzero(new)
            pairs = np.unique(qs[i + r] * n + nb[r, c])
            a, b = pairs // n, pairs % n
            seen[a, b] = True
            found[a, b] = np.einsum("nd,nd->n", q[a], x[b]) >= least
    return found


def _none(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def _counted(node: np.ndarray, links: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    """Link counts and the edges of a spanning forest."""
    own = np.flatnonzero(links)
    a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (a, b))
    edges = next(iter(contract(iter([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]))))
    return pa.concat_tables(
        [
            pa.table({"node": node[own], "links": links[own], "a": _none(len(own)), "b": _none(len(own))}),
            pa.table({"node": _none(edges.num_rows), "links": _none(edges.num_rows), "a": edges.column(0), "b": edges.column(1)}),
        ]
    )


def _forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what (a, b) connect, fewer than nodes."""
    edges = next(iter(contract(iter([pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])]))))
    return np.asarray(edges.column(0)), np.asarray(edges.column(1))


def _search(width: int, least: float):
    def run(key, table):
        shard, i, j = (k.as_py() for k in key)
        order = np.lexsort((np.asarray(table.column("node").combine_chunks()), np.asarray(table.column("block").combine_chunks())))
        table = table.take(pa.array(order)).combine_chunks()
        node, copies, block = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "copies", "block"))
        x = _matrix(table.column("v"), width)
        lists = table.column("shards").combine_chunks()
        sizes = np.diff(np.asarray(lists.offsets))
        # the shards of each node before this one, and whether it is a medoid here
        row, value = np.repeat(np.arange(len(node)), sizes), np.asarray(lists.flatten())
        row, value = row[value < shard], value[value < shard]
        before = np.full((len(node), int(sizes.max(initial=0))), -1, np.int64)
        n = np.bincount(row, minlength=len(node))
        before[row, np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)] = value
        starts = table.column("starts").combine_chunks()
        row = np.repeat(np.arange(len(node)), np.diff(np.asarray(starts.offsets)))
        medoid = np.zeros(len(node), bool)
        medoid[row[np.asarray(starts.flatten()) == shard]] = True
        cut = int(np.searchsorted(block, i, "right"))
        near = table.column("near").combine_chunks()
        links, ea, eb = np.zeros(len(node), np.int64), [], []

        def side(a0: int, a1: int) -> tuple[np.ndarray, np.ndarray]:
            return _padded(node[a0:a1], near.slice(a0, a1 - a0)), np.flatnonzero(medoid[a0:a1])

        def count(a: np.ndarray, b: np.ndarray) -> None:
            """Pairs found, both ways, that have no earlier shard in common."""
            for at in range(0, len(a), step := max(1, 4_500_000 // max(1, before.shape[1] ** 2))):
                p, q = before[a[at : at + step]], before[b[at : at + step]]
                own = ~((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).any((1, 2))
                r, c = a[at : at + step][own], b[at : at + step][own]
                np.add.at(links, r, copies[c])
                np.add.at(links, c, copies[r])
                for e, more in zip((ea, eb), _forest(node, r, c), strict=True):
                    e.append(more)

        (a0, a1), (b0, b1) = [(0, cut), (cut, len(node))] if i != j else [(0, len(node)), (0, len(node))]
        if a1 > a0 and b1 > b0:
            there, here = side(b0, b1), side(a0, a1)
            forth = [(a0 + r) * len(node) + b0 + c for r, c in range_search(x[a0:a1], x[b0:b1], *there, least)]
            back = forth if i == j else [(a0 + c) * len(node) + b0 + r for r, c in range_search(x[b0:b1], x[a0:a1], *here, least)]
            pair = np.unique(np.concatenate([*forth, *back])) if i != j else np.concatenate(forth)
            r, c = pair // len(node), pair % len(node)
            if i == j:  # either of the two has found the other
                pair = np.unique(np.minimum(r, c)[r != c] * len(node) + np.maximum(r, c)[r != c])
                r, c = pair // len(node), pair % len(node)
            count(r, c)
        return _counted(node, links, ea, eb)

    return run


def _alone(least: float):
    """A dimension of few nodes: its graph is built and searched in one task."""

    def run(table):
        node, copies = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "copies"))
        order = np.argsort(node)
        node, copies = node[order], copies[order]
        x = _unit(_matrix(table.column("v"), len(table.column("v")[0]))[order])
        both, medoid = _graph_of(x)
        ends = np.searchsorted(both // len(node), np.arange(len(node) + 1)).astype(np.int32)
        near = _padded(node, pa.ListArray.from_arrays(pa.array(ends), pa.array(node[both % len(node)])))
        r, c = (np.concatenate(p) for p in zip(*range_search(x, x, near, np.flatnonzero(medoid), least), strict=True))
        pair = np.unique(np.minimum(r, c)[r != c] * len(node) + np.maximum(r, c)[r != c])
        r, c, links = pair // len(node), pair % len(node), np.zeros(len(node), np.int64)
        np.add.at(links, r, copies[c])
        np.add.at(links, c, copies[r])
        return _counted(node, links, [node[r]], [node[c]])

    return run


def _parts(width: int, least: float, per_centre: int):
    """Centres for a large shard, from a sample of it; none if they would tear too many links apart."""

    def run(key, table):
        x = _matrix(table.column("v"), width)
        centres = _centres(x, max(2, min(len(x) // 4, (1 << SUB) - 2, round(table.column("n")[0].as_py() / per_centre))))
        own = _own(x, centres, OVERLAP)
        links = lost = 0
        for a in range(0, len(x), 256):
            i, j = np.nonzero(x[a : a + 256] @ x.T >= least)
            i, j = i[i + a != j] + a, j[i + a != j]
            for k in range(0, len(i), 200_000):
                p, q = own[i[k : k + 200_000]], own[j[k : k + 200_000]]
                lost += int((~(p[:, :, None] == q[:, None, :]).any((1, 2))).sum())
            links += len(i)
        torn = lost > MOST_LOST * links
        return pa.table({"shard": pa.array([] if torn else [key[0].as_py()], pa.int64()), "centres": pa.array([] if torn else [centres.reshape(-1).tolist()], pa.list_(pa.float64()))})

    return run


def _cut_shards(index: DataFrame, width: int, least: float, block: int, per_centre: int) -> DataFrame:
    """``index`` with the shards above ``block`` nodes cut by centres of their own, where that is safe."""
    each = index.select("node", "v", F.explode("shards").alias("shard"))
    large = each.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = durable(large)
    if not large.count():
        return index
    some = each.join(large, "shard").where(F.expr(f"pmod(xxhash64(node, 'sample of a shard'), n) < {SUB_SAMPLE}"))  # about SUB_SAMPLE of each
    parts = _parts(width, least, per_centre)
    centres = some.groupBy("shard").applyInArrow(lambda key, table: parts(key, table), "shard long, centres array<double>")
    centres = durable(centres.join(large, "shard").withColumn("pieces", F.expr(f"cast(n div {block} as int) + 1")))

    def again(left, right):
        x = _matrix(left.column("v"), width)
        own = _own(x, _matrix(right.column("centres"), width), OVERLAP)
        shard = np.asarray(left.column("shard").combine_chunks())
        return pa.table({"node": np.repeat(np.asarray(left.column("node").combine_chunks()), own.shape[1]), "shard": (shard[:, None] + 1 + own).reshape(-1)})

    members = each.join(centres.select("shard", "pieces"), "shard").withColumn("piece", F.expr("pmod(xxhash64(node), pieces)"))
    to = centres.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).select("shard", F.col("piece").cast("long").alias("piece"), "centres")
    moved = members.groupBy("shard", "piece").cogroup(to.groupBy("shard", "piece")).applyInArrow(lambda left, right: again(left, right), "node long, shard long")
    kept = each.join(centres.select("shard"), "shard", "left_anti").select("node", "shard")
    shards = kept.unionByName(moved).groupBy("node").agg(F.array_sort(F.collect_list("shard")).alias("shards"))  # OVERLAP squared at most
    return durable(index.drop("shards").join(shards, "node").select("node", "v", "shards", "copies"))


def _of_width(groups: DataFrame, width: int, least: float, block: int, per_centre: int) -> DataFrame:
    """Search results among the nodes of one dimension: counts (node, links) and edges (a, b)."""
    total = groups.count()
    sample = groups.select("node", "v").orderBy(F.xxhash64("v", F.lit("centres")), "node").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows at most
    x = _unit(_matrix(sample.column("v"), width))
    centres = _centres(x, max(1, min(MOST_CENTRES, len(x) // 4, round(total / per_centre))))
    overlap = overlap_for(clusters_needed(groups, width, least, centres))
    if overlap * overlap >= len(centres):
        centres = _centres(x, 1)
    index = groups.select("node", "v").mapInArrow(_assign(centres, overlap), "node long, v array<double>, shards array<long>").join(groups.select("node", "copies"), "node")
    index = _cut_shards(durable(index), width, least, block, per_centre)
    sizes = index.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    pieces = sizes.where("blocks > 1")
    place = F.expr("cast(pmod(xxhash64(node, shard), blocks) as int)")
    blocked = lambda rows: rows.withColumn("shard", F.explode("shards")).join(pieces, "shard", "left").na.fill(1, ["blocks"]).withColumn("block", place)
    graph = blocked(index.select("node", "v", "shards")).select("shard", "block", "node", "v").groupBy("shard", "block").applyInArrow(lambda key, table: _build(width)(key, table), "node long, near array<long>, starts array<long>")
    graph = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.flatten(F.collect_list("starts")).alias("starts"))  # a list for each shard of a node
    tasks = index.join(graph, "node").select("*", F.col("shards").alias("every")).withColumn("shard", F.explode("shards"))
    tasks = tasks.join(pieces, "shard", "left").na.fill(1, ["blocks"]).withColumn("block", place).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tasks = tasks.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "v", F.col("every").alias("shards"), "near", "starts")
    search = _search(width, least)
    return tasks.groupBy("shard", "i", "j").applyInArrow(lambda key, table: search(key, table), _COUNTED)


_COUNTED = "node long, links long, a long, b long"


def near_duplicates(rows: DataFrame, least: float = 0.9, block: int = BLOCK, per_centre: int = NODES_PER_CENTRE) -> DataFrame:
    """Every row of (vec_id, embedding) with n_links, component_id and kept, at cosine ``least`` or more.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
    different dimensions do not link. Equal vectors link. Repeated rows count as vectors of their own.
    A row with a null vec_id links with nothing and has a null component_id.
    Other columns are ignored; an empty table gives an empty result.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.withColumn("v", F.expr(f"case when vec_id is not null and {_FINE} then transform(v, x -> x + 0D) end"))  # one zero
    groups = own.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    groups = durable(groups.withColumn("node", F.monotonically_increasing_id()))
    widths = groups.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    large = [r[0] for r in widths.where(F.col("n") > block).select("width").collect()]  # at most one for each ``block`` nodes
    few = groups.withColumn("width", F.size("v")).where(~F.size("v").isin(large) if large else F.lit(True))
    alone = _alone(least)
    got = few.select("width", "node", "copies", "v").groupBy("width").applyInArrow(lambda table: alone(table.drop(["width"])), _COUNTED)
    for w in large:
        got = got.unionByName(_of_width(groups.where(F.size("v") == w), w, least, block, per_centre))
    got = durable(got)
    counts = got.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    # a node's name among the components is the smallest vec_id of its vector
    a, b = (groups.select(F.col("node").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    edges = got.where("a is not null").select("a", "b").join(a, "a").join(b, "b").select("least_a", "least_b")
    roots = connected_components(edges).withColumnRenamed("node", "least")
    named = groups.join(roots, "least", "left").join(counts, "node", "left").select("v", F.coalesce("root", "least").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    done = own.join(named, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(rows: DataFrame, result: DataFrame, least: float = 0.9, every: int = 50, block: int = BLOCK) -> float:
    """Links found, as a share of those that brute force finds for each vector whose id is divisible by ``every``.

    The queries are compared with all rows of their dimension, a block of each in a task; only sums come to the driver. 1.0 where there are no links.
    """
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(f"vec_id is not null and {_FINE}").withColumn("width", F.size("v"))
    queries = own.where(F.col("vec_id") % every == 0)
    n, m = -(-own.count() // block) or 1, -(-queries.count() // block) or 1
    left = queries.withColumn("i", F.expr(f"pmod(xxhash64(vec_id, 'query'), {m})")).withColumn("j", F.explode(F.expr(f"sequence(0L, {n - 1}L)")))
    right = own.withColumn("j", F.expr(f"pmod(xxhash64(vec_id, 'row'), {n})")).withColumn("i", F.explode(F.expr(f"sequence(0L, {m - 1}L)")))

    def count(q, r):
        if not q.num_rows or not r.num_rows:
            return pa.table({"vec_id": _none(0), "n": _none(0)})
        width = len(q.column("v")[0])
        ids, others = (np.asarray(t.column("vec_id").combine_chunks()) for t in (q, r))
        found = (_unit(_matrix(q.column("v"), width)) @ _unit(_matrix(r.column("v"), width)).T >= least).sum(1)
        return pa.table({"vec_id": ids, "n": found.astype(np.int64) - np.isin(ids, others)})

    key = ("width", "i", "j")
    true = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda q, r: count(q, r), "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = true.join(result, "vec_id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return got[0] / got[1] if got[1] else 1.0
