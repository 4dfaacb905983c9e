"""Centroid clustering of quantised vectors, equal ones as one with a multiplicity.

Components become whole numbers, equal vectors are grouped with their number, and Lloyd's rounds run over the different ones. A task adds up
vector times multiplicity for each centroid and gives out one row per centroid; Spark adds these, so the driver sees ``k`` centroids
whatever the number of vectors. All sums, quotients and distances are exact. At the end each vector takes the assignment of its group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import durable

DIM, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 27  # of a quantised component: squared distances of 64 components stay below 2**63
MOST = (1 << 63) - 1
HOT = 1000  # groups with more than this share (1 / HOT) of the vectors, so fewer than HOT groups, are joined by broadcast


def quantised(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the fit vectors: floor(256 x) of each component, taken as double and bounded by 2**27 either way."""
    x = F.col("embedding")
    fit = x.isNotNull() & (F.size(x) == dim) & F.expr("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    whole = F.expr(f"transform(embedding, x -> cast(floor(greatest(-{LARGEST}D, least({LARGEST}D, {SCALE}D * cast(x as double)))) as int))")
    return embeddings.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equally near ones the smallest) and the squared distance, exact."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * top * top < 1 << 53:  # then doubles hold every term and sum exactly
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        d = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((v.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).reshape(-1, dim)


def _sums(groups: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors: how many, and their sum."""
    dim = len(centroids[0])
    c = np.array(centroids, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for batch in batches:
            v, m = _matrix(batch, dim), np.asarray(batch.column("n"))
            at, _ = nearest(v, c)
            np.add.at(n, at, m)
            np.add.at(total, at, v * m[:, None])
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on]), pa.array(list(total[on]), pa.list_(pa.int64()))], names=["k", "n", "total"])

    parts = groups.select("v", "n").mapInArrow(add, "k long, n long, total array<long>")
    summed = parts.select("k", F.posexplode(F.expr("array_prepend(total, n)")).alias("i", "x")).groupBy("k", "i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()
    rows: dict[int, list[int]] = {}
    for r in sorted(summed, key=lambda r: (r["k"], r["i"])):
        rows.setdefault(r["k"], []).append(int(r["x"]))
    return {k: (x[0], x[1:]) for k, x in rows.items()}


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = "2") -> list[list[int]]:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest SHA-256, ascending; of rows of one id the lesser vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()]


def lloyd(groups: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` over ``groups`` (v, n): each with vectors becomes the floor of their mean, the others stay."""
    for _ in range(rounds):
        found = _sums(groups, centroids)
        centroids = [[x // found[k][0] for x in found[k][1]] if k in found else c for k, c in enumerate(centroids)]
    return centroids


def cluster_vectors(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each fit vector of ``embeddings`` (vec_id, embedding).

    Vectors that are null, of another dimension or hold null or non-finite components are left out. Components beyond 2**19 in size count as 2**19, so that distances
    fit a long; inertias beyond a long are its largest number. A null vec_id hashes as an empty one; repeated rows count and come back as often; rows of
    one id are vectors of their own; other columns are ignored; fewer than ``k`` vectors are as many centroids; no fit vector gives no rows.
    """
    vectors = quantised(embeddings, dim)
    keyed = vectors.withColumn("digest", F.unhex(F.sha2(F.array_join("v", ","), 256)))
    groups = durable(keyed.groupBy("digest", "v").agg(F.count("*").alias("n")))
    centroids = lloyd(groups, start, rounds) if (start := first_centroids(vectors, k)) else []
    c = np.array(centroids, np.int64).reshape(-1, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = nearest(_matrix(batch, dim), c)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(at.astype(np.int32)), pa.array(d)], names=["digest", "n", "cluster", "distance"])

    found = durable(groups.select("v", "digest", "n").mapInArrow(assign, "digest binary, n long, cluster int, distance long"))
    weighed = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    sums = {r["cluster"]: (int(r["s"]), r["m"]) for r in found.groupBy("cluster").agg(weighed.alias("s"), F.sum("n").alias("m")).collect()}
    number, inertia = sum(m for _, m in sums.values()), min(MOST, sum(s for s, _ in sums.values()))
    report = [(i, min(MOST, s), inertia, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, (s, _) in sums.items()]
    report = embeddings.sparkSession.createDataFrame(report, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    # groups so large that their vectors would fill a join task come to the vectors, the others meet them by digest
    large = F.col("n") * HOT > number
    rows = keyed.select("vec_id", "digest").join(F.broadcast(found.where(large).drop("n")), "digest", "left")
    rest = rows.where("cluster is null").select("vec_id", "digest").join(found.where(~large).drop("n"), "digest")
    rows = rows.where("cluster is not null").select("vec_id", "cluster", "distance").unionByName(rest.select("vec_id", "cluster", "distance"))
    return rows.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    near = "(select vec_id, v, arg_min(k, (d, k)) as k, min(d) as d from (select vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from q cross join c{i}) group by all)"
    steps = [
        f"""s{i} as materialized (select k, j, sum(x) as s, count(*) as n from (select k, generate_subscripts(v, 1) as j, unnest(v) as x from {near.format(i=i)}) group by all),
c{i + 1} as materialized (select c{i}.k, coalesce(m.c, c{i}.c) as c from c{i} left join (select k, list(((s - (s % n + n) % n) // n)::bigint order by j) as c from s{i} group by k) m using (k))"""
        for i in range(rounds)
    ]
    return f"""
with q as materialized (select vec_id, list_transform(embedding::double[], lambda x: floor({SCALE} * x)::bigint) as v from embeddings where embedding is not null and len(embedding) = {DIM} and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as k, v as c from q qualify k < {k}),
{", ".join(steps)},
a as {near.format(i=rounds)}
select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a join c{rounds} using (k)
"""


SQL = _sql()
