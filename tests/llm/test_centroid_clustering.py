"""Centroid clustering against whole-number brute force and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from shotloom.llm import centroid_clustering as cc


def brute(rows, k=40, rounds=5, dim=64):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(x) for x in zip(*groups[j], strict=True)] if j in groups else w for j, w in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


def run(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, v string, n int").repartition(3)
    return [tuple(r) for r in cc.cluster_vectors(df, **more).collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 64))
    x = [(i, (centres[i % 9] + rng.normal(scale=0.3, size=64)).astype(np.float32).tolist()) for i in range(180)]
    hot = x[5][1]
    odd = [None, [], [1.0], [0.0] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [0.0] * 64, [-0.001] * 64, [1.0 / 256] * 64]
    return x + [(1000 + i, hot) for i in range(120)] + [(2000 + i, v) for i, v in enumerate(odd)] + [x[0], x[0], (x[0][0], x[1][1]), (None, x[2][1]), (None, None)]


def test_against_brute_force(spark, rows):
    same(run(spark, rows), brute(rows))


def test_groups_of_any_share_come_back(spark, rows, monkeypatch):
    monkeypatch.setattr(cc, "HOT", 0)  # no group is large: all meet by digest
    same(run(spark, rows), brute(rows))
    monkeypatch.setattr(cc, "HOT", 10**9)  # all are
    same(run(spark, rows), brute(rows))


def test_few_and_no_vectors_ties_and_empty_centroids(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [1.0])]) == []
    few = [(i, [float(i % 3)] + [0.0] * 63) for i in range(7)]  # equal centroids: the smaller number wins, the others stay empty
    same(run(spark, few), brute(few))


def test_large_components_are_exact_and_bounded(spark):
    rng = random.Random(4)
    far = [(i, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(0, 7) for _ in range(64)]) for i in range(60)] + [(99, [1e300] * 64), (100, [-1e300] * 64)]
    same(run(spark, far, "double"), brute(far))


def test_nearest_is_the_same_in_both_ways():
    rng = np.random.default_rng(5)
    v, c = rng.integers(-500, 500, (50, 64)), rng.integers(-500, 500, (7, 64))
    at, d = cc.nearest(v, c)
    exact = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert (d == exact.min(1)).all() and (at == exact.argmin(1)).all()
    shifted = cc.nearest(v + (1 << 26), c + (1 << 26))
    assert (shifted[0] == at).all() and (shifted[1] == d).all()
