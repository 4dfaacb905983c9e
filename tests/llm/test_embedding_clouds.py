"""Embedding near duplicates in clouds without separate clusters."""

import numpy as np
import pytest

from shotloom.llm import embedding_near_dedup as nd


@pytest.mark.parametrize(("n", "dim", "shift"), [(4000, 16, 1.3), (5000, 24, 1.5), (3000, 3, 0.0)])
def test_links_across_clusters_are_kept(spark, n, dim, shift):
    x = np.random.default_rng(dim).normal(size=(n, dim)) + shift
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(1) - 1 for a in range(0, n, 1000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.zeros(n, int)
    for r in nd.near_duplicates(df, block=1000, per_centre=200).select("vec_id", "n_links").collect():
        got[r.vec_id] = r.n_links
    assert true.sum() > 5000 and (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_how_many_clusters_a_node_needs():
    assert nd.overlap_for([10, 0, 0, 0, 0]) == 3 and nd.overlap_for([0, 0, 0, 0, 7]) == 5 and nd.overlap_for([0] * 6) == 3
    assert nd.overlap_for([0, 0, 0, 999_500, 500]) == 4 and nd.overlap_for([0, 0, 0, 990, 10]) == 5
