"""Versioned tables and the stored vector index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import vector_index, vectors
from shotloom.sources import snapshots

SPANS = "video_id long, ord long, v long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def stored(spark, path, **more):
    return rows(snapshots.read(spark, path, **more), "video_id", "ord", "v")


def test_upsert_purge_and_remove(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.manifest(spark, path) is None
    assert snapshots.upsert(spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 5), (None, 0, 0)], SPANS), path, ["video_id", "ord"], "v", buckets=4) == 1
    assert snapshots.upsert(spark.createDataFrame([(1, 1, 2), (2, 0, 4), (3, 0, 1)], SPANS), path, ["video_id", "ord"], "v") == 2
    want = [(1, 0, 1), (1, 1, 2), (2, 0, 5), (3, 0, 1)]
    assert sorted((r for r in map(tuple, snapshots.read(spark, path).collect()) if r[0] is not None)) == want
    for version in (3, 4):
        assert snapshots.purge_and_insert(spark.createDataFrame([(1, 9, 9), (None, 1, 1)], SPANS), path) == version
    assert snapshots.remove(spark.createDataFrame([(2,), (77,), (None,)], "video_id long"), path) == 5
    assert [tuple(r) for r in snapshots.read(spark, path).where("video_id is not null").orderBy("video_id").collect()] == [(1, 9, 9), (3, 0, 1)]
    assert snapshots.read(spark, path, version=2).where("video_id is not null").count() == 4  # an old version stays readable
    assert snapshots.vacuum(spark, path, keep=1) and snapshots.read(spark, path).count() == 2  # the null video is gone too
    assert snapshots.vacuum(spark, path, keep=1) == []


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    first = spark.createDataFrame([(i, 0, 1) for i in range(40)], SPANS)
    snapshots.upsert(first, path, ["video_id", "ord"], "v", buckets=8)
    boom = F.when(F.col("video_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit(2)).cast("long")
    with pytest.raises(Exception, match="lost"):  # some buckets are written by then
        snapshots.upsert(first.withColumn("v", boom), path, ["video_id", "ord"], "v")
    assert stored(spark, path) == [(i, 0, 1) for i in range(40)] and snapshots.manifest(spark, path)["version"] == 1
    # a manifest that its writer did not finish counts as none, and is written over
    (tmp_path / "t" / "versions" / "0000000002").write_text('{"version": 2, "buck')
    assert stored(spark, path) == [(i, 0, 1) for i in range(40)]
    assert snapshots.upsert(first.withColumn("v", F.lit(3).cast("long")), path, ["video_id", "ord"], "v") == 2
    assert stored(spark, path) == [(i, 0, 3) for i in range(40)]
    assert len(snapshots.vacuum(spark, path, keep=1)) >= 1 and stored(spark, path) == [(i, 0, 3) for i in range(40)]


def test_a_replayed_batch_counts_once_and_writers_do_not_overlap(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batch = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], SPANS)
    assert [snapshots.purge_and_insert(batch, path, token=t) for t in ("b0", "b0", "b1", "b0")] == [1, 1, 2, 2]
    text = (tmp_path / "t" / "versions" / "0000000002").read_text()
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots._put(spark, f"{path}/versions/0000000002", text)
    assert stored(spark, path) == [(1, 0, 1), (2, 0, 1)]


def test_an_emptied_table_keeps_its_columns(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.purge_and_insert(spark.createDataFrame([(1, 0, 1)], SPANS), path)
    snapshots.remove(spark.createDataFrame([(1,)], "video_id long"), path)
    assert stored(spark, path) == [] and snapshots.read(spark, path).columns == ["video_id", "ord", "v"]


# --- index -------------------------------------------------------------------------------------------------------


def clustered(n, dim=16, groups=30, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))).astype(np.float64)


@pytest.fixture(scope="module")
def items(spark):
    x = clustered(3000)
    made = [(i, v.tolist(), i % 7) for i, v in enumerate(x)] + [(9000, None, 0), (9001, [0.0] * 16, 1), (9002, [1.0, 2.0], 0), (9003, x[5].tolist(), 3), (9004, x[5].tolist(), 3)]
    return spark.createDataFrame(made, "item_id long, vector array<double>, part int").repartition(6).cache()


@pytest.fixture(scope="module")
def questions(spark, items):
    some = items.where("item_id % 150 = 0 and size(vector) = 16").select(F.col("item_id").alias("q_id"), "vector")
    return some.unionByName(spark.createDataFrame([(-1, [0.0] * 16), (-2, None), (-3, [-1.0] * 16)], "q_id long, vector array<double>")).cache()


def hits(df):
    return sorted((r.q_id, r["rank"], r.item_id, round(r.score, 9)) for r in df.collect())


def exact(items, questions, k, where="true"):
    return hits(vectors.top_k(items.where(where).where("size(vector) = 16"), questions, k))


def test_the_index_gives_what_a_scan_gives_and_reads_less(spark, items, questions, tmp_path):
    path, read = f"file://{tmp_path}/index", []
    vector_index.build_index(items, path)
    real = questions.where("q_id >= 0")
    assert hits(vector_index.search_index(spark, path, real, 10, read=read)) == exact(items, real, 10)
    cells = snapshots.manifest(spark, path)["meta"]["cells"]
    sizes = spark.createDataFrame([(int(b), n) for b, (n, _) in cells.items()], "bucket int, n long")
    seen = [r[0] for r in read[0].join(sizes, "bucket").groupBy("q_id").agg(F.sum("n")).select("sum(n)").collect()]
    assert len(seen) == real.count() and max(seen) < 3002 / 3 and sum(seen) / len(seen) < 3002 / 10
    assert hits(vector_index.search_index(spark, path, questions, 5)) == exact(items, questions, 5)  # also zero and far questions
    for where in ("part = 3", "part in (1, 2) and item_id > 1000", "part = 99"):
        assert hits(vector_index.search_index(spark, path, questions, 10, where)) == exact(items, questions, 10, where)
    few = hits(vector_index.search_index(spark, path, real, 10, probes=5, exact=False))
    assert len(set(few) & set(exact(items, real, 10))) >= 0.99 * len(exact(items, real, 10))


def test_spread_out_vectors_and_large_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ITEM_BLOCK", 50)
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 24)))], "item_id long, vector array<double>")
    q = x.where("item_id < 20").select(F.col("item_id").alias("q_id"), "vector")
    path = f"file://{tmp_path}/index"
    vector_index.build_index(x, path, cells=5)
    assert hits(vector_index.search_index(spark, path, q, 7, probes=1)) == hits(vectors.top_k(x, q, 7))


def test_upserted_items_are_found_and_replaced_ones_gone(spark, items, questions, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build_index(items.where("item_id % 3 > 0"), path)
    moved = items.where("item_id % 3 = 0").unionByName(items.where("item_id % 10 = 1 and item_id % 3 > 0").withColumn("vector", F.expr("transform(vector, x -> -x)")).withColumn("part", F.lit(50)))
    before = snapshots.manifest(spark, path)["version"]
    assert vector_index.upsert_index(moved, path, token="a") == before + 1 == vector_index.upsert_index(moved, path, token="a")
    now = items.join(moved.select("item_id"), "item_id", "left_anti").unionByName(moved)
    assert snapshots.read(spark, path).count() == now.where("size(vector) = 16").count()
    assert hits(vector_index.search_index(spark, path, questions, 10)) == exact(now, questions, 10)
    assert hits(vector_index.search_index(spark, path, questions, 10, "part = 50")) == exact(now, questions, 10, "part = 50")


def test_no_vectors_no_cells(spark, questions, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build_index(spark.createDataFrame([(1, None)], "item_id long, vector array<double>"), path)
    assert vector_index.search_index(spark, path, questions, 3).collect() == []
    with pytest.raises(ValueError):
        vector_index.search_index(spark, f"{path}x", questions, 3)


# --- tokens ------------------------------------------------------------------------------------------------------


def worded(spark, n=600, seed=3):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    topics = [rng.sample(words, 12) for _ in range(n // 20)]  # neighbours share a topic
    rows = [(i, sorted(set(rng.sample(topics[i // 20], 6) + rng.choices(words[:20], k=1)))) for i in range(n)] + [(-7, ["w1", "w2"]), (n, None), (n + 1, []), (None, ["w1"]), (3, ["w199"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4)


def merged(docs):
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))


def test_overlap_by_the_index_is_that_of_all_documents(spark, tmp_path):
    from shotloom.operators import ranking, token_index

    docs, path = worded(spark), f"file://{tmp_path}/tokens"
    items = docs.where("doc_id % 90 = 0 or doc_id = 3").select(F.col("doc_id").alias("item_id"), "tokens").unionByName(spark.createDataFrame([(9000, ["nowhere"]), (9001, []), (9002, ["w1", "nowhere"])], "item_id long, tokens array<string>"))
    items = items.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    token_index.build_token_index(docs, path, buckets=5, block=16)
    rows_of = lambda df: rows(df, "item_id", "rank", "doc_id", "shared")
    for first in (1, 8):
        read = []
        got = rows_of(token_index.indexed_overlap(spark, path, items, 5, first, read))
        assert got == rows_of(ranking.top_overlap(merged(docs), items, 5)) and len(got) > 35
        bounded = read[0].join(items.where("item_id < 9000"), "item_id").count() / items.where("item_id < 9000").count()
        assert bounded < 39 / 2  # of 39 blocks
    # replaced and new documents
    new = spark.createDataFrame([(0, ["w3", "w4"]), (90, []), (5000, ["w1", "w2", "w3", "w4", "w5"]), (91, ["w199", "w3"])], "doc_id long, tokens array<string>")
    version = token_index.upsert_tokens(new, path, token="t")
    assert token_index.upsert_tokens(new, path, token="t") == version
    now = merged(docs).join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)
    assert rows_of(token_index.indexed_overlap(spark, path, items, 5)) == rows_of(ranking.top_overlap(now, items, 5))
    for words in (["w1", "w2"], ["w3", "w4", "w3"], ["w1", "nowhere"], ["w199"]):
        want = sorted(r.doc_id for r in now.collect() if r.tokens is not None and set(words) <= set(r.tokens))
        assert sorted(r.doc_id for r in token_index.indexed_fulltext(spark, path, words).collect()) == want
    assert token_index.indexed_fulltext(spark, path, []).collect() == []


def test_a_stream_into_a_versioned_table(spark, tmp_path):
    from shotloom.streaming import reindex as streaming

    source, path = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for v in (1, 2, 3):
        spark.createDataFrame([(1, v % 3, v), (v, 7, v)], SPANS).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SPANS).parquet(source)
        streaming.reindex(stream, path, str(tmp_path / "cp"), lambda df: df.withColumn("v", F.col("v") * 10), versioned=True).awaitTermination(120)
    assert stored(spark, path) == [(1, 0, 30), (1, 1, 10), (1, 2, 20), (1, 7, 10), (2, 7, 20), (3, 7, 30)]
    assert snapshots.manifest(spark, path)["version"] == 3 and len(snapshots.manifest(spark, path)["tokens"]) == 3


def test_an_upsert_looks_ids_up_and_leaves_other_blocks_and_buckets(spark, tmp_path):
    from shotloom.operators import token_index

    path = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame([(i, ["all", f"w{i % 9}"]) for i in range(-20, 60)], "doc_id long, tokens array<string>")
    token_index.build_token_index(docs, path, buckets=16, block=8)
    before = snapshots.manifest(spark, path)["buckets"]
    token_index.upsert_tokens(spark.createDataFrame([(-3, ["w1"]), (5, []), (200, ["w1"])], "doc_id long, tokens array<string>"), path)
    got = sorted((r.t, i) for r in snapshots.read(spark, path).collect() for i in r.ids)
    want = [(t, i) for i in range(-20, 60) if i not in (-3, 5) for t in ("all", f"w{i % 9}")] + [("w1", -3), ("w1", 200)]
    assert got == sorted(want)
    after = snapshots.manifest(spark, path)["buckets"]
    assert any(after[b] == before[b] for b in before) and any(after[b] != before[b] for b in before)
