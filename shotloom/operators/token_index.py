"""A stored index of tokens: for each token the documents that have it, in blocks of neighbouring ids.

A posting is a row per token and block, so no row grows with the number of documents. How many of an item's tokens have a posting in a block bounds what any document of the block can
share with it; blocks are taken by that bound, and those whose bound can't reach an item's k-th best are never opened. Bounds come from two columns, without the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import snapshots
from ..sources.folders import durable

BUCKETS, BLOCK = 64, 1024  # of tokens; of documents
FIRST = 8  # blocks of an item that are opened before the k-th best is known


def _postings(docs: DataFrame, buckets: int, block: int) -> DataFrame:
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("tokens").alias("t")).where("t is not null")
    rows = rows.groupBy("t", F.floor(F.col("doc_id") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))  # a block's ids at most
    return rows.withColumn("bucket", _bucket("t", buckets))


def _bucket(token: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_token_index(docs: DataFrame, path: str, buckets: int = BUCKETS, block: int = BLOCK) -> int:
    """Writes an index of ``docs`` (doc_id, tokens) and gives its version. Rows of one doc_id are one document; those without an id or tokens are left out."""
    return snapshots.publish(_postings(docs, buckets, block), path, None, {"buckets": buckets, "block": block})


def upsert_tokens(docs: DataFrame, path: str, token: str | None = None) -> int:
    """Adds documents or replaces their tokens (an empty array takes a document out); only buckets that change are written."""
    spark = docs.sparkSession
    meta = snapshots.manifest(spark, path)["meta"]
    new = durable(_postings(docs, meta["buckets"], meta["block"]))
    size = meta["block"]
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    places = ids.groupBy(F.floor(F.col("doc_id") / size).cast("long").alias("block")).agg(F.collect_list(F.pmod("doc_id", F.lit(size)).cast("int")).alias("places"))
    # one flag for each place of a block, so that an id of a posting is looked up, whatever the number of ids that go
    gone = durable(places.select("block", F.expr(f"transform(sequence(0, {size - 1}), i -> array_contains(places, i))").alias("gone")))
    stays = F.expr(f"filter(ids, i -> not gone[cast(pmod(i, {size}) as int)])")
    touched = {r[0] for r in new.select("bucket").distinct().collect()}  # of as many as there are buckets
    others = [b for b in range(meta["buckets"]) if b not in touched]
    if others:  # buckets without new postings change only where documents go
        touched |= {r[0] for r in snapshots.load(spark, path, others).join(gone, "block").where(F.size(stays) < F.size("ids")).select("bucket").distinct().collect()}
    old = snapshots.load(spark, path, touched)
    same = old.join(gone.select("block"), "block", "left_anti").select("t", "block", "ids", "bucket")
    kept = old.join(gone, "block").select("t", "block", stays.alias("ids"), "bucket")
    rows = kept.unionByName(new).groupBy("t", "block", "bucket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).where(F.size("ids") > 0)
    rows = rows.unionByName(same)
    return snapshots.publish(rows.select("t", "block", "ids", "bucket"), path, touched, None, token)


def _opened(spark: SparkSession, path: str, asked: DataFrame) -> tuple[DataFrame, int]:
    """The postings of the buckets that ``asked`` (t) needs, and the documents of a block."""
    found = snapshots.manifest(spark, path)
    if found is None:
        raise ValueError(f"no index at {path}")
    wanted = [r[0] for r in asked.select(_bucket("t", found["meta"]["buckets"]).alias("b")).distinct().collect()]  # of as many as there are buckets
    return snapshots.load(spark, path, wanted, found["version"]).drop("bucket"), found["meta"]["block"]


def indexed_overlap(spark: SparkSession, path: str, items: DataFrame, k: int = 10, first: int = FIRST, read: list | None = None) -> DataFrame:
    """(item_id, doc_id, shared, rank): the ``k`` documents of the index that share most tokens with each of ``items`` (item_id, tokens), ties by doc_id.

    ``read`` gets the (item_id, block) frames of the blocks opened.
    """
    asked = items.select("item_id", F.explode("tokens").alias("t")).distinct()
    posts, block = _opened(spark, path, asked)
    bounds = durable(posts.select("t", "block").join(asked, "t").groupBy("item_id", "block").agg(F.count("*").alias("bound")))

    def counted(some: DataFrame) -> DataFrame:
        rows = posts.join(asked, "t").join(some.select("item_id", "block"), ["item_id", "block"])
        return rows.select("item_id", F.explode("ids").alias("doc_id")).groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))).where(F.col("rank") <= k)

    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "block"))
    begin = durable(bounds.withColumn("n", order).where(F.col("n") <= first).drop("n"))
    found = durable(best(counted(begin)))
    kth = found.where(F.col("rank") == k).select("item_id", F.col("shared").alias("least"), F.col("doc_id").alias("last"))
    rest = bounds.join(begin, ["item_id", "block"], "left_anti").join(kth, "item_id", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") > F.col("least")) | ((F.col("bound") == F.col("least")) & (F.col("block") * block < F.col("last"))))
    rest = durable(rest.select("item_id", "block", "bound"))
    if read is not None:
        read.append(begin.unionByName(rest).select("item_id", "block"))
    return best(found.drop("rank").unionByName(counted(rest)))


def indexed_fulltext(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """doc_id of the documents of the index that have all of ``words``; only blocks in which each word occurs are opened. No words find nothing."""
    asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "t string")
    posts, _ = _opened(spark, path, asked)
    n = len(set(words))
    hits = posts.join(asked, "t")
    whole = hits.select("t", "block").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == n).select("block")
    return hits.join(whole, "block", "left_semi").select(F.explode("ids").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == n).select("doc_id")
