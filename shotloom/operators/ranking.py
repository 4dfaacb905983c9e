"""Ranking by shared tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEALT = 4096  # documents of a task that counts
HELD = 200_000  # pairs that a task gathers before it drops those that can't be among the best


def shared_tokens(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, shared): how many tokens each document and item have in common, if any.

    ``docs`` has doc_id and tokens, ``items`` item_id and tokens (arrays of distinct strings). Documents are dealt out, ``DEALT`` to a task, and
    counted where they are: what a task holds is pairs of that many documents with the items, whatever the size of the files.
    """
    asked = items.select("item_id", F.explode("tokens").alias("t"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DEALT))
    return docs.select("doc_id", "tokens").repartition(parts, "doc_id").select("doc_id", F.explode("tokens").alias("t")).join(asked, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


def top_overlap(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, doc_id, shared, rank): the ``k`` documents that share most tokens with each item, ties by doc_id."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return shared_tokens(docs, items).withColumn("rank", rank).where(F.col("rank") <= k)


def strong_overlaps(docs: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """(item_id, n_strong): documents that share ``least`` tokens or more with an item."""
    return shared_tokens(docs, items).where(F.col("shared") >= least).groupBy("item_id").agg(F.count("*").alias("n_strong"))


def top_and_strong(docs: DataFrame, items: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """``top_overlap`` with n_strong, the number of documents that share ``least`` tokens or more with the item; the documents are read once.

    Each task gives out, for an item, its ``k`` best pairs and one count.
    """

    def best(item: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((doc, -n, item))
        item, doc, n = item[order], doc[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        keep = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item)))) < k
        return item[keep], doc[keep], n[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, strong = [], 0, {}
        for batch in batches:
            item, doc, n = (np.asarray(batch.column(i)) for i in range(3))
            for i, c in zip(*np.unique(item[n >= least], return_counts=True), strict=True):
                strong[int(i)] = strong.get(int(i), 0) + int(c)
            held.append((item, doc, n))
            size += len(item)
            if size > HELD:
                held = [best(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
        if size:
            item, doc, n = best(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc), pa.array(n), pa.nulls(len(item), pa.int64())], names=["item_id", "doc_id", "shared", "strong"])
        if strong:
            blank = pa.nulls(len(strong), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(strong), pa.int64()), blank, blank, pa.array(list(strong.values()), pa.int64())], names=["item_id", "doc_id", "shared", "strong"])

    parts = shared_tokens(docs, items).select(*(F.col(c).cast("long").alias(c) for c in ("item_id", "doc_id", "shared"))).mapInArrow(run, "item_id long, doc_id long, shared long, strong long")
    item = Window.partitionBy("item_id")
    rows = parts.withColumn("n_strong", F.coalesce(F.sum("strong").over(item), F.lit(0))).withColumn("rank", F.row_number().over(item.orderBy(F.col("doc_id").isNull(), F.desc("shared"), "doc_id")))
    return rows.where((F.col("rank") <= k) & F.col("doc_id").isNotNull()).drop("strong")
