"""Connected components as Spark jobs, and the checkpoint folder they cut lineage with."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = 4


def checkpoint_folder(master: str, named: str | None) -> str:
    """The folder that the cluster names; one of this machine's own only where everything runs on it."""
    if named:
        return named
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def durable(df: DataFrame, few: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, and read from there.

    ``few``: in at most ``FILES`` files for each core. Where Hadoop has no native library, every file starts processes that set its
    permissions; until such a process runs its own program it shares all memory of the executor, which then seems to hold twice as much.
    """
    shared_folder(df.sparkSession)
    return (df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism) if few else df).checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of steps that are over, which it does only once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it isn't yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(sc.master, spark.conf.get("spark.checkpoint.dir", None)))
    return sc._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder name in the checkpoint folder; what is written there goes at the end."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of each batch by a star per component that the batch connects."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = np.arange(len(ids))
        x, y = flat[: len(a)], flat[len(a) :]
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        while (root[root] != root).any():
            root = root[root]
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns): root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change. Each step
    is a grouped minimum (partially aggregated, so a hub costs one row per task) joined back, with lineage cut in
    the checkpoint folder. Nulls and self-loops are dropped; an empty input gives an empty result.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = durable(e.mapInArrow(contract, "a long, b long").distinct(), few=True)
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # large star: every larger neighbour of a points to the smallest one
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: a and its smaller neighbours point to the smallest one
        small = e.groupBy("a").agg(F.min("b").alias("low"))
        e = e.join(small, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = durable(e, few=True)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
