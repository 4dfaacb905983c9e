"""The folder that all executors share: where lineage is cut and scratch tables are written."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(master: str, named: str | None) -> str:
    """The folder that the cluster names; one of this machine's own only where everything runs on it."""
    if named:
        return named
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set if it isn't yet."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_folder(sc.master, spark.conf.get("spark.checkpoint.dir", None)))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, path: str):
    """A path as the JVM's file system and its own name in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_scratch(spark: SparkSession) -> str:
    """A name for a new folder in the shared one."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A name for a new folder in the shared one; what is written there goes at the end."""
    path = new_scratch(spark)
    try:
        yield path
    finally:
        fs, at = place(spark, path)
        fs.delete(at, True)
