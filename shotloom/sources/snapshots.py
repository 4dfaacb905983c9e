"""Tables as versions: runs of bucket folders, and one manifest per version that is written last.

A write puts the buckets it replaces into a run folder of its own and then publishes a manifest that names, for each bucket, the run to read. Readers
resolve the newest whole manifest, so they see a version or the one before, never a mixture; a job that fails leaves the old version and a
run that no manifest names (``vacuum`` removes those). Two writers at once: the second to publish a number fails and can begin anew.
A write with a ``token`` that the table has seen changes nothing, so a replayed batch counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .folders import place
from .sinks import BUCKETS, _file_of, last_writer

TOKENS = 1000  # of the last writes, kept in the manifest


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _load(spark: SparkSession, path: str) -> dict | None:
    fs, at = place(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:  # a writer died in it
        return None
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest whole manifest of the table at ``path`` (or that of ``version``); None if there is none."""
    for name in reversed(_names(spark, f"{path}/versions")):
        if version is None or int(name) == version:
            found = _load(spark, f"{path}/versions/{name}")
            if found is not None:
                return found
    return None


def load(spark: SparkSession, path: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
    """The rows of the table with their ``bucket``; only those of ``buckets``, if given."""
    found = manifest(spark, path, version)
    if found is None:
        raise ValueError(f"no table at {path}")
    schema = StructType([*StructType.fromJson(found["schema"]).fields, StructField("bucket", IntegerType())])
    wanted = None if buckets is None else {str(b) for b in buckets}
    folders = [f"{path}/data/run={run}/bucket={b}" for b, run in found["buckets"].items() if wanted is None or b in wanted]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return load(spark, path, version=version).drop("bucket")


def publish(rows: DataFrame, path: str, touched: Iterable[int] | None = None, meta: dict | None = None, token: str | None = None) -> int:
    """Writes ``rows`` (with an int ``bucket``) as the new content of the ``touched`` buckets (None: of all there are) and gives the new version.

    A touched bucket without rows becomes empty. ``meta`` is merged into what the manifest keeps beside.
    """
    spark = rows.sparkSession
    old = manifest(spark, path) or {"version": 0, "buckets": {}, "meta": {}, "tokens": []}
    if token is not None and token in old["tokens"]:
        return old["version"]
    run = uuid.uuid4().hex
    body = [c for c in rows.columns if c != "bucket"]
    rows.repartition("bucket", _file_of(rows)).write.partitionBy("bucket").parquet(f"{path}/data/run={run}")
    written = {n.removeprefix("bucket=") for n in _names(spark, f"{path}/data/run={run}") if n.startswith("bucket=")}
    kept = {} if touched is None else {b: r for b, r in old["buckets"].items() if b not in {str(t) for t in touched}}
    new = {
        "version": old["version"] + 1,
        "schema": json.loads(rows.select(*body).schema.json()),
        "buckets": kept | dict.fromkeys(sorted(written, key=int), run),
        "meta": old["meta"] | (meta or {}),
        "tokens": [*old["tokens"], *([token] if token is not None else [])][-TOKENS:],
    }
    _put(spark, f"{path}/versions/{new['version']:010d}", json.dumps(new))
    return new["version"]


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = place(spark, path)
    if fs.exists(at) and _load(spark, path) is None:
        fs.delete(at, False)  # what a dead writer left
    try:
        stream = fs.create(at, False)
    except Exception as error:
        raise RuntimeError(f"another writer has published {path}") from error
    stream.write(bytearray(text.encode()))
    stream.close()


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({by}), {buckets}) as int)"))


def _numbers(df: DataFrame) -> list[int]:
    """The buckets of ``df``, as many as the table has at most."""
    return [r[0] for r in df.select("bucket").distinct().collect()]


def _others(stored: DataFrame, named: DataFrame, by: str) -> DataFrame:
    """What is stored of videos that ``named`` has no row of; a null is a video too."""
    return stored.join(named.select(F.col(by).alias("_by")).distinct(), F.col(by).eqNullSafe(F.col("_by")), "left_anti")


def _begin(spark: SparkSession, path: str, token: str | None, buckets: int) -> tuple[dict | None, int, bool]:
    found = manifest(spark, path)
    if found is None:
        return None, buckets, False
    return found, found["meta"].get("n", buckets), token is not None and token in found["tokens"]


def upsert(new: DataFrame, path: str, key: list[str], version: str, by: str = "video_id", buckets: int = BUCKETS, token: str | None = None) -> int:
    """Adds rows; of a ``key`` the row with the largest ``version`` stays, of equal ones the new one. The keys must hold ``by``."""
    spark = new.sparkSession
    found, n, done = _begin(spark, path, token, buckets)
    if done:
        return found["version"]
    rows = _bucketed(new, by, n)
    touched = _numbers(rows)
    stored = load(spark, path, touched) if found else rows.limit(0)
    return publish(last_writer(stored, rows, key, version), path, touched, {"n": n}, token)


def purge_and_insert(new: DataFrame, path: str, by: str = "video_id", buckets: int = BUCKETS, token: str | None = None) -> int:
    """What is stored of the videos in ``new`` goes, ``new`` comes."""
    spark = new.sparkSession
    found, n, done = _begin(spark, path, token, buckets)
    if done:
        return found["version"]
    rows = _bucketed(new, by, n)
    touched = _numbers(rows)
    if found:
        rows = _others(load(spark, path, touched), new, by).unionByName(rows)
    return publish(rows, path, touched, {"n": n}, token)


def remove(gone: DataFrame, path: str, by: str = "video_id", token: str | None = None) -> int:
    """Deletes all rows of the videos in ``gone``."""
    spark = gone.sparkSession
    found, n, done = _begin(spark, path, token, BUCKETS)
    if found is None:
        raise ValueError(f"no table at {path}")
    if done:
        return found["version"]
    touched = _numbers(_bucketed(gone.select(by), by, n))
    return publish(_others(load(spark, path, touched), gone, by), path, touched, None, token)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes manifests but the newest ``keep`` and runs that none of those names; gives the runs. Not while another writer is at work."""
    fs, _ = place(spark, path)
    names = [n for n in _names(spark, f"{path}/versions") if _load(spark, f"{path}/versions/{n}") is not None]
    for name in names[:-keep]:
        fs.delete(place(spark, f"{path}/versions/{name}")[1], False)
    used = {run for n in names[-keep:] for run in _load(spark, f"{path}/versions/{n}")["buckets"].values()}
    gone = [n for n in _names(spark, f"{path}/data") if n.removeprefix("run=") not in used]
    for name in gone:
        fs.delete(place(spark, f"{path}/data/{name}")[1], True)
    return gone
