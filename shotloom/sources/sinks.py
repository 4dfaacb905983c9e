"""Writing by natural key: last writer wins, purge then insert, tombstones, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS, FILES = 64, 8


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored at a path, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure(spark: SparkSession, path: str, schema: str) -> bool:
    """Creates an empty table at ``path`` if nothing is stored there; tells whether it did."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def last_writer(stored: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key of both: the one with the largest ``version``; of equal ones the new row. Null keys match each other."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def _file_of(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*df.columns), F.lit(FILES))


def replace_partitions(df: DataFrame, path: str, by: str = "video_id") -> None:
    """Writes Parquet by ``by``; what is stored of the videos in ``df`` is replaced, the rest stays. A folder for each video: for few videos."""
    df.repartition(by, _file_of(df)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_buckets(df: DataFrame, path: str, by: str = "video_id", buckets: int = BUCKETS) -> None:
    """Replaces the buckets (by a hash of ``by``) that ``df`` has rows of; a bucket is up to ``FILES`` files, however much one video has."""
    rows = df.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({by}), {buckets}) as int)"))
    rows.repartition("bucket", _file_of(df)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _touched(new: DataFrame, path: str, by: str, buckets: int) -> DataFrame | None:
    """What is stored in the buckets of ``new``; None if nothing is stored at all."""
    if not exists(new.sparkSession, path):
        return None
    numbers = new.select(F.expr(f"cast(pmod(xxhash64({by}), {buckets}) as int)").alias("bucket")).distinct()
    return new.sparkSession.read.parquet(path).join(numbers, "bucket", "left_semi").drop("bucket")


def upsert(new: DataFrame, path: str, key: list[str], version: str, by: str = "video_id", buckets: int = BUCKETS) -> None:
    """Adds rows to the table at ``path``; of a key the row with the largest version stays, of equal ones the new one."""
    stored = _touched(new, path, by, buckets)
    write_buckets(last_writer(new.limit(0) if stored is None else stored, new, key, version), path, by, buckets)


def purge_and_insert(new: DataFrame, path: str, by: str = "video_id", buckets: int = BUCKETS) -> None:
    """What is stored of the videos in ``new`` goes, ``new`` comes; writing it again changes nothing."""
    stored = _touched(new, path, by, buckets)
    rows = new if stored is None else stored.join(new.select(by).distinct(), by, "left_anti").unionByName(new)
    write_buckets(rows, path, by, buckets)


def without(df: DataFrame, tombstones: DataFrame, by: str = "video_id") -> DataFrame:
    """Rows of videos that no tombstone names."""
    return df.join(tombstones.select(by).distinct(), by, "left_anti")


def index_dump(videos: DataFrame, shots: DataFrame) -> DataFrame:
    """One row per video with its status and, if it is ready, its shots in order with their durations; for ``write.json``."""
    s = shots.join(videos.where("status = 'ready'").select("video_id"), "video_id", "left_semi")
    each = F.struct("shot_idx", "t_start", "t_end", F.round(F.col("t_end") - F.col("t_start"), 3).alias("duration"))
    listed = s.groupBy("video_id").agg(F.array_sort(F.collect_list(each)).alias("shots"))
    return videos.join(listed, "video_id", "left").withColumn("n_shots", F.coalesce(F.size("shots"), F.lit(0)))


def collection_stats(points: DataFrame, name: str, vector: str = "vector") -> DataFrame:
    """One row for a collection: its name, how many points it has, how many of them a vector, and of how many components (null where there is none; the largest where they differ)."""
    return points.agg(F.lit(name).alias("collection"), F.count("*").alias("total_points"), F.count(vector).alias("with_vector"), F.max(F.when(F.col(vector).isNotNull(), F.size(vector))).alias("vector_size"))


def report_lines(scores: DataFrame) -> DataFrame:
    """A column ``value`` of lines for ``write.text``: all columns with commas in between, None where there is nothing, truth values capitalised."""
    shown = [F.coalesce(F.initcap(F.col(c).cast("string")) if t == "boolean" else F.col(c).cast("string"), F.lit("None")) for c, t in scores.dtypes]
    return scores.select(F.concat_ws(",", *shown).alias("value"))
