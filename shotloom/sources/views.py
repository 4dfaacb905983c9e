"""The fixture tables as media tables: shots, spans, hits, turns, usage, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000000D")


def shots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("label as video_id", "vec_id as shot_idx", "vec_id * 2D as t_start", "vec_id * 2D + 7D as t_end", "embedding as vector", "vec_id % 5 = 0 as crop")


def spans(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("t_start", seconds("ts"))
    return t.selectExpr("user_id as video_id", "event_id as ord", "t_start", "t_start + value * 20 as t_end", "event_type as label", "value as score")


def candidates(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("t_start", seconds("ts"))
    return t.selectExpr("concat(event_type, ':', event_id div 100) as group", "event_id as ord", "t_start", "t_start + value * 200 as t_end", "value as score", "concat('f', user_id % 4) as family", "user_id as video_id")


def saliency(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id as video_id", "row_number() over (partition by user_id order by ts, event_id) - 1 as clip_idx", "value as score")


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as video_id", "turn as ord", "role as speaker", "turn * 10D as t_start", "turn * 10D + least(length(text), 400) / 20D as t_end", "1D as score", "text")


def moderation(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as video_id", "l_linenumber as segment_idx", "l_discount * 10 as nsfw_score", "l_tax * 12 as violence_score", "l_quantity / 50 as toxic_score")


def videos(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as video_id", "o_custkey as user_id", "o_totalprice as duration", "o_orderdate as created_at", "case o_orderstatus when 'O' then 'ready' when 'P' then 'processing' else 'error' end as status")


def usage(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey as user_id", "l_shipdate as created_at", "l_quantity as prompt", "l_quantity * 2 as completion", "l_extendedprice as cost_usd", "concat('model-', l_linenumber) as model")


def relations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey as src", "l_suppkey + 1000000 as dst", "concat(l_returnflag, l_linestatus) as relation", "l_quantity as weight", "l_orderkey * 10 + l_linenumber as ord", "array(l_linenumber) as segments")


def mentions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey as entity_id", "l_orderkey as video_id", "l_linenumber as segment_idx").dropDuplicates()


def cases(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "events")
    return t.selectExpr("event_id as golden_id", "event_type as expected", "case when event_id % 7 = 0 then 'none' else event_type end as predicted", "case when event_id % 5 = 0 then null else event_id % 3 <> 0 end as arg_ok", "case when event_id % 4 <> 0 then value / 490 end as completion")


def one_per_shot(points: DataFrame) -> DataFrame:
    """One point per (video_id, idx): the first to arrive, unless its caption is blank and a later one's is not; points without a number or a time go."""
    from pyspark.sql import Window

    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    n = F.row_number().over(Window.partitionBy("video_id", "idx").orderBy(blank, "arrival"))
    return points.where("idx is not null and t_start is not null and t_end is not null").withColumn("_n", n).where("_n = 1").drop("_n")
