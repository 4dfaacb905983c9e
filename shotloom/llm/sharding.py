"""Sharding by sampled splitters into shards of near equal bytes.

Rows that are equal count as one with a number of copies. They are ordered by a digest of their text, so equal texts are neighbours. Keys drawn in proportion
to size give quantile boundaries of many fine ranges, and a text with more than a range's bytes has a range of its
own. Ranges that turn out overfull are subdivided: by the key, or by the id where they are one text.
Byte and row totals of the ranges, summed in order, place each range on the global line; a running sum inside the range places each row,
and the line is cut into equal lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import durable, partitions


def _upto(splitters: list[int], key: str) -> F.Column:
    """Number of ``splitters`` (sorted) that are not above ``key``, looked up in two levels."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    array = lambda x: f"array({', '.join(f'{v}L' for v in x)})"
    coarse = f"size(filter({array([g[0] for g in groups])}, x -> x <= {key}))"
    fine = f"size(filter(element_at(array({', '.join(map(array, groups))}), {coarse}), x -> x <= {key}))"
    return F.expr(f"case when {key} < {splitters[0]}L then 0 else ({coarse} - 1) * {step} + {fine} end")


PIECE = 100_000  # copies of a row that are placed as one


def shard_rows(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 8, draws_per_range: int = 8) -> DataFrame:
    """Every row with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null).

    ``docs`` has doc_id and text; other columns are ignored. Size is the text's UTF-8 bytes plus 1; a null text counts as an empty one (size 1, crc 0) and
    a null doc_id sorts first. Shards differ by at most one row's size from equal bytes; slots are
    gapless from 0 in each shard. Rows that repeat get a slot each; equal texts lie in one shard unless a cut goes through them. An empty table gives an empty
    result. The driver sees the sampled keys, the texts that fill a range and one row per range, all bounded by the number of ranges.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("key"))
    rows = durable(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n")))
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 1
    count = max(shards * ranges_per_shard, partitions(spark))
    draws, fill = count * draws_per_range, max(1, total // count)
    unit = F.expr("(xxhash64(doc_id, key, 'draw') & 4503599627370495) / 4503599627370496D")
    sample = sorted(r[0] for r in rows.where(unit < F.col("size") * F.col("n") * (draws / total)).select("key").collect())
    hot = sorted(r[0] for r in rows.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("b")).where(F.col("b") > fill).select("key").collect())
    splitters = sorted({sample[i * len(sample) // count] for i in range(1, count) if sample} | {k + d for k in hot for d in (0, 1)})
    rows = rows.withColumn("range", _upto(splitters, "key"))
    full = {r[0]: r[1] for r in rows.groupBy("range").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    parts = [max(1, round(full.get(i, 0) / fill)) if full.get(i, 0) > 2 * fill else 1 for i in range(len(splitters) + 1)]
    one_text = F.col("key").isin(hot) if hot else F.lit(False)
    # many copies are cut in pieces, each small against a range
    rows = rows.withColumn("per", F.expr(f"least({PIECE}L, greatest(1L, {fill}L div size))")).withColumn("piece", F.expr("explode(sequence(0L, (n - 1) div per))")).withColumn("n", F.expr("least(per, n - piece * per)"))
    rows = rows.withColumn("sub", F.expr(f"element_at(array({', '.join(map(str, parts))}), range + 1)"))
    rows = rows.withColumn("sub", F.pmod(F.when(one_text, F.xxhash64("doc_id", "piece")).otherwise(F.xxhash64("key")), F.col("sub")).cast("int"))
    line = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    places = rows.groupBy("range", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r")).select("range", "sub", F.coalesce(F.sum("b").over(line), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(line), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("range", "sub").orderBy("key", "doc_id", "text_crc32", "piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)).alias("b1"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("r1"))
    placed = rows.join(F.broadcast(places), ["range", "sub"]).withColumn("copy", F.expr("explode(sequence(0L, n - 1))"))
    placed = durable(placed.select("doc_id", "size", "text_crc32", F.expr(f"cast(({shards}L * (b0 + b1 + copy * size)) div {total}L as int)").alias("shard"), F.expr("r0 + r1 + copy").alias("at")))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("at0"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("at0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
