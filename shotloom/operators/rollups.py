"""Roll-ups: moderation, usage, indexes, knowledge graph, router evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the moderation categories, in the order in which labels are listed.
THRESHOLDS = (("nsfw", 0.85), ("violence", 0.80), ("toxic", 0.90))


def moderation_verdict(segments: DataFrame, thresholds=THRESHOLDS, min_flagged: int = 1) -> DataFrame:
    """Per video each category's maximum and count at or above its threshold, labels counted often enough, flagged."""
    aggs = []
    for name, t in thresholds:
        value = F.coalesce(F.col(f"{name}_score"), F.lit(0.0))
        aggs += [F.max(value).alias(f"max_{name}"), F.count_if(value >= t).alias(f"n_{name}")]
    rows = segments.groupBy("video_id").agg(*aggs)
    labels = F.array_compact(F.array(*(F.when(F.col(f"n_{name}") >= max(1, min_flagged), F.lit(name)) for name, _ in thresholds)))
    return rows.withColumn("labels", F.array_join(labels, ",")).withColumn("flagged", F.col("labels") != "")


def above_any(segments: DataFrame, threshold: float = 0.5, names=("nsfw", "violence", "toxic")) -> DataFrame:
    """Segments with ``worst``, the largest score, at ``threshold`` or more."""
    return segments.withColumn("worst", F.greatest(*(F.coalesce(F.col(f"{n}_score"), F.lit(0.0)) for n in names))).where(F.col("worst") >= threshold)


def collapse_chunks(videos: DataFrame) -> DataFrame:
    """One row per parent: joint status, summed duration (null for 0), first time, name and number of the chunks.

    ready if all are; else processing if any is processing or queued; else error if any is; else ready.
    """
    s = F.col("status")
    status = F.when(F.every(s == "ready"), "ready").when(F.some(s.isin("processing", "queued")), "processing").when(F.some(s == "error"), "error").otherwise("ready")
    return videos.groupBy("parent_id").agg(
        status.alias("status"),
        F.nullif(F.sum("duration"), F.lit(0.0)).alias("duration"),
        F.min("created_at").alias("created_at"),
        F.min_by(F.split("filename", r" \[part ")[0], "chunk_offset").alias("filename"),
        F.count("*").alias("n_chunks"),
    )


def chunk_offsets(videos: DataFrame) -> DataFrame:
    """Where each chunk begins in its parent: the sum of the durations before it, to thousandths."""
    before = Window.partitionBy("parent_id").orderBy("chunk_offset").rowsBetween(Window.unboundedPreceding, -1)
    return videos.withColumn("starts_at", F.round(F.coalesce(F.sum("duration").over(before), F.lit(0.0)), 3))


def daily(usage: DataFrame, values: list[str], by: list[str] = ()) -> DataFrame:
    return usage.groupBy(*by, F.date_trunc("day", "created_at").cast("date").alias("day")).agg(*(F.sum(v).alias(v) for v in values))


def zero_filled(series: DataFrame, first: str, last: str, value: str, by: str) -> DataFrame:
    """A row for every day from ``first`` to ``last`` and key; days without one have 0."""
    days = series.select(by).distinct().withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    return days.join(series, [by, "day"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage (model, prompt, completion) with the cost at the longest price prefix of the model, 0 without one.

    ``prices`` has prefix, price_in and price_out, per 1000. Each model is looked up under all of its own prefixes.
    """
    models = usage.select("model").distinct()
    fits = models.withColumn("prefix", F.explode(F.expr("transform(sequence(0, length(model)), n -> substring(model, 1, n))"))).join(prices, "prefix")
    best = fits.groupBy("model").agg(F.max_by(F.struct("price_in", "price_out"), F.length("prefix")).alias("p"))
    cost = F.col("prompt") / 1000 * F.coalesce("p.price_in", F.lit(0.0)) + F.col("completion") / 1000 * F.coalesce("p.price_out", F.lit(0.0))
    return usage.join(best, "model", "left").withColumn("cost", F.round(cost, 6)).drop("p")


def graph_nodes(relations: DataFrame, most: int) -> DataFrame:
    """(id, degree) of the ``most`` entities with most relations; each end counts, a loop twice; ties by larger id."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), F.desc("id")).limit(most)


def graph_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose ends are both among ``nodes``."""
    ids = nodes.select("id")
    return relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def upsert_relations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, relation) with the larger weight and the union of the segments; in ``new`` the first of a key (by ord) counts."""
    key = ["src", "dst", "relation"]
    firsts = new.groupBy(*key).agg(F.min_by(F.struct("weight", "segments"), "ord").alias("n")).select(*key, "n.weight", "n.segments")
    both = stored.select(*key, "weight", "segments").unionByName(firsts).select(*key, "weight", F.explode_outer("segments").alias("s"))
    return both.groupBy(*key).agg(F.max("weight").alias("weight"), F.array_sort(F.collect_set("s")).alias("segments"))


def confusion(cases: DataFrame) -> DataFrame:
    return cases.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def precision_recall(cases: DataFrame) -> DataFrame:
    """Per tool expected or predicted: tp, fp, fn, precision, recall, f1 (0 where undefined)."""
    tools = cases.select(F.explode(F.array(F.struct(F.col("expected").alias("tool"), F.lit(1).alias("e"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("tool"), F.lit(0).alias("e"), F.lit(1).alias("p")))).alias("x"), (F.col("expected") == F.col("predicted")).alias("hit"))
    t = tools.groupBy("x.tool").agg(F.count_if(F.col("hit") & (F.col("x.e") == 1)).alias("tp"), F.count_if(~F.col("hit") & (F.col("x.p") == 1)).alias("fp"), F.count_if(~F.col("hit") & (F.col("x.e") == 1)).alias("fn"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(x) + F.col(y)), F.lit(0.0))
    return t.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn"), "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})


#: The marks of extraction records.
FIELD, COMPLETE = "<|>", "<|COMPLETE|>"


def parse_graph_records(raw: Column) -> Column:
    """Entities ``("entity"<|>name<|>type<|>description)`` of a text up to ``<|COMPLETE|>``, then relationships ``("relationship"<|>a<|>b<|>description<|>strength)``.

    An array of string arrays (kind, fields ...) with quotes stripped. A description ends at the first closing bracket. Records without a name or an end are left out.
    """
    body = F.substring_index(raw, COMPLETE, 1)
    name, sep = r"\s*([^<|>]+?)\s*", r"<\|>"
    patterns = {
        "entity": (3, rf"(?s)\(\s*\"entity\"\s*{sep}{name}{sep}{name}{sep}\s*(.+?)\s*\)"),
        "relationship": (4, rf"(?s)\(\s*\"relationship\"\s*{sep}{name}{sep}{name}{sep}\s*(.+?)\s*{sep}\s*(\d+(?:\.\d+)?)\s*\)"),
    }
    found = []
    for kind, (fields, pattern) in patterns.items():
        each = [F.regexp_extract_all(body, F.lit(pattern), F.lit(i)) for i in range(1, fields + 1)]
        zipped = F.arrays_zip(*(e.alias(f"f{i}") for i, e in enumerate(each)))
        found.append(F.transform(zipped, _record(kind, fields)))
    return F.filter(F.concat(*found), lambda f: (f[1] != "") & ((f[0] == "entity") | (f[2] != "")))


def _record(kind: str, fields: int):
    return lambda z: F.array(F.lit(kind), *(unquoted(z[f"f{i}"]) for i in range(fields)))


def unquoted(text: Column) -> Column:
    """Without outer white space and one pair of equal quotes around it."""
    t = F.trim(text)
    pair = (F.length(t) >= 2) & F.substring(t, 1, 1).isin('"', "'") & (F.substring(t, 1, 1) == F.substring(t, -1, 1))
    return F.when(pair, F.trim(F.regexp_replace(t, r"(?s)^.(.*).$", "$1"))).otherwise(t)
