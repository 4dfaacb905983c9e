"""Query catalogue: every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, intervals, ranking, rollups, timeline, vectors
from ..sources import views as V
from ..sources.views import table
from .registry import alias, oracle_sql, queries, register

__all__ = ["oracle_sql", "queries"]

SHOTS = "shots as (select label as video_id, vec_id as shot_idx, vec_id * 2.0::double as t_start, vec_id * 2.0::double + 7 as t_end, embedding::double[] as vector, vec_id % 5 = 0 as crop from embeddings)"
SPANS = "spans as (select user_id as video_id, event_id as ord, epoch(ts) as t_start, epoch(ts) + value * 20 as t_end, event_type as label, value as score from events)"
CANDS = "cands as (select concat(event_type, ':', event_id // 100) as grp, event_id as ord, epoch(ts) as t_start, epoch(ts) + value * 200 as t_end, value as score, concat('f', user_id % 4) as family, user_id as video_id from events)"
SAL = "sal as (select user_id as video_id, row_number() over (partition by user_id order by ts, event_id) - 1 as clip_idx, value as score from events)"
TURNS = "turns as (select conv_id as video_id, turn as ord, role as speaker, turn * 10.0::double as t_start, turn * 10.0::double + least(length(text), 400) / 20.0::double as t_end, 1.0::double as score, text from conversations)"
MOD = "md as (select l_orderkey as video_id, l_linenumber as segment_idx, l_discount * 10 as nsfw_score, l_tax * 12 as violence_score, l_quantity / 50 as toxic_score from lineitem)"
VIDEOS = "videos as (select o_orderkey as video_id, o_custkey as user_id, o_totalprice as duration, o_orderdate as created_at, case o_orderstatus when 'O' then 'ready' when 'P' then 'processing' else 'error' end as status from orders)"
USAGE = "usage as (select o_custkey as user_id, l_shipdate as created_at, l_quantity as prompt, l_quantity * 2 as completion, l_extendedprice as cost_usd, concat('model-', l_linenumber) as model from lineitem join orders on l_orderkey = o_orderkey)"
RELS = "rels as (select l_partkey as src, l_suppkey + 1000000 as dst, concat(l_returnflag, l_linestatus) as relation, l_quantity as weight, l_orderkey * 10 + l_linenumber as ord, [l_linenumber] as segments from lineitem)"
MENTIONS = "mentions as (select distinct l_partkey as entity_id, l_orderkey as video_id, l_linenumber as segment_idx from lineitem)"
CASES = "cases as (select event_id as golden_id, event_type as expected, case when event_id % 7 = 0 then 'none' else event_type end as predicted, case when event_id % 5 = 0 then null else event_id % 3 <> 0 end as arg_ok, case when event_id % 4 <> 0 then value / 490 end as completion from events)"
HITS = "seeds as (select shot_idx as q_id, vector from shots where shot_idx % 50 = 0), scored as (select q_id, shot_idx, video_id, crop, list_cosine_similarity(s.vector, q.vector) as raw from seeds q, shots s), hits as (select q_id, shot_idx, video_id, crop, raw as score, row_number() over (partition by q_id order by round(raw, 9) desc, shot_idx) as rank from scored)"


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- vector search -----------------------------------------------------------------------------------------------


def _hits(spark, sf, k: int, where: str = "true") -> DataFrame:
    shots = V.shots(spark, sf).where(where)
    seeds = V.shots(spark, sf).where("shot_idx % 50 = 0").selectExpr("shot_idx as q_id", "vector")
    found = vectors.top_k(shots.withColumnRenamed("shot_idx", "item_id"), seeds, k)
    return found.join(shots.select(F.col("shot_idx").alias("item_id"), "video_id", "crop"), "item_id").withColumnRenamed("item_id", "shot_idx")


@register("vec_topk", f"{SHOTS}, {HITS} select q_id, shot_idx, video_id, rank, round(score, 6) as score from hits where rank <= 10")
def vec_topk(spark, sf):
    return _hits(spark, sf, 10).select("q_id", "shot_idx", "video_id", "rank", _r("score"))


@register("vec_topk_floor", f"{SHOTS}, {HITS} select q_id, shot_idx, rank, round(score, 6) as score from hits where rank <= 50 and score >= 0.24 and rank <= 10")
def vec_topk_floor(spark, sf):
    return _hits(spark, sf, 50).where("score >= 0.24 and rank <= 10").select("q_id", "shot_idx", "rank", _r("score"))


@register("vec_topk_by_video", f"{SHOTS}, {HITS}, f as (select *, row_number() over (partition by q_id, video_id order by rank) as n from hits where rank <= 50), g as (select q_id, video_id, shot_idx, score, row_number() over (partition by q_id order by rank) as rank from f where n = 1) select q_id, video_id, shot_idx, rank, round(score, 6) as score from g where rank <= 10")
def vec_topk_by_video(spark, sf):
    return vectors.first_per(_hits(spark, sf, 50), ["video_id"], 10).select("q_id", "video_id", "shot_idx", "rank", _r("score"))


@register("vec_topk_no_crops", f"{SHOTS}, {HITS}, f as (select *, row_number() over (partition by q_id order by rank) as n from hits where not crop) select q_id, shot_idx, n as rank, round(score, 6) as score from f where n <= 10")
def vec_topk_no_crops(spark, sf):
    return _hits(spark, sf, 10, "not crop").select("q_id", "shot_idx", "rank", _r("score"))


@register("vec_multi_query_max", f"{SHOTS}, {HITS}, m as (select q_id // 100 as group_id, video_id, shot_idx, max(score) as score from hits where rank <= 50 group by 1, 2, 3), r as (select *, row_number() over (partition by group_id order by round(score, 9) desc, shot_idx) as rank from m) select group_id, video_id, shot_idx, rank, round(score, 6) as score from r where rank <= 10")
def vec_multi_query_max(spark, sf):
    best = _hits(spark, sf, 50).groupBy(F.expr("q_id div 100").alias("group_id"), "video_id", "shot_idx").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.round("score", 9).desc(), "shot_idx"))
    return best.withColumn("rank", rank).where("rank <= 10").select("group_id", "video_id", "shot_idx", "rank", _r("score"))


@register("vec_best_region", f"{SHOTS}, {HITS}, f as (select *, row_number() over (partition by q_id, video_id, shot_idx // 5 order by rank) as n from hits where rank <= 100), g as (select q_id, video_id, shot_idx // 5 as parent, shot_idx, score, row_number() over (partition by q_id order by rank) as rank from f where n = 1) select q_id, video_id, parent, shot_idx, rank, round(score, 6) as score from g where rank <= 10")
def vec_best_region(spark, sf):
    hits = _hits(spark, sf, 100).withColumn("parent", F.expr("shot_idx div 5"))
    return vectors.first_per(hits, ["video_id", "parent"], 10).select("q_id", "video_id", "parent", "shot_idx", "rank", _r("score"))


@register("vec_keyword_boost", f"{SHOTS}, {HITS}, b as (select q_id, shot_idx, rank as before, score + case when lower(text) like '%the%' then 0.15 else 0 end as score from hits join documents on shot_idx = doc_id where rank <= 50), r as (select *, row_number() over (partition by q_id order by round(score, 9) desc, before) as rank from b) select q_id, shot_idx, rank, round(score, 6) as score from r where rank <= 10")
def vec_keyword_boost(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("shot_idx"), "text")
    rows = _hits(spark, sf, 50).join(docs, "shot_idx").withColumn("score", F.col("score") + F.when(F.lower("text").contains("the"), 0.15).otherwise(0.0))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("score", 9).desc(), "before"))
    return rows.withColumnRenamed("rank", "before").withColumn("rank", rank).where("rank <= 10").select("q_id", "shot_idx", "rank", _r("score"))


POOLED = "parts as (select label as video_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings), means as (select video_id, i, avg(x) as m from parts group by 1, 2), pooled as (select video_id, list(m order by i) as vector from means group by 1)"


@register("video_mean_pool", f"{POOLED} select video_id, i - 1 as i, round(m, 6) as m from means")
def video_mean_pool(spark, sf):
    return vectors.mean_pool(V.shots(spark, sf), "video_id").select("video_id", F.posexplode("vector").alias("i", "m")).select("video_id", F.col("i").cast("long").alias("i"), _r("m"))


@register("similar_all_seeds", f"{POOLED}, s as (select q.video_id as q_id, p.video_id, list_cosine_similarity(q.vector, p.vector) as score from pooled q, pooled p where q.video_id <> p.video_id), r as (select *, row_number() over (partition by q_id order by round(score, 9) desc, video_id) as rank from s) select q_id, video_id, rank, round(score, 6) as score from r where rank <= 5")
def similar_all_seeds(spark, sf):
    pooled = vectors.mean_pool(V.shots(spark, sf), "video_id")
    found = vectors.top_k(pooled.withColumnRenamed("video_id", "item_id"), pooled.withColumnRenamed("video_id", "q_id"), 6).where("q_id <> item_id")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))
    return found.withColumn("rank", rank).where("rank <= 5").select("q_id", F.col("item_id").alias("video_id"), "rank", _r("score"))


# --- interval merging --------------------------------------------------------------------------------------------

ISLES = "a as (select *, max(t_end) over (partition by {by} order by t_start, {tie} rows between unbounded preceding and 1 preceding) as reach from {src}), b as (select *, sum(case when t_start > reach + {gap} then 1 else 0 end) over (partition by {by} order by t_start, {tie} rows unbounded preceding) as isle from a)"
SCORED = "scored as (select video_id, shot_idx, t_start, t_end, (shot_idx * 37 % 101)::double / 101 as score, case when shot_idx % 3 = 0 then '' else concat('s', shot_idx) end as asr_text from shots)"


def _scored_shots(spark, sf):
    return V.shots(spark, sf).selectExpr("video_id", "shot_idx", "t_start", "t_end", "cast(shot_idx * 37 % 101 as double) / 101 as score", "case when shot_idx % 3 = 0 then '' else concat('s', shot_idx) end as asr_text")


@register("shots_merge_contiguous", f"{SHOTS}, {SCORED}, {ISLES.format(by='video_id', tie='shot_idx', src='scored', gap=1.0)} select video_id, min(t_start) as t_start, max(t_end) as t_end, max(score) as score, (list(shot_idx order by score desc, t_start, shot_idx))[1] as shot_idx, coalesce(string_agg(asr_text, ' ' order by t_start, shot_idx) filter (asr_text <> ''), '') as asr_text, count(*) as n_shots from b group by video_id, isle")
def shots_merge_contiguous(spark, sf):
    return intervals.merge_contiguous(_scored_shots(spark, sf))


RUNS = "r0 as (select *, case when {label} = lag({label}) over (partition by video_id order by t_start, ord) then 0 else 1 end as fresh from {src}), runs as (select *, sum(fresh) over (partition by video_id order by t_start, ord rows unbounded preceding) as run from r0)"


@register("spans_merge_labels", f"{SPANS}, {RUNS.format(label='label', src='spans')}, {ISLES.format(by='video_id, run', tie='ord', src='runs', gap=1.0)} select video_id, label, min(t_start) as t_start, max(t_end) as t_end, max(score) as score, min(ord) as ord from b group by video_id, run, label, isle")
def spans_merge_labels(spark, sf):
    return intervals.merge_labels(V.spans(spark, sf))


NORMAL = f"{TURNS}, {RUNS.format(label='speaker', src='turns')}, {ISLES.format(by='video_id, run', tie='ord', src='runs', gap=1.0)}, normal as (select video_id, speaker, round(min(t_start), 2) as t_start, round(max(t_end), 2) as t_end, min(ord) as ord from b group by video_id, run, speaker, isle having max(t_end) - min(t_start) >= 0.5)"


@register("turns_normalized", f"{NORMAL} select * from normal")
def turns_normalized(spark, sf):
    return intervals.normalize_turns(V.turns(spark, sf)).select("video_id", "speaker", "t_start", "t_end", "ord")


@register("turns_overlap_resolved", f"{NORMAL} select * from normal t where not exists (select 1 from normal o where o.video_id = t.video_id and o.speaker <> t.speaker and o.t_end - o.t_start > t.t_end - t.t_start and least(o.t_end, t.t_end) > greatest(o.t_start, t.t_start) and least(o.t_end, t.t_end) - greatest(o.t_start, t.t_start) >= 0.5 * (t.t_end - t.t_start))")
def turns_overlap_resolved(spark, sf):
    return intervals.without_dominated(turns_normalized(spark, sf))


@register("windows_pad_merge_split", f"{SPANS}, p as (select video_id, ord, greatest(0, t_start - 15) as t_start, t_end + 15 as t_end from spans), {ISLES.format(by='video_id', tie='ord', src='p', gap=0)}, w as (select video_id, min(t_start) as lo, max(t_end) as hi from b group by video_id, isle), s as (select *, unnest(generate_series(0, greatest(ceil((hi - lo) / 150.0), 1)::bigint - 1)) as k from w) select video_id, round(lo + k * 150, 3) as t_start, round(least(hi, lo + (k + 1) * 150), 3) as t_end from s")
def windows_pad_merge_split(spark, sf):
    return intervals.candidate_windows(V.spans(spark, sf)).select("video_id", _r("t_start", 3), _r("t_end", 3))


@register("windows_sliding", f"{SAL}, n as (select video_id, count(*) as n from sal group by 1), k as (select *, unnest(generate_series(0, ceil(greatest(0, n - 75) / 37.0)::bigint)) as k from n) select video_id, (k * 37)::int as w_start, least(k * 37 + 75, n)::int as w_end from k")
def windows_sliding(spark, sf):
    return intervals.sliding_windows(V.saliency(spark, sf).groupBy("video_id").agg(F.count("*").alias("n")))


@register("windows_max_pool", f"{SAL}, n as (select video_id, count(*) as n from sal group by 1), k as (select *, unnest(generate_series(0, ceil(greatest(0, n - 20) / 10.0)::bigint)) as k from n), w as (select video_id, k * 10 as a, least(k * 10 + 20, n) as b from k), ws as (select w.video_id, a, b, avg(score) as s from w join sal on sal.video_id = w.video_id and clip_idx >= a and clip_idx < b group by 1, 2, 3) select sal.video_id, clip_idx, round(max(s), 6) as score from sal join ws on sal.video_id = ws.video_id and clip_idx >= a and clip_idx < b group by 1, 2")
def windows_max_pool(spark, sf):
    sal = V.saliency(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    scored = intervals.covering_windows(sal, 20, 0.5).groupBy("video_id", "k").agg(F.avg("score").alias("w_score"))
    return intervals.max_pool(sal, scored, 20, 0.5).select("video_id", "clip_idx", _r("score"))


@register("windows_tumbling", f"{SAL} select video_id, clip_idx // 72 as window_idx, count(*) as n_clips, max(score) as best from sal group by 1, 2")
def windows_tumbling(spark, sf):
    return V.saliency(spark, sf).groupBy("video_id", F.expr("clip_idx div 72").alias("window_idx")).agg(F.count("*").alias("n_clips"), F.max("score").alias("best"))


MOMENTS = f"{SAL}, sm as (select *, count(*) over (partition by video_id) as n, (coalesce(lag(score) over w, 0) + score + coalesce(lead(score) over w, 0)) / 3.0 as three from sal window w as (partition by video_id order by clip_idx)), s1 as (select *, case when n >= 3 then three else score end as smooth from sm), s2 as (select *, avg(smooth) over (partition by video_id) as mean from s1), s3 as (select *, clip_idx - row_number() over (partition by video_id order by clip_idx) as run from s2 where round(smooth, 9) >= round(mean, 9)), s4 as (select video_id, min(clip_idx) as f, max(clip_idx) as l, max(smooth) as score from s3 group by video_id, run), moments as (select video_id, f * 2.0 as t_start, (l + 1) * 2.0 as t_end, score, row_number() over (partition by video_id order by round(score, 9) desc, f) as rank from s4 qualify rank <= 8)"


@register("saliency_moments", f"{MOMENTS} select video_id, t_start::double as t_start, t_end::double as t_end, round(score, 6) as score, rank from moments")
def saliency_moments(spark, sf):
    return intervals.saliency_moments(V.saliency(spark, sf)).select("video_id", "t_start", "t_end", _r("score"), "rank")


@register("saliency_broadcast", f"{MOMENTS} select c.video_id, c.clip_idx, round(coalesce(max(m.score), 0), 6) as score from sal c left join moments m on c.video_id = m.video_id and m.t_start < (c.clip_idx + 1) * 2 and m.t_end > c.clip_idx * 2 group by 1, 2")
def saliency_broadcast(spark, sf):
    sal = V.saliency(spark, sf)
    return intervals.broadcast_scores(sal, intervals.saliency_moments(sal)).select("video_id", "clip_idx", _r("score"))


GRID = f"{VIDEOS}, v as (select video_id, duration / 100 as duration, greatest(7.0, duration / 5000) as len from videos where duration > 0), grid as (select video_id, unnest(generate_series(0, ceil(round(duration / len, 9))::bigint - 1)) as k, len, duration from v)"


def _lengths(spark, sf):
    return V.videos(spark, sf).select("video_id", (F.col("duration") / 100).alias("duration"))


@register("grid_fixed", f"{GRID} select video_id, k::int as segment_idx, round(k * len, 6) as t_start, round(least(duration, (k + 1) * len), 6) as t_end from grid")
def grid_fixed(spark, sf):
    return intervals.fixed_grid(_lengths(spark, sf)).select("video_id", "segment_idx", _r("t_start"), _r("t_end"))


@register("grid_nearest_cut", f"{GRID}, p as (select video_id, k * len as t from grid where k > 0), c as (select l_orderkey as video_id, l_quantity * 20 as cut from lineitem), d as (select video_id, t, (list(cut order by abs(cut - t), cut))[1] as cut from p join c using (video_id) where abs(cut - t) <= 2 group by 1, 2) select p.video_id, round(p.t, 6) as t, round(coalesce(cut, p.t), 6) as snapped from p left join d on p.video_id = d.video_id and p.t = d.t")
def grid_nearest_cut(spark, sf):
    cuts = table(spark, sf, "lineitem").selectExpr("l_orderkey as video_id", "l_quantity * 20 as cut")
    return intervals.nearest_in_grid(_lengths(spark, sf), cuts, 2.0).select("video_id", _r("t"), _r("snapped"))


SNAPPED = """, p as (select video_id, k * len as t from grid where k > 0), c as (select l_orderkey as video_id, l_quantity * 20 as cut from lineitem),
d as (select video_id, t, (list(cut order by abs(cut - t), cut))[1] as cut from p join c using (video_id) where abs(cut - t) <= 2 group by 1, 2),
sn as (select p.video_id, v.duration, coalesce(cut, p.t) as s from p join v using (video_id) left join d on p.video_id = d.video_id and p.t = d.t where coalesce(cut, p.t) < v.duration),
all_videos as (select v.video_id, v.duration, coalesce(list(s order by s) filter (s is not null), []) as marks from v left join sn using (video_id) group by 1, 2),
kept as (select video_id, duration, list_reduce(marks, lambda acc, x: case when x > acc[len(acc)] + 1 then list_append(acc, x) else acc end, [0.0::double]) as bounds from (select video_id, duration, list_transform(marks, lambda x: [x]) as wrapped, marks from all_videos)),"""


@register("grid_snap", f"""{GRID}{SNAPPED.replace('list_reduce(marks, lambda acc, x: case when x > acc[len(acc)] + 1 then list_append(acc, x) else acc end, [0.0::double])', 'list_reduce(wrapped, lambda acc, x: case when x[1] > acc[len(acc)] + 1 then list_concat(acc, x) else acc end, [0.0::double])')}
segs as (select video_id, unnest(range(len(bounds)))::int as segment_idx, bounds, duration from kept)
select video_id, segment_idx, round(bounds[segment_idx + 1], 6) as t_start, round(coalesce(bounds[segment_idx + 2], duration), 6) as t_end from segs""")
def grid_snap(spark, sf):
    cuts = table(spark, sf, "lineitem").selectExpr("l_orderkey as video_id", "l_quantity * 20 as cut")
    return intervals.snap_grid(_lengths(spark, sf), cuts).select("video_id", "segment_idx", _r("t_start"), _r("t_end"))


@register("chunk_pack", f"{SPANS}, o as (select video_id, ord, t_start, t_end, row_number() over (partition by video_id order by t_start, ord) as n from spans), rec as (select * from (with recursive r as (select video_id, ord, n, t_start, t_end, t_start as s, 0::bigint as chunk from o where n = 1 union all select o.video_id, o.ord, o.n, o.t_start, o.t_end, case when o.t_end - r.s > 86400 then o.t_start else r.s end, case when o.t_end - r.s > 86400 then r.chunk + 1 else r.chunk end from r join o on o.video_id = r.video_id and o.n = r.n + 1) select * from r)) select video_id, ord, chunk from rec")
def chunk_pack(spark, sf):
    return intervals.pack_chunks(V.spans(spark, sf), 86400.0).select("video_id", "ord", "chunk")


@register("role_merge", f"{TURNS}, {RUNS.format(label='speaker', src='turns')} select video_id, speaker as role, min(t_start) as t_start, max(t_end) as t_end, count(*) as n_chunks from runs group by video_id, run, speaker")
def role_merge(spark, sf):
    return intervals.merge_roles(V.turns(spark, sf).withColumnRenamed("speaker", "role"))


@register("topic_split", f"{SHOTS}, c as (select *, lag(vector) over (partition by video_id order by shot_idx) as prev, row_number() over (partition by video_id order by shot_idx) as n from shots), g as (select video_id, shot_idx, t_start, t_end, sum(case when n > 1 and round(list_cosine_similarity(prev, vector), 9) < 0.05 then 1 else 0 end) over (partition by video_id order by shot_idx rows unbounded preceding) as grp from c) select video_id, grp as group_no, min(t_start) as t_start, max(t_end) as t_end, count(*) as shot_count, min(shot_idx) as first_idx, max(shot_idx) as last_idx from g group by 1, 2")
def topic_split(spark, sf):
    rows = intervals.split_where_unlike(V.shots(spark, sf), 0.05)
    return rows.groupBy("video_id", F.col("group").alias("group_no")).agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("shot_count"), F.min("shot_idx").alias("first_idx"), F.max("shot_idx").alias("last_idx"))


@register("shots_postprocess", f"{SPANS}, n as (select video_id, ord, t_start, t_start + score / 20 as t_end, greatest(ceil(round(score / 200, 9)), 1)::bigint as n from spans), k as (select *, unnest(generate_series(0, n - 1)) as k from n), p as (select video_id, ord, k, t_start + k * ((t_end - t_start) / n) as p0, case when k = n - 1 then t_end else t_start + (k + 1) * ((t_end - t_start) / n) end as p1 from k), i as (select *, row_number() over w as rn, p1 - p0 as d from p window w as (partition by video_id order by p0, ord, k)), j as (select *, sum(case when rn = 1 or round(d, 9) >= 0.75 then 1 else 0 end) over (partition by video_id order by p0, ord, k rows unbounded preceding) as isle from i) select video_id, min(p0) as t_start, max(p1) as t_end, count(*) as n_pieces from j group by video_id, isle")
def shots_postprocess(spark, sf):
    shots = V.spans(spark, sf).selectExpr("video_id", "ord", "t_start", "t_start + score / 20 as t_end")
    return intervals.postprocess_shots(shots)


@register("segments_filter_window", f"{SPANS} select video_id, ord, t_start, t_end from spans where t_end > 1704672000 and t_start < 1705276800 and t_end - t_start >= 100 and t_end - t_start <= 5000")
def segments_filter_window(spark, sf):
    return intervals.in_window(V.spans(spark, sf), 1704672000.0, 1705276800.0, 100.0, 5000.0).select("video_id", "ord", "t_start", "t_end")


@register("segments_filter_ranges", f"{TURNS} select video_id, ord, t_start, t_end from turns where (t_start < 12 and t_end > 5) or (t_start < 45 and t_end > 35)")
def segments_filter_ranges(spark, sf):
    return intervals.in_any_range(V.turns(spark, sf), "5-12, x, 35-45, 9-3").select("video_id", "ord", "t_start", "t_end")


# --- joins of intervals ------------------------------------------------------------------------------------------

SEGS = "segs as (select conv_id as video_id, turn as idx, turn * 7.0::double as t_start, turn * 7.0::double + 9 as t_end, coalesce(text, '') as text from conversations)"


def _segs(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id as video_id", "turn as idx", "turn * 7D as t_start", "turn * 7D + 9D as t_end", "coalesce(text, '') as text")


@register("overlap_text_join", f"{TURNS}, {SEGS} select e.video_id, e.ord, substr(string_agg(s.text, ' | ' order by s.t_start, s.idx), 1, 1000) as text, count(*) as n_segments from turns e join segs s on e.video_id = s.video_id and e.t_start < s.t_end and e.t_end > s.t_start group by 1, 2")
def overlap_text_join(spark, sf):
    return intervals.overlap_texts(V.turns(spark, sf).select("video_id", "ord", "t_start", "t_end"), _segs(spark, sf))


@register("turn_transcripts", f"{TURNS}, {SEGS}, p as (select s.video_id, s.idx as shot_idx, t.ord as turn_idx, least(s.t_end, t.t_end) - greatest(s.t_start, t.t_start) as overlap from segs s join turns t on s.video_id = t.video_id and s.t_start < t.t_end and s.t_end > t.t_start), r as (select *, row_number() over (partition by video_id, shot_idx order by round(overlap, 9) desc, turn_idx) as n from p) select video_id, shot_idx, turn_idx, round(overlap, 6) as overlap from r where n = 1")
def turn_transcripts(spark, sf):
    shots = _segs(spark, sf).withColumnRenamed("idx", "shot_idx").drop("text")
    turns = V.turns(spark, sf).selectExpr("video_id", "ord as turn_idx", "t_start", "t_end")
    return intervals.assign_by_overlap(shots, turns).select("video_id", "shot_idx", "turn_idx", _r("overlap"))


@register("nearest_citation", f"{TURNS}, {SEGS}, c as (select video_id, ord, (t_start + t_end) / 2 as mid from turns), s as (select video_id, idx, (t_start + t_end) / 2 as mid from segs) select c.video_id, c.ord, coalesce((list(s.idx order by round(abs(s.mid - c.mid), 9), s.idx) filter (s.idx is not null))[1], -1) as segment_idx from c left join s on c.video_id = s.video_id group by 1, 2")
def nearest_citation(spark, sf):
    cites = V.turns(spark, sf).selectExpr("video_id", "ord", "(t_start + t_end) / 2 as mid")
    segs = _segs(spark, sf).selectExpr("video_id", "idx", "(t_start + t_end) / 2 as s_mid")
    return intervals.nearest_midpoint(cites, segs)


alias("overlap_text_join_whole", "overlap_text_join")
alias("nearest_citation_all", "nearest_citation")


# --- fusion ------------------------------------------------------------------------------------------------------

LISTS = "lists as (select q_id, 0 as stream_no, rank - 1 as rank, shot_idx as key, score from hits where rank <= 10 union all select q_id, 1, row_number() over (partition by q_id order by shot_idx) - 1, shot_idx // 2 * 2, score from hits where rank <= 16)"
FUSED = f"{SHOTS}, {HITS}, {LISTS}, firsts as (select q_id, stream_no, key, row_number() over (partition by q_id, stream_no order by min(rank)) - 1 as rank from lists group by 1, 2, 3), fs as (select q_id, key, sum(1.0::double / (60 + rank + 1)) as score, min(stream_no * 1000 + rank) as seen from firsts group by 1, 2), fused as (select q_id, key, score, row_number() over (partition by q_id order by round(score, 12) desc, seen) - 1 as rank from fs)"


def _fused(spark, sf):
    hits = _hits(spark, sf, 16)
    one = hits.where("rank <= 10").selectExpr("q_id", "0 as stream_no", "rank - 1 as rank", "shot_idx as key")
    two = hits.selectExpr("q_id", "1 as stream_no", "row_number() over (partition by q_id order by shot_idx) - 1 as rank", "shot_idx div 2 * 2 as key")
    return fusion.reciprocal_rank_fusion(fusion.best_ranks(one.union(two)))


@register("rrf_fuse", f"{FUSED} select q_id, key, round(score, 9) as score, rank from fused")
def rrf_fuse(spark, sf):
    return _fused(spark, sf).select("q_id", "key", _r("score", 9), "rank")


@register("image_fuse_pin", f"{FUSED}, pins as (select q_id, max(key) as key from fused group by 1) select f.q_id, f.key, round(score, 9) as score, row_number() over (partition by f.q_id order by case when p.key is null then 1 else 0 end, rank) - 1 as rank from fused f left join pins p on f.q_id = p.q_id and f.key = p.key")
def image_fuse_pin(spark, sf):
    fused = _fused(spark, sf)
    return fusion.pin_first(fused, fused.groupBy("q_id").agg(F.max("key").alias("key"))).select("q_id", "key", _r("score", 9), "rank")


@register("gated_rerank", f"{FUSED}, i as (select *, key * 7 % 60 as inliers from fused) select q_id, key, inliers, row_number() over (partition by q_id order by case when inliers >= 30 then 0 else 1 end, case when inliers >= 30 then -inliers else 0 end, rank) - 1 as rank from i")
def gated_rerank(spark, sf):
    return fusion.gated_rerank(_fused(spark, sf).withColumn("inliers", F.expr("key * 7 % 60"))).select("q_id", "key", "inliers", "rank")


@register("verify_rescale", f"{FUSED}, c as (select *, case when rank < 5 and key % 3 <> 0 then (key % 10) / 10.0::double end as conf from fused), s as (select q_id, key, rank as before, score * coalesce(0.6 + 0.5 * conf, 1) as score from c) select q_id, key, round(score, 9) as score, row_number() over (partition by q_id order by round(score, 9) desc, before) - 1 as rank from s")
def verify_rescale(spark, sf):
    rows = _fused(spark, sf).withColumn("conf", F.expr("case when rank < 5 and key % 3 <> 0 then (key % 10) / 10D end"))
    return fusion.rescale_by_confidence(rows).select("q_id", "key", _r("score", 9), "rank")


@register("relative_gate", f"{SHOTS}, {HITS}, t as (select *, max(score) over (partition by q_id) as top from hits where rank <= 20) select q_id, shot_idx, rank, round(score, 6) as score from t where case when top <= 0 then rank = 1 else score >= 0.3 * top end")
def relative_gate(spark, sf):
    return fusion.relative_gate(_hits(spark, sf, 20), 0.3).select("q_id", "shot_idx", "rank", _r("score"))


WEIGHTED = f"{CANDS}, m as (select *, max(score) over (partition by grp, family) as top from cands), weighted as (select grp, ord, t_start, t_end, family, score / case when top > 0 then top else 1 end * case family when 'f0' then 0.7 when 'f1' then 1.6 else 1.0 end as score from m)"


def _weighted(spark, sf):
    return fusion.family_weighted(V.candidates(spark, sf), ["group"], {"f0": 0.7, "f1": 1.6})


@register("when_weighted", f"{WEIGHTED} select grp as \"group\", ord, family, round(score, 9) as score from weighted")
def when_weighted(spark, sf):
    return _weighted(spark, sf).select("group", "ord", "family", _r("score", 9))


NMS = """o as (select grp, ord, t_start, t_end, score, family, row_number() over (partition by grp order by score desc, t_end - t_start, ord) as n from {src}),
nms as (select * from (with recursive r as (select grp, 0::bigint as n, []::struct(s double, e double, i bigint)[] as kept from (select distinct grp from o)
union all select o.grp, o.n, case when len(list_filter(r.kept, lambda k: greatest(o.t_end, k.e) - least(o.t_start, k.s) > 0 and (least(o.t_end, k.e) - greatest(o.t_start, k.s)) / (greatest(o.t_end, k.e) - least(o.t_start, k.s)) >= 0.5)) = 0 then list_append(r.kept, {{'s': o.t_start, 'e': o.t_end, 'i': o.ord}}) else r.kept end
from r join o on o.grp = r.grp and o.n = r.n + 1) select * from r)),
last as (select grp, kept from nms qualify row_number() over (partition by grp order by n desc) = 1),
out as (select grp, unnest(kept) as k, unnest(range(len(kept))) as rank from last)"""


@register("nms_temporal", f"{CANDS}, {NMS.format(src='cands')} select grp as \"group\", k.i as ord, k.s as t_start, k.e as t_end, rank::int as rank from out")
def nms_temporal(spark, sf):
    return intervals.temporal_nms(V.candidates(spark, sf)).select("group", "ord", "t_start", "t_end", "rank")


@register("when_merged", f"{WEIGHTED}, {NMS.format(src='weighted')} select grp as \"group\", k.i as ord, rank::int as rank from out")
def when_merged(spark, sf):
    return intervals.temporal_nms(_weighted(spark, sf)).select("group", "ord", "rank")


FIRST = """, mt as (select o.grp, o.family, out.rank, row_number() over (partition by o.grp, o.n order by out.rank) as nth from o join out on o.grp = out.grp
and greatest(o.t_end, out.k.e) - least(o.t_start, out.k.s) > 0 and (least(o.t_end, out.k.e) - greatest(o.t_start, out.k.s)) / (greatest(o.t_end, out.k.e) - least(o.t_start, out.k.s)) >= 0.5
where o.ord not in (select k.i from out)), fm as (select k.grp, k.rank, o.family from out k join o on o.grp = k.grp and o.ord = k.k.i),
also as (select mt.grp, mt.rank, array_to_string(list_sort(list_distinct(list(mt.family))), ',') as families from mt join fm using (grp, rank) where mt.nth = 1 and mt.family <> fm.family group by 1, 2)"""


@register("when_provenance", f"{WEIGHTED}, {NMS.format(src='weighted')}{FIRST} select out.grp as \"group\", out.k.i as ord, fm.family, coalesce(also.families, '') as also_matched, out.rank::int as rank from out join fm on fm.grp = out.grp and fm.rank = out.rank left join also on also.grp = out.grp and also.rank = out.rank")
def when_provenance(spark, sf):
    return intervals.temporal_nms(_weighted(spark, sf)).select("group", "ord", "family", F.array_join(F.array_sort("also_matched"), ",").alias("also_matched"), "rank")


# --- text --------------------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TOKENS = f"d as (select doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({STOP})))) as t from documents), q as (select item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({STOP})))) as t from benchmark)"


@register("token_overlap_rank", f"{TOKENS}, o as (select item_id, doc_id, count(*) as shared from d join q using (t) group by 1, 2), r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as rank from o) select item_id, doc_id, shared, rank from r where rank <= 10")
def token_overlap_rank(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))  # the items' tokens are the ones that count
    return ranking.top_overlap(docs, table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text"), 2, T.STOPWORDS).alias("tokens")))


@register("ocr_fulltext", "d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) select doc_id from d where list_contains(w, 'the') and list_contains(w, 'of') and list_contains(w, 'by')")
def ocr_fulltext(spark, sf):
    words = T.tokens(F.col("text"))
    return table(spark, sf, "documents").where(F.size(F.array_except(F.array(F.lit("the"), F.lit("of"), F.lit("by")), words)) == 0).select("doc_id")


SOUND_LABELS = "case label when 'view' then 'Applause' when 'click' then 'Crowd' when 'purchase' then 'Ovation, clapping' else label end"


@register("tag_filter_synonyms", f"{SPANS}, t as (select video_id, ord, {SOUND_LABELS} as label from spans) select video_id, ord, label from t where lower(label) similar to '.*(cheering|cheer|crowd|applause|clap|chant|ovation|chatter|hubbub|shout|yell|screaming).*'")
def tag_filter_synonyms(spark, sf):
    rows = V.spans(spark, sf).select("video_id", "ord", F.expr(SOUND_LABELS).alias("label"))
    return rows.where(T.any_term(F.col("label"), T.expanded("Cheering")))


@register("label_any_term", f"{SPANS} select video_id, ord, label, 1.0::double as score from spans where lower(label) like '%view%' or lower(label) like '%err%'")
def label_any_term(spark, sf):
    return V.spans(spark, sf).where(T.any_term(F.col("label"), ["view", "err"])).select("video_id", "ord", "label", F.lit(1.0).alias("score"))


# --- moderation, indexes, usage ----------------------------------------------------------------------------------

VERDICT = f"{MOD}, verdict as (select video_id, max(nsfw_score) as max_nsfw, count(*) filter (nsfw_score >= 0.85) as n_nsfw, max(violence_score) as max_violence, count(*) filter (violence_score >= 0.80) as n_violence, max(toxic_score) as max_toxic, count(*) filter (toxic_score >= 0.90) as n_toxic, concat_ws(',', case when n_nsfw >= 1 then 'nsfw' end, case when n_violence >= 1 then 'violence' end, case when n_toxic >= 1 then 'toxic' end) as labels, labels <> '' as flagged from md group by video_id)"


@register("moderation_verdict", f"{VERDICT} select * from verdict")
def moderation_verdict(spark, sf):
    return rollups.moderation_verdict(V.moderation(spark, sf))


@register("moderation_flagged", f"{MOD}, w as (select *, greatest(nsfw_score, violence_score, toxic_score) as worst from md) select video_id, segment_idx, worst from w where worst >= 0.9")
def moderation_flagged(spark, sf):
    return rollups.above_any(V.moderation(spark, sf), 0.9).select("video_id", "segment_idx", "worst")


@register("index_rollup", "o as (select c_custkey as index_id, c_nationkey as user_id, count(o_orderkey) as n_videos, coalesce(sum(o_totalprice), 0) as duration from customer left join orders on o_custkey = c_custkey group by 1, 2) select index_id, user_id, n_videos, round(duration, 2) as duration from o")
def index_rollup(spark, sf):
    v = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("index_id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("d"))
    c = table(spark, sf, "customer").selectExpr("c_custkey as index_id", "c_nationkey as user_id")
    return c.join(v, "index_id", "left").select("index_id", "user_id", F.coalesce("n", F.lit(0)).alias("n_videos"), F.round(F.coalesce("d", F.lit(0.0)), 2).alias("duration"))


@register("index_members", "m as (select l_orderkey as index_id, l_partkey as video_id, l_linenumber as position, p_name as name from lineitem join part on l_partkey = p_partkey) select index_id, video_id, position, name, row_number() over (partition by index_id order by position, video_id) as place from m")
def index_members(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey as index_id", "l_partkey as video_id", "l_linenumber as position", "p_name as name")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("index_id").orderBy("position", "video_id")))


@register("index_next_position", "c as (select c_custkey from customer) select c_custkey as index_id, coalesce(max(o_orderkey), -1) + 1 as next_position from c left join orders on o_custkey = c_custkey group by 1")
def index_next_position(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey as index_id")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("index_id")).agg(F.max("o_orderkey").alias("m"))
    return c.join(o, "index_id", "left").select("index_id", (F.coalesce("m", F.lit(-1)) + 1).alias("next_position"))


@register("index_usage_month", f"{VIDEOS} select user_id, date_trunc('month', created_at)::date as month, ((sum(round(duration * 100)::bigint) + 30) // 60)::double / 100 as minutes from videos group by 1, 2")
def index_usage_month(spark, sf):
    return V.videos(spark, sf).groupBy("user_id", F.trunc(F.col("created_at").cast("date"), "month").alias("month")).agg(F.expr("cast((sum(cast(round(duration * 100) as bigint)) + 30) div 60 as double) / 100").alias("minutes"))


CHUNKS = f"{VIDEOS}, chunks as (select user_id as parent_id, video_id as chunk_offset, status, case when video_id % 11 = 0 then 0 else round(duration) end as duration, created_at, concat('v', user_id, ' [part ', video_id, ']') as filename from videos)"


def _chunks(spark, sf):
    return V.videos(spark, sf).selectExpr("user_id as parent_id", "video_id as chunk_offset", "status", "case when video_id % 11 = 0 then 0D else round(duration) end as duration", "created_at", "concat('v', user_id, ' [part ', video_id, ']') as filename")


@register("chunk_collapse", f"{CHUNKS} select parent_id, case when bool_and(status = 'ready') then 'ready' when bool_or(status in ('processing', 'queued')) then 'processing' when bool_or(status = 'error') then 'error' else 'ready' end as status, nullif(sum(duration), 0) as duration, min(created_at) as created_at, string_split((list(filename order by chunk_offset))[1], ' [part ')[1] as filename, count(*) as n_chunks from chunks group by parent_id")
def chunk_collapse(spark, sf):
    return rollups.collapse_chunks(_chunks(spark, sf))


@register("chunk_offsets", f"{CHUNKS} select parent_id, chunk_offset, round(coalesce(sum(duration) over (partition by parent_id order by chunk_offset rows between unbounded preceding and 1 preceding), 0), 3) as starts_at from chunks")
def chunk_offsets(spark, sf):
    return rollups.chunk_offsets(_chunks(spark, sf)).select("parent_id", "chunk_offset", "starts_at")


@register("usage_daily", f"{USAGE} select user_id, created_at::date as day, sum(prompt) as prompt, sum(completion) as completion, round(sum(cost_usd), 2) as cost_usd from usage where created_at >= timestamp '1996-01-01' and created_at < timestamp '1996-01-31' group by 1, 2")
def usage_daily(spark, sf):
    recent = V.usage(spark, sf).where("created_at >= timestamp_ntz'1996-01-01' and created_at < timestamp_ntz'1996-01-31'")
    return rollups.daily(recent, ["prompt", "completion", "cost_usd"], ["user_id"]).withColumn("cost_usd", F.round("cost_usd", 2))


@register("usage_daily_zero_filled", f"{USAGE}, u as (select model, created_at::date as day, sum(cost_usd) as cost_usd from usage where created_at >= timestamp '1996-01-01' and created_at < timestamp '1996-02-05' group by 1, 2), m as (select distinct model from u), d as (select model, unnest(generate_series(date '1996-01-01', date '1996-02-04', interval 1 day))::date as day from m) select d.model, datediff('day', date '1996-01-01', d.day) // 7 as week, count(*) as days, round(sum(coalesce(u.cost_usd, 0)), 2) as cost_usd from d left join u on d.model = u.model and d.day = u.day group by 1, 2")
def usage_daily_zero_filled(spark, sf):
    recent = V.usage(spark, sf).where("created_at >= timestamp_ntz'1996-01-01' and created_at < timestamp_ntz'1996-02-05'")
    filled = rollups.zero_filled(rollups.daily(recent, ["cost_usd"], ["model"]), "1996-01-01", "1996-02-04", "cost_usd", "model")
    return filled.groupBy("model", F.expr("cast(datediff(day, date'1996-01-01') div 7 as long)").alias("week")).agg(F.count("*").alias("days"), F.round(F.sum("cost_usd"), 2).alias("cost_usd"))


@register("platform_stats", f"{VIDEOS} select (select count(*) from customer) as n_users, count(*) as n_videos, count(*) filter (status = 'ready') as n_ready, round(sum(duration) / 60.0, 2) as minutes, count(distinct user_id) as n_owners, (select count(*) from lineitem) as n_segments from videos")
def platform_stats(spark, sf):
    v = V.videos(spark, sf).agg(F.count("*").alias("n_videos"), F.count_if(F.col("status") == "ready").alias("n_ready"), F.round(F.sum("duration") / 60.0, 2).alias("minutes"), F.countDistinct("user_id").alias("n_owners"))
    u = table(spark, sf, "customer").agg(F.count("*").alias("n_users"))
    s = table(spark, sf, "lineitem").agg(F.count("*").alias("n_segments"))
    return v.crossJoin(u).crossJoin(s)  # one row each


SUBS = "subs as (select c_custkey as user_id, c_mktsegment as plan_id from customer where c_custkey % 3 = 0)"


def _plans(spark, sf):
    c = table(spark, sf, "customer")
    subs = c.where("c_custkey % 3 = 0").selectExpr("c_custkey as user_id", "c_mktsegment as plan_id")
    return c.selectExpr("c_custkey as user_id", "c_name as name", "c_acctbal as balance").join(subs, "user_id", "left").withColumn("plan_id", F.coalesce("plan_id", F.lit("free")))


@register("users_per_plan", f"{SUBS} select coalesce(plan_id, 'free') as plan_id, count(*) as n_users from customer left join subs on c_custkey = user_id group by 1")
def users_per_plan(spark, sf):
    return _plans(spark, sf).groupBy("plan_id").agg(F.count("*").alias("n_users"))


@register("admin_users", f"{SUBS}, {VIDEOS}, v as (select user_id, count(*) as n_videos, round(sum(duration), 2) as duration from videos group by 1), u as (select c_custkey as user_id, c_name as name, coalesce(s.plan_id, 'free') as plan_id, coalesce(n_videos, 0) as n_videos, coalesce(duration, 0) as duration from customer left join subs s on s.user_id = c_custkey left join v on v.user_id = c_custkey where lower(c_name) like '%00%'), r as (select *, row_number() over (order by n_videos desc, user_id) as place from u) select * from r where place > 20 and place <= 40")
def admin_users(spark, sf):
    v = V.videos(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_videos"), F.round(F.sum("duration"), 2).alias("duration"))
    users = _plans(spark, sf).where(F.lower("name").contains("00")).join(v, "user_id", "left").select("user_id", "name", "plan_id", F.coalesce("n_videos", F.lit(0)).alias("n_videos"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
    page = users.orderBy(F.desc("n_videos"), "user_id").limit(40)  # a page of 20 after the first
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_videos"), "user_id"))).where("place > 20")


PRICES = (("model-", 0.5, 1.0), ("model-3", 0.25, 0.75), ("other", 9.0, 9.0))


@register("model_cost", f"{USAGE}, u as (select user_id, model, sum(prompt) as prompt, sum(completion) as completion from usage group by 1, 2) select user_id, model, prompt, completion, round(prompt / 1000 * case when model like 'model-3%' then 0.25 else 0.5 end + completion / 1000 * case when model like 'model-3%' then 0.75 else 1.0 end, 6) as cost from u")
def model_cost(spark, sf):
    prices = spark.createDataFrame(PRICES, "prefix string, price_in double, price_out double")
    u = V.usage(spark, sf).groupBy("user_id", "model").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    return rollups.priced(u, prices).select("user_id", "model", "prompt", "completion", "cost")


@register("bill_rollup", f"{USAGE} select coalesce(user_id, -1) as user_id, coalesce(model, '') as model, round(sum(prompt * 0.01 + completion * 0.02), 2) as amount from usage group by rollup (user_id, model)")
def bill_rollup(spark, sf):
    u = V.usage(spark, sf).rollup("user_id", "model").agg(F.round(F.sum(F.col("prompt") * 0.01 + F.col("completion") * 0.02), 2).alias("amount"))
    return u.select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("model", F.lit("")).alias("model"), "amount")


# --- knowledge graph ---------------------------------------------------------------------------------------------


@register("kg_mention_counts", f"{MENTIONS} select entity_id, count(segment_idx) as mentions, count(distinct video_id) as videos from mentions group by 1")
def kg_mention_counts(spark, sf):
    return V.mentions(spark, sf).groupBy("entity_id").agg(F.count("segment_idx").alias("mentions"), F.countDistinct("video_id").alias("videos"))


@register("kg_mentions_page", f"{MENTIONS}, {VIDEOS}, p as (select entity_id, m.video_id, segment_idx, status, row_number() over (partition by entity_id order by m.video_id, segment_idx) as place from mentions m join videos v on m.video_id = v.video_id) select * from p where place <= 50")
def kg_mentions_page(spark, sf):
    rows = V.mentions(spark, sf).join(V.videos(spark, sf).select("video_id", "status"), "video_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("video_id", "segment_idx"))).where("place <= 50").select("entity_id", "video_id", "segment_idx", "status", "place")


@register("kg_related", f"{RELS}, b as (select src as entity_id, dst as other, relation, weight, ord, 'out' as direction from rels union all select dst, src, relation, weight, ord, 'in' from rels), r as (select *, row_number() over (partition by entity_id order by weight desc, ord, direction, other, relation) as rank from b) select entity_id, other, relation, weight, direction, rank from r where rank <= 10")
def kg_related(spark, sf):
    rels = V.relations(spark, sf)
    out = rels.selectExpr("src as entity_id", "dst as other", "relation", "weight", "ord", "'out' as direction")
    both = out.unionByName(rels.selectExpr("dst as entity_id", "src as other", "relation", "weight", "ord", "'in' as direction"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "ord", "direction", "other", "relation"))).where("rank <= 10").select("entity_id", "other", "relation", "weight", "direction", "rank")


alias("kg_mentions_page_all", "kg_mentions_page")
alias("kg_related_all", "kg_related")


NODES = f"{RELS}, ends as (select src as id from rels union all select dst from rels), nodes as (select id, count(*) as degree from ends group by 1 order by degree desc, id desc limit 200)"


@register("kg_graph_nodes", f"{NODES} select * from nodes")
def kg_graph_nodes(spark, sf):
    return rollups.graph_nodes(V.relations(spark, sf), 200)


@register("kg_graph_edges", f"{NODES} select src, dst, relation, weight, ord from rels where src in (select id from nodes) and dst in (select id from nodes)")
def kg_graph_edges(spark, sf):
    rels = V.relations(spark, sf)
    return rollups.graph_edges(rels, rollups.graph_nodes(rels, 200)).select("src", "dst", "relation", "weight", "ord")


@register("kg_relation_upsert", f"{RELS}, st as (select src, dst, relation, max(weight) as weight, list_sort(list_distinct(flatten(list(segments)))) as segments from rels where ord % 2 = 0 group by 1, 2, 3), nw as (select src, dst, relation, weight, segments from rels where ord % 2 = 1 qualify row_number() over (partition by src, dst, relation order by ord) = 1), u as (select * from st union all select * from nw) select src, dst, relation, max(weight) as weight, array_to_string(list_sort(list_distinct(flatten(list(segments)))), ',') as segments from u group by 1, 2, 3")
def kg_relation_upsert(spark, sf):
    rels = V.relations(spark, sf)
    none = spark.createDataFrame([], rels.select("src", "dst", "relation", "weight", "segments").schema)
    old = rels.where("ord % 2 = 0").groupBy("src", "dst", "relation").agg(F.max("weight").alias("weight"), F.flatten(F.collect_list("segments")).alias("segments")).unionByName(none)
    return rollups.upsert_relations(old, rels.where("ord % 2 = 1")).withColumn("segments", F.array_join("segments", ","))


@register("kg_canonical_names", "n as (select trim(regexp_replace(regexp_replace(lower(concat(p_name, '-É_Ü/', p_type)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as name, p_type, p_partkey from part) select name, p_type as type, min(p_partkey) as entity_id, count(*) as n from n group by 1, 2")
def kg_canonical_names(spark, sf):
    return table(spark, sf, "part").groupBy(T.canonical(F.expr("concat(p_name, '-É_Ü/', p_type)")).alias("name"), F.col("p_type").alias("type")).agg(F.min("p_partkey").alias("entity_id"), F.count("*").alias("n"))


@register("kg_parse_records", """p as (select p_partkey as video_id, trim(p_name) as name, lower(trim(p_type)) as kind_of, p_brand as brand, p_size as size from part),
e as (select video_id, 'entity' as kind, name as a, kind_of as b, concat('made by ', brand) as description, '' as strength from p where video_id % 10 <> 0 union all select video_id, 'entity', brand, 'brand', 'a brand (', '' from p where video_id % 10 <> 0),
r as (select video_id, 'relationship' as kind, name as a, brand as b, 'is of' as description, size::varchar as strength from p where video_id % 10 <> 0) select * from e union all select * from r""")
def kg_parse_records(spark, sf):
    raw = F.expr("""case when p_partkey % 10 = 0 then 'no records' else concat('(\"entity\"<|>"', p_name, '"<|> ', p_type, '<|>made by ', p_brand, ')##(\"entity\"<|>', p_brand, '<|>Brand<|>a brand ( )',
        '##(\"relationship\"<|>', p_name, ' <|>', p_brand, '<|> is of <|>', p_size, ')<|COMPLETE|>(\"entity\"<|>late<|>x<|>y)') end""")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.explode(rollups.parse_graph_records(raw)).alias("r"))
    return rows.select("video_id", F.col("r")[0].alias("kind"), F.col("r")[1].alias("a"), F.when(F.col("r")[0] == "entity", F.lower(F.col("r")[2])).otherwise(F.col("r")[2]).alias("b"), F.col("r")[3].alias("description"), F.when(F.size("r") > 4, F.element_at("r", 5)).otherwise("").alias("strength"))


# --- timeline ----------------------------------------------------------------------------------------------------


@register("audio_event_runs", f"{SPANS}, top as (select * from spans where score >= 100), {RUNS.format(label='label', src='top')}, {ISLES.format(by='video_id, run', tie='ord', src='runs', gap=1.0)} select video_id, label, min(t_start) as t_start, max(t_end) as t_end, max(score) as score, min(ord) as ord from b group by video_id, run, label, isle")
def audio_event_runs(spark, sf):
    return intervals.merge_labels(V.spans(spark, sf).where("score >= 100"))


@register("speaker_numbers", f"{TURNS}, f as (select video_id, speaker, min(t_start) as first_at, min(ord) as first_ord from turns group by 1, 2), n as (select *, row_number() over (partition by video_id order by first_at, first_ord) as number from f) select t.video_id, t.ord, n.number, substr(concat('Speaker ', n.number, ': ', t.text), 1, 200) as label from turns t join n on t.video_id = n.video_id and t.speaker = n.speaker")
def speaker_numbers(spark, sf):
    return timeline.numbered_speakers(V.turns(spark, sf)).select("video_id", "ord", "number", "label")


@register("spoken_topics", f"{TURNS}, w as (select video_id, floor(t_start / 30)::bigint as window_idx, min(t_start) as t_start, max(t_end) as t_end, bool_or(coalesce(trim(text), '') <> '') as spoken, count(*) as n_turns from turns group by 1, 2) select * from w where spoken")
def spoken_topics(spark, sf):
    return timeline.spoken_windows(V.turns(spark, sf), 30.0)


@register("sports_flags", f"{SPANS} select video_id, ord, case when score >= 294 then 'high' when score >= 171.5 then 'medium' else 'low' end as intensity, case when label like '%click%' then 'click' else 'purchase' end as event from spans where (label like '%click%' or label like '%purchase%') and score / 490 >= 0.15")
def sports_flags(spark, sf):
    return timeline.keyword_flags(V.spans(spark, sf).withColumn("score", F.col("score") / 490), ["click", "purchase"]).select("video_id", "ord", "intensity", "event")


@register("windows_summary_grid", f"{TURNS}, g as (select video_id, floor(t_start / 30)::bigint as window_idx, list(ord order by ord)[1:24] as ords, max(t_end) as last_end from turns group by 1, 2), m as (select *, max(window_idx) over (partition by video_id) as final from g) select video_id, window_idx, window_idx * 30.0::double as t_start, case when window_idx = final then last_end else (window_idx + 1) * 30.0::double end as t_end, array_to_string(ords, ',') as segment_ids from m")
def windows_summary_grid(spark, sf):
    return timeline.summary_grid(V.turns(spark, sf), 30.0).withColumn("segment_ids", F.array_join("segment_ids", ","))


@register("timeline_tracks", f"{TURNS}, {SPANS}, k as (select 'speakers' as kind, video_id, count(*) as n, min(t_start) as t_start, max(t_end) as t_end from turns group by 2 union all select 'audio_events', video_id, count(*), min(t_start), max(t_end) from spans where score >= 100 group by 2) select * from k")
def timeline_tracks(spark, sf):
    return timeline.tracks({"speakers": V.turns(spark, sf), "audio_events": V.spans(spark, sf).where("score >= 100")})


# --- evaluation --------------------------------------------------------------------------------------------------


@register("eval_confusion", f"{CASES} select expected, predicted, count(*) as n from cases group by 1, 2")
def eval_confusion(spark, sf):
    return rollups.confusion(V.cases(spark, sf))


@register("eval_prf", f"{CASES}, t as (select expected as tool from cases union select predicted from cases), c as (select tool, (select count(*) from cases where expected = tool and predicted = tool) as tp, (select count(*) from cases where expected <> tool and predicted = tool) as fp, (select count(*) from cases where expected = tool and predicted <> tool) as fn from t) select tool, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 9) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 9) as f1 from c")
def eval_prf(spark, sf):
    return rollups.precision_recall(V.cases(spark, sf)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@register("eval_summary", f"{CASES} select count(*) as total, count(*) filter (expected = predicted and coalesce(arg_ok, true)) as passed, round(avg(case when arg_ok is null then null when arg_ok then 1.0 else 0.0 end), 9) as arg_rate, round(avg(completion), 9) as completion from cases")
def eval_summary(spark, sf):
    return V.cases(spark, sf).agg(F.count("*").alias("total"), F.count_if((F.col("expected") == F.col("predicted")) & F.coalesce("arg_ok", F.lit(True))).alias("passed"), F.round(F.avg(F.col("arg_ok").cast("double")), 9).alias("arg_rate"), F.round(F.avg("completion"), 9).alias("completion"))


@register("sequence_check", f"{SPANS}, s as (select video_id as seq, ord, score >= 5 as found, t_start, lag(t_start) over (partition by video_id order by ord) as late from spans) select seq, bool_and(found and coalesce(late <= t_start, true)) as in_order, count(*) as n_steps from s group by 1")
def sequence_check(spark, sf):
    return intervals.rolling_order_ok(V.spans(spark, sf).selectExpr("video_id as seq", "ord", "score >= 5 as found", "t_start"))


@register("messages_ordered", "m as (select conv_id, turn, role, text from conversations) select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, role, text from m")
def messages_ordered(spark, sf):
    return table(spark, sf, "conversations").withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).select("conv_id", "position", "role", "text")


@register("excitement_fuse", f"{SAL}, s as (select video_id, clip_idx, score as a, (clip_idx * 37 % 101)::double as v from sal), n as (select *, min(a) over p as a0, max(a) over p as a1, min(v) over p as v0, max(v) over p as v1 from s window p as (partition by video_id)) select video_id, clip_idx, round(0.7 * case when v1 > v0 then (v - v0) / (v1 - v0) else v end + 0.3 * case when a1 > a0 then (a - a0) / (a1 - a0) else a end, 6) as fused from n")
def excitement_fuse(spark, sf):
    rows = V.saliency(spark, sf).selectExpr("video_id", "clip_idx", "score as a", "cast(clip_idx * 37 % 101 as double) as v")
    return rows.select("video_id", "clip_idx", F.round(0.7 * fusion.min_max("v", "video_id") + 0.3 * fusion.min_max("a", "video_id"), 6).alias("fused"))


MEDIAN = "list_transform(range(n), lambda i: list_median(list_transform(range(i - 6, i + 6), lambda j: {x}[greatest(1, least(n, j + 1))])))"


@register("audio_z_peaks", f"""{SAL}, g as (select video_id, list(score order by clip_idx) as x, count(*)::int as n from sal group by 1),
a as (select *, case when n < 12 then list_transform(x, lambda v: list_median(x)) else {MEDIAN.format(x='x')} end as floor_ from g),
b as (select *, list_transform(range(n), lambda i: abs(x[i + 1] - floor_[i + 1])) as off_ from a),
c as (select *, case when n < 12 then list_transform(x, lambda v: list_median(off_)) else {MEDIAN.format(x='off_')} end as mad from b),
d as (select *, list_transform(mad, lambda m: 1.4826 * m) as scale from c),
e as (select *, coalesce(list_median(list_filter(scale, lambda s: s > 0)), 1.0) as usual from d),
f as (select video_id, x, n, list_transform(range(n), lambda i: (x[i + 1] - floor_[i + 1]) / case when scale[i + 1] < 1e-6 then usual else scale[i + 1] end) as z from e),
t as (select video_id, list_transform(list_filter(range(n), lambda i: z[i + 1] >= 1.5 and z[i + 1] >= coalesce(z[i], z[i + 1]) and z[i + 1] >= coalesce(z[i + 2], z[i + 1])), lambda i: {{'i': i, 'x': x[i + 1], 'z': z[i + 1]}}) as tops from f),
o as (select video_id, unnest(tops) as p, unnest(range(len(tops))) as k from t),
rec as (select * from (with recursive r as (select video_id, k, [p] as kept from o where k = 0 union all select o.video_id, o.k, case when (o.p.i - r.kept[-1].i) * 0.5 >= 2.0 then list_append(r.kept, o.p) when o.p.x > r.kept[-1].x then list_append(r.kept[:-2], o.p) else r.kept end from r join o on o.video_id = r.video_id and o.k = r.k + 1) select * from r)),
last as (select video_id, kept from rec qualify row_number() over (partition by video_id order by k desc) = 1)
select video_id, k.i::bigint as clip_idx, round(k.z, 6) as z from (select video_id, unnest(kept) as k from last)""")
def audio_z_peaks(spark, sf):
    return timeline.z_peaks(V.saliency(spark, sf)).select("video_id", "clip_idx", _r("z"))


from . import records, search, segments  # noqa: E402, F401  they register more queries
