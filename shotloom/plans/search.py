"""Queries over scoped search, streams of candidates and subscriptions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounts, fusion, intervals, ranking, token_index, vector_index, vectors
from ..sources import folders
from ..sources import views as V
from ..sources.views import table
from .catalogue import FUSED, HITS, MENTIONS, NMS, SAL, SHOTS, SPANS, STOP, TOKENS, VIDEOS, _fused, _hits, _r
from .records import _any
from .registry import register

SCOPED = "sc as (select q.shot_idx as q_id, s.shot_idx, s.video_id, s.crop, s.t_start, s.t_end, list_cosine_similarity(s.vector, q.vector) as score from shots q join shots s on {on} where q.shot_idx % 50 = 0 and {where}), scoped as (select *, row_number() over (partition by q_id order by round(score, 9) desc, shot_idx) as rank from sc)"


def _scoped(spark, sf, scope: str, k: int, where: str = "true") -> DataFrame:
    """Hits of every fiftieth shot among the shots with its value of ``scope``."""
    shots = V.shots(spark, sf).withColumn("scope", F.expr(scope))
    seeds = shots.where("shot_idx % 50 = 0").selectExpr("shot_idx as q_id", "vector", "scope")
    found = vectors.top_k(shots.where(where).withColumnRenamed("shot_idx", "item_id"), seeds, k, by="scope")
    return found.join(shots.selectExpr("shot_idx as item_id", "video_id", "crop", "t_start", "t_end"), "item_id").withColumnRenamed("item_id", "shot_idx")


@register("vec_topk_in_index", f"""{SHOTS}, {SCOPED.format(on='q.video_id % 4 = s.video_id % 4', where='true')}, f as (select *, row_number() over (partition by q_id, video_id order by rank) as n from scoped where rank <= 25), g as (select *, row_number() over (partition by q_id order by rank) as place from f where n = 1)
select q_id, video_id, shot_idx, place as rank, round(score, 6) as score, coalesce(nullif(case when shot_idx % 2 = 0 then '' else text end, ''), concat('asr ', shot_idx)) as transcript from g left join documents on doc_id = shot_idx where place <= 5""")
def vec_topk_in_index(spark, sf):
    best = vectors.first_per(_scoped(spark, sf, "video_id % 4", 25), ["video_id"], 5)
    docs = table(spark, sf, "documents").selectExpr("doc_id as shot_idx", "if(doc_id % 2 = 0, '', text) as said")
    return best.join(docs, "shot_idx", "left").select("q_id", "video_id", "shot_idx", "rank", _r("score"), F.coalesce(F.nullif("said", F.lit("")), F.concat(F.lit("asr "), "shot_idx")).alias("transcript"))


@register("vec_video_topk_merged", f"""{SHOTS}, {SCOPED.format(on='q.video_id = s.video_id', where='not s.crop')}, h as (select * from scoped where rank <= 10), a as (select *, max(t_end) over (partition by q_id order by t_start, shot_idx rows between unbounded preceding and 1 preceding) as reach from h), b as (select *, sum(case when t_start > reach + 1 then 1 else 0 end) over (partition by q_id order by t_start, shot_idx rows unbounded preceding) as isle from a)
select q_id, min(t_start) as t_start, max(t_end) as t_end, round(max(score), 6) as score, (list(shot_idx order by score desc, t_start, shot_idx))[1] as shot_idx, count(*) as n_shots from b group by q_id, isle""")
def vec_video_topk_merged(spark, sf):
    hits = _scoped(spark, sf, "video_id", 10, "not crop").selectExpr("q_id as video_id", "shot_idx", "t_start", "t_end", "score", "'' as asr_text")
    return intervals.merge_contiguous(hits).select(F.col("video_id").alias("q_id"), "t_start", "t_end", _r("score"), "shot_idx", "n_shots")


@register("vec_video_topk_image", f"{SHOTS}, {SCOPED.format(on='q.video_id = s.video_id', where='true')} select q_id, shot_idx, rank, round(score, 6) as score from scoped where rank <= 10")
def vec_video_topk_image(spark, sf):
    return _scoped(spark, sf, "video_id", 10).select("q_id", "shot_idx", "rank", _r("score"))


@register("vec_brand_boost", f"""{SHOTS}, {HITS}, w as (select doc_id as q_id, list_filter(string_split(lower(text), ' ')[1:2], lambda t: t <> '') as brands from documents), b as (select h.q_id, shot_idx, rank as before, score + case when len(list_filter(brands, lambda t: contains(lower(text), t))) > 0 then 0.15 else 0 end as score from hits h join documents on shot_idx = doc_id join w on w.q_id = h.q_id where rank <= 50), r as (select *, row_number() over (partition by q_id order by round(score, 9) desc, before) as rank from b) select q_id, shot_idx, rank, round(score, 6) as score from r where rank <= 10""")
def vec_brand_boost(spark, sf):
    docs = table(spark, sf, "documents")
    brands = docs.select(F.col("doc_id").alias("q_id"), F.expr("filter(slice(split(lower(text), ' '), 1, 2), t -> t <> '')").alias("brands"))
    rows = _hits(spark, sf, 50).join(docs.select(F.col("doc_id").alias("shot_idx"), "text"), "shot_idx").join(brands, "q_id")
    return fusion.boosted(rows, F.exists("brands", lambda t: F.contains(F.lower("text"), t)), 0.15).where("rank <= 10").select("q_id", "shot_idx", "rank", _r("score"))


@register("vec_motion_by_video", f"{SHOTS}, {HITS}, f as (select *, row_number() over (partition by q_id, video_id order by rank) as n from hits where rank <= 12), g as (select *, row_number() over (partition by q_id order by rank) as place from f where n = 1) select q_id, video_id, shot_idx, place as rank, round(score, 6) as score from g where place <= 4")
def vec_motion_by_video(spark, sf):
    return vectors.first_per(_hits(spark, sf, max(3 * 4, 12)), ["video_id"], 4).select("q_id", "video_id", "shot_idx", "rank", _r("score"))


@register("vec_normalized", "p as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select vec_id, round(v[1] / greatest(n, 1e-12), 6) as first, round(v[len(v)] / greatest(n, 1e-12), 6) as last, round(list_sum(v) / greatest(n, 1e-12), 6) as total from p")
def vec_normalized(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.normalized("embedding").alias("v"))
    return rows.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


ENTITIES = "ents as (select vec_id as entity_id, vec_id % 4 as index_id, case vec_id % 8 when 0 then 'person' when 1 then 'concept' when 2 then 'tool' when 3 then null when 4 then 'object' when 5 then 'event' else 'method' end as type, embedding::double[] as v from embeddings)"


@register("concept_topk", f"""{ENTITIES}, {MENTIONS}, s as (select q.entity_id as q_id, e.entity_id, e.type, list_cosine_similarity(e.v, q.v) as score from ents q join ents e on e.index_id = q.index_id where q.entity_id % 50 = 0 and coalesce(e.type not in ('person', 'organization', 'location', 'event', 'tool'), true)),
r as (select *, row_number() over (partition by q_id order by round(score, 9) desc, entity_id) as rank from s), c as (select entity_id, count(segment_idx) as mentions, count(distinct video_id) as videos from mentions group by 1) select q_id, r.entity_id, type, rank, round(score, 6) as score, coalesce(mentions, 0) as mentions, coalesce(videos, 0) as videos from r left join c on c.entity_id = r.entity_id where rank <= 10""")
def concept_topk(spark, sf):
    ents = table(spark, sf, "embeddings").selectExpr("vec_id as entity_id", "vec_id % 4 as index_id", "case vec_id % 8 when 0 then 'person' when 1 then 'concept' when 2 then 'tool' when 3 then null when 4 then 'object' when 5 then 'event' else 'method' end as type", "embedding as vector")
    asked = ents.where("entity_id % 50 = 0").selectExpr("entity_id as q_id", "index_id", "vector")
    counts = V.mentions(spark, sf).groupBy("entity_id").agg(F.count("segment_idx").alias("mentions"), F.countDistinct("video_id").alias("videos"))
    found = vectors.concepts(ents, asked, counts, 10, by="index_id")
    return found.select("q_id", "entity_id", "type", "rank", _r("score"), "mentions", "videos")


@register("qa_segments", f"""q as (select conv_id as video_id, (list(coalesce(text, '') order by turn))[1] as question from conversations group by 1), i as (select video_id, {_any("lower(question)", T.SUMMARY_CUES)} or video_id % 5 = 0 as summary from q),
s as (select c.conv_id as video_id, c.turn as ord, summary, row_number() over (partition by c.conv_id order by case when summary then turn else -(turn * 37 % 101) end, turn) as place from conversations c join i on i.video_id = c.conv_id) select video_id, ord, summary, place from s where place <= case when summary then 600 else 3 end""")
def qa_segments(spark, sf):
    turns = table(spark, sf, "conversations")
    intent = turns.groupBy(F.col("conv_id").alias("video_id")).agg(F.min_by(F.coalesce("text", F.lit("")), "turn").alias("question"))
    intent = intent.select("video_id", (T.any_term(F.col("question"), list(T.SUMMARY_CUES)) | (F.col("video_id") % 5 == 0)).alias("summary"))
    rows = turns.selectExpr("conv_id as video_id", "turn as ord", "turn * 37 % 101 as score").join(intent, "video_id")
    return fusion.best_or_all(rows, 3, 600).select("video_id", "ord", "summary", "place")


# --- fused streams -----------------------------------------------------------------------------------------------

STREAMS = {"visual": "true", "event:vlm_actions": "shot_idx % 2 = 0", "segment": "shot_idx % 3 = 0", "audio": "shot_idx % 5 = 1", "motion": "shot_idx % 7 = 0"}
_W = {"visual": "1.0", "event:vlm_actions": "1.2", "segment": f"1.0 + case when {_any('q', T.TEXT_CUES)} then 0.6 else 0 end", "audio": f"1.0 + case when {_any('q', T.AUDIO_CUES)} then 0.5 else 0 end", "motion": "1.0"}
WHEN = f"{SHOTS}, {SCOPED.format(on='q.video_id = s.video_id', where='true')}, qs as (select doc_id as q_id, lower(coalesce(text, '')) as q from documents), cands as (" + " union all ".join(
    f"select q_id::varchar as grp, q_id, shot_idx * 10 + {k} as ord, t_start + {k} as t_start, t_end + {k} as t_end, '{name}' as source, '{name.partition(':')[0]}' as family, score from (select *, row_number() over (partition by q_id order by rank) as n from scoped where {where}) where n <= 10" for k, (name, where) in enumerate(STREAMS.items())
) + "), mx as (select *, max(score) over (partition by grp, family) as top from cands), weighted as (select grp, ord, t_start, t_end, family, source, round(score / case when top > 0 then top else 1 end * case source " + " ".join(f"when '{name}' then {w}" for name, w in _W.items()) + " end, 9) as score from mx left join qs using (q_id))"


def _when_candidates(spark, sf) -> DataFrame:
    streams = {name: _scoped(spark, sf, "video_id", 10, where).withColumn("ord", F.col("shot_idx") * 10 + k).withColumn("t_start", F.col("t_start") + k).withColumn("t_end", F.col("t_end") + k) for k, (name, where) in enumerate(STREAMS.items())}
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("q_id"), F.coalesce("text", F.lit("")).alias("query"))
    return fusion.when_candidates(streams, asked).withColumn("group", F.col("q_id").cast("string")).withColumn("score", F.round("score", 9))


@register("when_streams", f"{WHEN} select grp as \"group\", ord, source, round(score, 6) as score from weighted")
def when_streams(spark, sf):
    return _when_candidates(spark, sf).select("group", "ord", "source", _r("score"))


@register("when_answer", f"{WHEN}, {NMS.format(src='weighted')} select grp as \"group\", k.i as ord, k.s as t_start, k.e as t_end, rank::int as rank from out where rank < 10")
def when_answer(spark, sf):
    return intervals.temporal_nms(_when_candidates(spark, sf)).where("rank < 10").select("group", "ord", "t_start", "t_end", "rank")


@register("image_pool", f"{SHOTS}, {HITS}, st as (select q_id, 0 as stream, shot_idx as key, round(score, 9) as score from hits where rank <= 10 union all select q_id, 1, shot_idx // 2 * 2, round(score * 1.02, 9) from hits where rank <= 12 union all select q_id, 2, shot_idx, 0.0 from hits where rank between 3 and 20 union all select q_id, 3, shot_idx // 3 * 3, round(score, 9) from hits where rank <= 8), r as (select *, row_number() over (partition by q_id, key order by score desc, stream) as n from st) select q_id, key, stream, round(score, 6) as score from r where n = 1")
def image_pool(spark, sf):
    h = _hits(spark, sf, 20)
    parts = [h.where("rank <= 10").selectExpr("q_id", "0 as stream", "shot_idx as key", "round(score, 9) as score"), h.where("rank <= 12").selectExpr("q_id", "1 as stream", "shot_idx div 2 * 2 as key", "round(score * 1.02, 9) as score"), h.where("rank between 3 and 20").selectExpr("q_id", "2 as stream", "shot_idx as key", "0D as score"), h.where("rank <= 8").selectExpr("q_id", "3 as stream", "shot_idx div 3 * 3 as key", "round(score, 9) as score")]
    return fusion.best_of_streams(parts).select("q_id", "key", "stream", _r("score"))


@register("fused_by_video", f"{FUSED}, f as (select q_id, key, label as video_id, rank from fused join embeddings on vec_id = key), n as (select *, row_number() over (partition by q_id, video_id order by rank) as n from f), g as (select *, row_number() over (partition by q_id order by rank) as place from n where n = 1) select q_id, video_id, key, place as rank from g where place <= 5")
def fused_by_video(spark, sf):
    rows = _fused(spark, sf).join(table(spark, sf, "embeddings").selectExpr("vec_id as key", "label as video_id"), "key")
    return vectors.first_per(rows, ["video_id"], 5).select("q_id", "video_id", "key", "rank")


@register("ocr_stream", f"d as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({STOP}))) as t from documents), q as (select item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({STOP}))) as t from benchmark), dt as (select doc_id, unnest(t) as t from d), qt as (select item_id, unnest(t) as t from q), o as (select item_id, doc_id, count(*) as shared from dt join qt using (t) group by 1, 2), r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as rank, count(*) filter (shared >= 2) over (partition by item_id) as n_strong from o) select item_id, doc_id, shared, shared >= 2 as strong, n_strong, rank from r where rank <= 10")
def ocr_stream(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))  # the items' tokens are the ones that count
    items = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text"), 2, T.STOPWORDS).alias("tokens"))
    return ranking.top_and_strong(docs, items, 10, 2).select("item_id", "doc_id", "shared", (F.col("shared") >= 2).alias("strong"), "n_strong", "rank")


# --- scope and membership ----------------------------------------------------------------------------------------


@register("hits_in_scope", f"{SHOTS}, {HITS}, {VIDEOS} select q_id, shot_idx, rank from hits where rank <= 20 and exists (select 1 from videos v where v.video_id = hits.shot_idx and v.status = 'ready' and v.user_id % 2 = 0)")
def hits_in_scope(spark, sf):
    hits = _hits(spark, sf, 20).select("q_id", "shot_idx", "rank", F.col("shot_idx").alias("scope_id"))
    return accounts.in_scope(hits.drop("video_id").withColumnRenamed("scope_id", "video_id"), V.videos(spark, sf).where("user_id % 2 = 0")).select("q_id", "shot_idx", "rank")


@register("hits_with_metadata", f"{SHOTS}, {HITS}, {VIDEOS} select q_id, shot_idx, rank, round(v.duration, 2) as duration, v.user_id from hits join videos v on v.video_id = shot_idx where rank <= 20 and v.status = 'ready'")
def hits_with_metadata(spark, sf):
    ready = V.videos(spark, sf).where("status = 'ready'").select(F.col("video_id").alias("shot_idx"), "duration", "user_id")
    return _hits(spark, sf, 20).join(ready, "shot_idx").select("q_id", "shot_idx", "rank", F.round("duration", 2).alias("duration"), "user_id")


@register("index_membership", "m as (select distinct l_orderkey as index_id, l_partkey as video_id from lineitem), r as (select o_orderkey as request_id, o_orderkey as index_id, case when o_orderkey % 4 = 0 then [] else [o_custkey, o_custkey, 1] end as videos from orders), n as (select distinct request_id, index_id, unnest(videos) as video_id from r), a as (select request_id, n.index_id, n.video_id, m.video_id is not null as known from n left join m on m.index_id = n.index_id and m.video_id = n.video_id), e as (select request_id, r.index_id, m.video_id, true from r join m on m.index_id = r.index_id where len(videos) = 0) select * from a union all select * from e")
def index_membership(spark, sf):
    members = table(spark, sf, "lineitem").selectExpr("l_orderkey as index_id", "l_partkey as video_id").distinct()
    requests = table(spark, sf, "orders").selectExpr("o_orderkey as request_id", "o_orderkey as index_id", "if(o_orderkey % 4 = 0, cast(array() as array<bigint>), array(o_custkey, o_custkey, 1L)) as videos")
    return accounts.resolved_members(requests, members)


@register("filter_boolean", f"{SPANS}, t as (select video_id, ord, case when ord % 4 = 0 then null else label end as label, score from spans) select video_id, ord from t where score >= 10 and (label = 'view' or ord % 3 = 0) and coalesce(label not in ('click', 'error'), true)")
def filter_boolean(spark, sf):
    rows = V.spans(spark, sf).select("video_id", "ord", F.expr("if(ord % 4 = 0, null, label)").alias("label"), "score")
    return rows.where(fusion.keeps(must=[F.col("score") >= 10], should=[F.col("label") == "view", F.col("ord") % 3 == 0], must_not=[F.col("label").isin("click", "error")])).select("video_id", "ord")


@register("shots_without_crop", f"{SHOTS}, c as (select video_id, shot_idx, case when crop then shot_idx end as crop_id from shots) select video_id, shot_idx from c where crop_id is null")
def shots_without_crop(spark, sf):
    return V.shots(spark, sf).selectExpr("video_id", "shot_idx", "case when crop then shot_idx end as crop_id").where(F.col("crop_id").isNull()).select("video_id", "shot_idx")


@register("shots_deduped", "p as (select doc_id % 97 as video_id, doc_id // 97 % 5 as idx, doc_id as arrival, case when doc_id % 3 = 0 then ' ' else substr(coalesce(text, ''), 1, 30) end as caption, case when doc_id % 11 = 0 then null else doc_id * 1.0::double end as t_start from documents), r as (select *, row_number() over (partition by video_id, idx order by case when trim(coalesce(caption, '')) = '' then 1 else 0 end, arrival) as n from p where t_start is not null) select video_id, idx, arrival from r where n = 1")
def shots_deduped(spark, sf):
    points = table(spark, sf, "documents").selectExpr("doc_id % 97 as video_id", "doc_id div 97 % 5 as idx", "doc_id as arrival", "if(doc_id % 3 = 0, ' ', substring(coalesce(text, ''), 1, 30)) as caption", "if(doc_id % 11 = 0, cast(null as double), doc_id * 1D) as t_start", "doc_id * 1D + 1 as t_end")
    return V.one_per_shot(points).select("video_id", "idx", "arrival")


@register("subscription_state", """ev as (select event_id as ord, user_id, ts as t0, case event_type when 'signup' then 'checkout.session.completed' when 'purchase' then 'customer.subscription.updated' when 'click' then 'customer.subscription.created' when 'error' then 'customer.subscription.deleted' else 'other' end as type, case event_id % 4 when 0 then 'active' when 1 then 'past_due' when 2 then '' end as status, case when event_id % 2 = 0 then concat('c', event_id) end as customer, case when event_id % 3 = 0 then event_id end as period_end from events),
x as (select *, case when type = 'checkout.session.completed' then 'developer' when type like '%created' or type like '%updated' then case when status = 'active' then 'developer' end when type like '%deleted' then 'free' end as p, case when type = 'checkout.session.completed' then 'active' when type like '%created' or type like '%updated' then nullif(status, '') when type like '%deleted' then 'canceled' end as s, case when type = 'checkout.session.completed' then customer end as c, case when type like '%created' or type like '%updated' then period_end end as e from ev)
select user_id, coalesce((list(p order by t0 desc, ord desc) filter (p is not null))[1], 'free') as plan_id, coalesce((list(s order by t0 desc, ord desc) filter (s is not null))[1], 'active') as status, (list(c order by t0 desc, ord desc) filter (c is not null))[1] as customer, (list(e order by t0 desc, ord desc) filter (e is not null))[1] as period_end from x group by 1""")
def subscription_state(spark, sf):
    kind = "case event_type when 'signup' then 'checkout.session.completed' when 'purchase' then 'customer.subscription.updated' when 'click' then 'customer.subscription.created' when 'error' then 'customer.subscription.deleted' else 'other' end as type"
    events = table(spark, sf, "events").selectExpr("event_id as ord", "user_id", "ts as at", kind, "case event_id % 4 when 0 then 'active' when 1 then 'past_due' when 2 then '' end as status", "if(event_id % 2 = 0, concat('c', event_id), null) as customer", "if(event_id % 3 = 0, event_id, null) as period_end")
    return accounts.latest_subscription(events)


@register("every_other_window", f"{SPANS}, w as (select video_id, ord, row_number() over (partition by video_id order by t_start, ord) as n from spans) select video_id, ord from w where n % 2 = 1")
def every_other_window(spark, sf):
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t_start", "ord"))
    return V.spans(spark, sf).withColumn("n", n).where("n % 2 = 1").select("video_id", "ord")


@register("videos_page", f"{VIDEOS}, n as (select video_id, concat('Clip ', video_id) as name, created_at, duration from videos), p as (select *, row_number() over (order by duration desc, video_id) as place from n where contains(lower(name), 'p 1')) select video_id, name, created_at, round(duration, 2) as duration, place from p where place between 201 and 300")
def videos_page(spark, sf):
    videos = V.videos(spark, sf).selectExpr("video_id", "concat('Clip ', video_id) as name", "created_at", "duration")
    return accounts.page_of(videos, "P 1", "duration", 3, 500).withColumn("duration", F.round("duration", 2))


# --- stored index ------------------------------------------------------------------------------------------------


@register("vec_topk_indexed", f"{SHOTS}, {HITS} select q_id, shot_idx, rank, round(score, 6) as score from hits where rank <= 10")
def vec_topk_indexed(spark, sf):
    items = V.shots(spark, sf).select(F.col("shot_idx").alias("item_id"), "vector", "video_id", "crop")
    seeds = V.shots(spark, sf).where("shot_idx % 50 = 0").selectExpr("shot_idx as q_id", "vector")
    with folders.scratch(spark) as path:
        vector_index.build_index(items, path)
        hits = folders.durable(vector_index.search_index(spark, path, seeds, 10))
    return hits.select("q_id", F.col("item_id").alias("shot_idx"), "rank", _r("score"))


@register("vec_topk_indexed_filtered", f"{SHOTS}, {HITS}, f as (select *, row_number() over (partition by q_id order by rank) as n from hits where not crop and video_id in (1, 2, 3)) select q_id, shot_idx, n as rank, round(score, 6) as score from f where n <= 10")
def vec_topk_indexed_filtered(spark, sf):
    items = V.shots(spark, sf).select(F.col("shot_idx").alias("item_id"), "vector", "video_id", "crop")
    seeds = V.shots(spark, sf).where("shot_idx % 50 = 0").selectExpr("shot_idx as q_id", "vector")
    with folders.scratch(spark) as path:
        # half of the items come with the index, the others are added to it
        vector_index.build_index(items.where("item_id % 2 = 0"), path)
        vector_index.upsert_index(items.where("item_id % 2 = 1"), path)
        hits = folders.durable(vector_index.search_index(spark, path, seeds, 10, "not crop and video_id in (1, 2, 3)"))
    return hits.select("q_id", F.col("item_id").alias("shot_idx"), "rank", _r("score"))


# --- what is seen and heard --------------------------------------------------------------------------------------

GATES = "gates as (select doc_id as q_id, doc_id % 40 as video_id, list_reduce(list_prepend(0.0::double, [" + ", ".join(f"case when contains(q, '{t}') then {w}::double else -1.0::double end" for t, w in T.HEARD.items()) + "]), lambda s, w: case when w < 0 then s else least(1.0, greatest(s, w) + 0.1 * w) end) as gate from (select doc_id, lower(coalesce(text, '')) as q from documents))"


@register("excitement_gated", f"{SAL}, {GATES}, s as (select video_id, clip_idx, score as a, (clip_idx * 37 % 101)::double as v from sal), n as (select *, min(a) over p as a0, max(a) over p as a1, min(v) over p as v0, max(v) over p as v1 from s window p as (partition by video_id)), f as (select q_id, n.video_id, clip_idx, gate, (1 - gate) * case when v1 > v0 then (v - v0) / (v1 - v0) else v end + gate * case when a1 > a0 then (a - a0) / (a1 - a0) else a end as fused from n join gates using (video_id)) select q_id, video_id, clip_idx, round(gate, 6) as weight, round(fused, 6) as fused, row_number() over (partition by q_id order by round(fused, 9) desc, clip_idx) as rank from f qualify rank <= 5")
def excitement_gated(spark, sf):
    signals = V.saliency(spark, sf).selectExpr("video_id", "clip_idx", "cast(clip_idx * 37 % 101 as double) as seen", "score as heard")
    gates = table(spark, sf, "documents").select(F.col("doc_id").alias("q_id"), F.expr("doc_id % 40").alias("video_id"), T.lexical_gate(F.coalesce("text", F.lit(""))).alias("gate"))
    best = fusion.gated_best(signals, gates, 5)
    return best.select("q_id", "video_id", "clip_idx", _r("weight"), _r("fused"), "rank")


@register("vec_softly_normalized", f"{SHOTS}, n as (select shot_idx, vector, sqrt(list_dot_product(vector, vector)) + 1e-8 as norm from shots) select shot_idx, i - 1 as i, round(x / norm, 6) as x from (select shot_idx, norm, unnest(vector) as x, generate_subscripts(vector, 1) as i from n)")
def vec_softly_normalized(spark, sf):
    rows = V.shots(spark, sf).select("shot_idx", vectors.softly_normalized("vector").alias("v"))
    return rows.select("shot_idx", F.posexplode("v").alias("i", "x")).select("shot_idx", F.col("i").cast("long").alias("i"), _r("x"))


# --- stored index of tokens --------------------------------------------------------------------------------------


def _dealt(spark, sf) -> DataFrame:
    """The documents, dealt out before their words are taken: a file may be one task's."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ranking.DEALT)), "doc_id")


@register("token_overlap_indexed", f"{TOKENS}, o as (select item_id, doc_id, count(*) as shared from d join q using (t) group by 1, 2), r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as rank from o) select item_id, doc_id, shared, rank from r where rank <= 10")
def token_overlap_indexed(spark, sf):
    docs = _dealt(spark, sf).select("doc_id", T.tokens(F.col("text"), 2, T.STOPWORDS).alias("tokens"))
    items = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text"), 2, T.STOPWORDS).alias("tokens"))
    with folders.scratch(spark) as path:
        token_index.build_token_index(docs, path)
        return folders.durable(token_index.indexed_overlap(spark, path, items))


@register("ocr_fulltext_indexed", "d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents) select doc_id from d where list_contains(w, 'the') and list_contains(w, 'of') and list_contains(w, 'by')")
def ocr_fulltext_indexed(spark, sf):
    docs = _dealt(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    with folders.scratch(spark) as path:
        # a third of the documents come later
        token_index.build_token_index(docs.where("doc_id % 3 > 0"), path)
        token_index.upsert_tokens(docs.where("doc_id % 3 = 0"), path)
        return folders.durable(token_index.indexed_fulltext(spark, path, ["the", "of", "by"]))
