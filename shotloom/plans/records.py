"""Queries over texts and records, the knowledge graph, usage and accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import accounts, entities, rollups
from ..sources import folders, sinks, snapshots
from ..sources import views as V
from ..sources.views import table
from .catalogue import CASES, MENTIONS, SUBS, TURNS, USAGE, VERDICT, VIDEOS, _r, _plans
from .registry import register

STRIP = "regexp_replace(coalesce({0}, ''), '^\\s+|\\s+$', '', 'g')"


def _any(text: str, cues: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + ")"


# --- texts -------------------------------------------------------------------------------------------------------


@register("text_relation_names", "d as (select doc_id, trim(regexp_replace(lower(substr(string_split(text, '.')[1], 1, 120)), '^\\s+|\\s+$', '', 'g')) as name from documents) select doc_id, coalesce(nullif(name, ''), 'related_to') as name from d")
def text_relation_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.relation_name(F.col("text")).alias("name"))


@register("text_clock", "select_ as (select o_orderkey, o_totalprice / 100 as s from orders), r as (select o_orderkey, greatest(0, round_even(s, 0))::bigint as s from select_) select o_orderkey as video_id, concat(lpad((s // 60)::varchar, 2, '0'), ':', lpad((s % 60)::varchar, 2, '0')) as clock from r")
def text_clock(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), T.clock(F.col("o_totalprice") / 100).alias("clock"))


@register("text_citations", "e as (select event_id, event_id % 60 as m, event_id * 7 % 60 as s from events), x as (select event_id, 0 as n, (m * 60 + s)::double as t_start, (m * 60 + s + 60)::double as t_end from e where event_id % 4 <> 0 union all select event_id, 1, s * 60.0::double, s * 60 + m::double from e where event_id % 4 <> 0) select * from x")
def text_citations(spark, sf):
    a = "lpad(event_id % 60, 2, '0'), ':', lpad(event_id * 7 % 60, 2, '0')"
    b = "lpad((event_id % 60) + 1, 2, '0'), ':', lpad(event_id * 7 % 60, 2, '0')"
    answer = F.expr(f"case when event_id % 4 = 0 then 'none [1:2] here' else concat('At [', {a}, '-', {b}, '] and [', event_id * 7 % 60, ':00 – ', event_id * 7 % 60, ':', lpad(event_id % 60, 2, '0'), ']. [x:10-2:00]') end")
    rows = table(spark, sf, "events").select("event_id", F.posexplode(T.citations(answer)).alias("n", "c"))
    return rows.select("event_id", "n", "c.t_start", "c.t_end")


@register("text_object_phrases", "p as (select p_partkey, lower(p_name) as name from part) select p_partkey as part_id, concat(regexp_replace(trim(name), '\\s+', ' ', 'g'), case when p_partkey % 3 = 1 then ' being' else '' end, '.') as phrase from p")
def text_object_phrases(spark, sf):
    q = F.expr("concat(case p_partkey % 3 when 0 then 'Show me when is the ' when 1 then ' At what time does a ' else 'where ' end, p_name, case p_partkey % 3 when 0 then ' happened?' when 1 then ' being used ?!' else '  visible' end)")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), T.object_phrase(F.regexp_replace(q, r"\s+([?!]+)$", "$1")).alias("phrase"))


@register("text_named_parts", "p as (select p_partkey, p_name, p_brand from part) select p_partkey as part_id, case when p_partkey % 3 = 0 then concat('A thing, ', p_name) else concat('A thing, ', p_name, case when p_partkey % 3 = 1 then concat(chr(10), chr(10), 'after') else '' end) end as description, case p_partkey % 3 when 1 then concat(p_brand, '/', p_name) else '' end as tokens from p")
def text_named_parts(spark, sf):
    text = F.expr("concat(' A thing, ', p_name, case p_partkey % 3 when 0 then '' when 1 then concat('\\n Names : ', p_brand, ', none ,', p_name, ',\\nafter') else '\\nNAMES: None' end)")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), T.named_parts(text).alias("x")).select("part_id", "x.description", F.array_join("x.tokens", "/").alias("tokens"))


SIGNALS = "sig as (select conv_id as video_id, turn, turn * 1.5::double as t_start, turn * 1.5::double + 2 as t_end, case when turn % 3 = 0 then ' ' when turn % 3 = 1 then concat(' ', role) end as cap, text as asr, case when turn % 4 = 0 then concat('sign ', turn) else '' end as ocr, case when turn % 5 = 0 then [] when turn % 5 = 1 then ['Crowd', '', 'Music', 'Horn'] else ['Speech'] end as sounds from conversations)"


def _signals(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id as video_id", "turn", "turn * 1.5D as t_start", "turn * 1.5D + 2 as t_end", "case when turn % 3 = 0 then ' ' when turn % 3 = 1 then concat(' ', role) end as cap", "text as asr", "case when turn % 4 = 0 then concat('sign ', turn) else '' end as ocr", "case when turn % 5 = 0 then cast(array() as array<string>) when turn % 5 = 1 then array('Crowd', '', 'Music', 'Horn') else array('Speech') end as sounds")


TOP3 = "array_to_string(list_filter(sounds[1:3], lambda x: x <> ''), ', ')"


@register("text_segment_summary", f"{SIGNALS}, x as (select video_id, turn, concat_ws(' | ', nullif({STRIP.format('cap')}, ''), 'Said: ' || nullif({STRIP.format('asr')}, ''), 'On-screen: ' || nullif({STRIP.format('ocr')}, ''), 'Audio: ' || nullif({TOP3}, '')) as summary, concat_ws(' | ', nullif(asr, ''), nullif(cap, ''), nullif(ocr, '')) as embedded from sig) select video_id, turn, case when summary = '' then '(silent / no detected content)' else summary end as summary, case when embedded = '' then ' ' else embedded end as embedded from x")
def text_segment_summary(spark, sf):
    c = F.col
    return _signals(spark, sf).select("video_id", "turn", T.stitched(c("cap"), c("asr"), c("ocr"), c("sounds")).alias("summary"), T.embedding_text(c("asr"), c("cap"), c("ocr")).alias("embedded"))


@register("text_timeline_lines", f"{SIGNALS}, x as (select video_id, turn, t_start, t_end, concat_ws(' | ', 'ocr=' || nullif({STRIP.format('ocr')}, ''), 'cap=' || nullif({STRIP.format('cap')}, ''), 'asr=' || nullif({STRIP.format('asr')}, ''), 'audio=[' || nullif({TOP3}, '') || ']') as bits from sig) select video_id, turn, substr(printf('[%.1f-%.1fs] %s', t_start, t_end, case when bits = '' then '(silent, no caption)' else bits end), 1, 400) as line from x")
def text_timeline_lines(spark, sf):
    c = F.col
    return _signals(spark, sf).select("video_id", "turn", T.timeline_line(c("t_start"), c("t_end"), {"cap": c("cap"), "asr": c("asr"), "ocr": c("ocr")}, c("sounds"), "ocr").alias("line"))


@register("text_coerced_fields", "c as (select c_custkey, c_mktsegment as seg, case c_custkey % 4 when 0 then 'abc' when 1 then '1.5' when 2 then 'Yes' end as raw from customer) select c_custkey as id, case when c_custkey % 4 = 1 then 1.5::double end as num, case when c_custkey % 4 = 3 then null else c_custkey % 4 = 2 end as flag, case when seg in ('BUILDING', 'MACHINERY') then seg end as choice, case when seg in ('BUILDING', 'MACHINERY') then case seg when 'BUILDING' then 'building' else 'Machinery' end end as loose from c")
def text_coerced_fields(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey as id", "c_mktsegment as seg", "case c_custkey % 4 when 0 then 'abc' when 1 then '1.5' when 2 then 'Yes' end as raw")
    c = F.col
    return rows.select("id", T.coerced(c("raw"), "number").alias("num"), T.coerced(c("raw"), "boolean").alias("flag"), T.coerced(c("seg"), "string", ("BUILDING", "MACHINERY")).alias("choice"), T.coerced(c("seg"), "string", ("building", "Machinery"), True).alias("loose"))


@register("text_prompt_budget", f"{TURNS}, s as (select *, row_number() over (partition by video_id order by ord) as n from turns), g as (select video_id, string_agg(concat(speaker, ': ', coalesce(text, '')), chr(10) order by ord) as a, string_agg(speaker, chr(10) order by ord) as b, string_agg(speaker, chr(10) order by ord) filter (n % 2 = 1) as c from s group by 1), t as (select video_id, case when greatest(1, length(a) // 4) <= 100 then a when greatest(1, length(b) // 4) <= 10 then b else c end as prompt from (select video_id, a, b, c from g)) select video_id, prompt, greatest(1, length(prompt) // 4)::int as tokens from t")
def text_prompt_budget(spark, sf):
    rows = V.turns(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("ord")))
    lines = lambda c, keep="true": F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr(keep), F.struct("ord", c.alias("l"))))), lambda x: x["l"]), "\n")
    g = rows.groupBy("video_id").agg(lines(F.concat("speaker", F.lit(": "), F.coalesce("text", F.lit("")))).alias("a"), lines(F.col("speaker")).alias("b"), lines(F.col("speaker"), "n % 2 = 1").alias("c"))
    prompt = T.first_that_fits(100, F.col("a"), F.when(T.approximate_tokens(F.col("b")) <= 10, F.col("b")).otherwise(F.col("c")))
    return g.select("video_id", prompt.alias("prompt")).withColumn("tokens", T.approximate_tokens(F.col("prompt")))


@register("text_first_json", "c as (select c_custkey from customer) select c_custkey as id, case when c_custkey % 3 = 0 then concat('[', c_custkey, ', 2]') end as list, case when c_custkey % 3 = 1 then concat('{\"a\": ', c_custkey, '}') end as object from c")
def text_first_json(spark, sf):
    raw = F.expr("case c_custkey % 3 when 0 then concat('so [', c_custkey, ', 2] end') when 1 then concat('x {\"a\": ', c_custkey, '} y') else 'broken [1, {2' end")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.first_json(raw).alias("list"), T.first_json(raw, "{").alias("object"))


@register("text_intents", f"d as (select doc_id, lower(coalesce(text, '')) as q, text from documents) select doc_id, not {_any('q', T.NON_MOMENT_CUES)} as moment_like, {_any('q', T.SUMMARY_CUES)} as summary, {_any('q', T.TEMPORAL)} as temporal, case when {STRIP.format('text')} = '' then '' when regexp_matches(q, '{T._VIETNAMESE}') then 'Vietnamese' else 'English' end as language from d")
def text_intents(spark, sf):
    q = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", (~T.any_term(q, list(T.NON_MOMENT_CUES))).alias("moment_like"), T.any_term(q, list(T.SUMMARY_CUES)).alias("summary"), T.any_term(q, list(T.TEMPORAL)).alias("temporal"), T.language(F.col("text")).alias("language"))


@register("text_lexical_gate", "q as (select item_id, lower(coalesce(text, '')) as q from benchmark) select item_id, list_reduce(list_prepend(0.0::double, [" + ", ".join(f"case when contains(q, '{t}') then {w}::double else -1.0::double end" for t, w in T.HEARD.items()) + "]), lambda s, w: case when w < 0 then s else least(1.0, greatest(s, w) + 0.1 * w) end) as gate from q")
def text_lexical_gate(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.lexical_gate(F.coalesce("text", F.lit(""))).alias("gate"))


@register("text_moment_search", "p as (select p_partkey, lower(p_name || ' ' || p_type) as hay, lower(p_name) as k1, lower(p_type) as k2 from part), s as (select p_partkey as part_id, (case when contains(hay, 'small') then 2 when contains(hay, 'smal') then 1 else 0 end + case when contains(hay, 'brassy') then 2 when contains(hay, 'brass') then 1 else 0 end + case when contains(k1, 'small brassy') or contains('small brassy', k1) or contains(k2, 'small brassy') or contains('small brassy', k2) then 3 else 0 end)::int as score from p) select part_id, score, row_number() over (order by score desc, part_id) as rank from s where score > 0 qualify rank <= 50")
def text_moment_search(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"), T.moment_score(" Small brassy", F.array(F.lower("p_name"), F.lower("p_type"))).alias("score")).where("score > 0")
    best = rows.orderBy(F.desc("score"), "part_id").limit(50)  # a page
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "part_id")))


@register("clip_tiles", "f as (select p_partkey as frame_id, p_size * 3 + 1 as h, p_size * 5 + 2 as w from part), t as (select frame_id, h, w, unnest(range(2)) as r from f), u as (select *, unnest(range(2)) as c from t) select frame_id, concat('r', r, 'c', c) as region, (r * (h // 2))::int as y0, (case when r = 1 then h else h // 2 end)::int as y1, (c * (w // 2))::int as x0, (case when c = 1 then w else w // 2 end)::int as x1 from u where h // 2 > 0 and w // 2 > 0")
def clip_tiles(spark, sf):
    frames = table(spark, sf, "part").selectExpr("p_partkey as frame_id", "cast(p_size * 3 + 1 as int) as h", "cast(p_size * 5 + 2 as int) as w")
    return accounts.tiles(frames, 2)


@register("context_lengths", f"{VIDEOS} select video_id, ceil(round(duration) / 7)::bigint as n_clips from videos")
def context_lengths(spark, sf):
    return V.videos(spark, sf).select("video_id", F.ceil(F.round("duration") / 7).alias("n_clips"))


# --- knowledge graph ---------------------------------------------------------------------------------------------


@register("kg_mentions_scoped", f"{MENTIONS}, {VIDEOS}, iv as (select distinct o_custkey as index_id, o_orderkey as video_id, o_custkey % 7 as position from orders), p as (select iv.index_id, entity_id, m.video_id, segment_idx, row_number() over (partition by entity_id order by position, m.video_id, segment_idx) as place from mentions m join videos v on v.video_id = m.video_id join iv on iv.video_id = m.video_id and iv.index_id = v.user_id where v.status = 'ready') select * from p where place <= 50")
def kg_mentions_scoped(spark, sf):
    members = table(spark, sf, "orders").selectExpr("o_custkey as index_id", "o_orderkey as video_id", "o_custkey % 7 as position").distinct()
    videos = V.videos(spark, sf).where("status = 'ready'").select("video_id", F.col("user_id").alias("index_id"))
    return accounts.mentions_page(V.mentions(spark, sf), videos, members, 50)


@register("kg_window_mentions", "l as (select distinct l_orderkey as video_id, l_linenumber as segment_idx, l_linenumber // 3 as window_idx from lineitem), e as (select distinct l_orderkey as video_id, l_linenumber // 3 as window_idx, l_partkey as entity_id from lineitem where l_quantity > 25) select distinct entity_id, l.video_id, segment_idx, 1.0::double as weight from e join l using (video_id, window_idx)")
def kg_window_mentions(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey as video_id", "l_linenumber as segment_idx", "cast(l_linenumber div 3 as long) as window_idx", "l_partkey", "l_quantity")
    found = lines.where("l_quantity > 25").selectExpr("video_id", "window_idx", "l_partkey as entity_id")
    return accounts.window_mentions(found, lines.select("video_id", "segment_idx", "window_idx"))


@register("kg_backfill_windows", f"{TURNS}, w as (select video_id, floor(t_start / 30)::bigint as window_idx, min(t_start) as t_start, max(t_end) as t_end, array_to_string(list_sort(list_distinct(list(ord))), ',') as segment_ids, coalesce((list(case when ord % 3 = 0 then concat('s', ord) end order by ord) filter (ord % 3 = 0))[1], '') as summary from turns group by 1, 2) select * from w")
def kg_backfill_windows(spark, sf):
    rows = V.turns(spark, sf).selectExpr("video_id", "cast(floor(t_start / 30) as long) as window_idx", "ord as segment_idx", "t_start", "t_end", "case when ord % 3 = 0 then concat('s', ord) end as window_summary")
    return accounts.windows_of(rows).withColumn("segment_ids", F.array_join("segment_ids", ","))


@register("segments_with_summaries", f"{TURNS}, s as (select distinct video_id, floor(t_start / 120)::bigint as window_idx from turns where video_id % 3 <> 0) select t.video_id, t.ord, floor(t_start / 120)::bigint as window_idx, case when s.video_id is null then '' else concat('summary ', s.window_idx) end as window_summary from turns t left join s on s.video_id = t.video_id and s.window_idx = floor(t_start / 120)::bigint")
def segments_with_summaries(spark, sf):
    turns = V.turns(spark, sf).select("video_id", "ord", "t_start")
    summaries = turns.where("video_id % 3 <> 0").selectExpr("video_id", "cast(floor(t_start / 120) as long) as window_idx").distinct().withColumn("summary", F.concat(F.lit("summary "), "window_idx"))
    return accounts.with_window_summary(turns, summaries, 120.0).select("video_id", "ord", "window_idx", "window_summary")


@register("window_summaries_distinct", f"{TURNS}, w as (select video_id, floor(t_start / 30)::bigint as window_idx, ord, t_start, case when ord % 2 = 1 then concat('s', ord) else ' ' end as summary from turns) select video_id, window_idx, (list(t_start order by ord) filter (trim(summary) <> ''))[1] as t_start, (list(summary order by ord) filter (trim(summary) <> ''))[1] as summary from w group by 1, 2 having count(*) filter (trim(summary) <> '') > 0")
def window_summaries_distinct(spark, sf):
    rows = V.turns(spark, sf).selectExpr("video_id", "cast(floor(t_start / 30) as long) as window_idx", "ord", "t_start", "case when ord % 2 = 1 then concat('s', ord) else ' ' end as summary")
    return accounts.first_summaries(rows)


@register("kg_same_type_pairs", "e as (select vec_id as entity_id, vec_id % 7 as type, embedding::double[] as v from embeddings) select a.entity_id as a, b.entity_id as b, round(list_cosine_similarity(a.v, b.v), 6) as score from e a join e b on a.type = b.type and a.entity_id < b.entity_id where round(list_cosine_similarity(a.v, b.v), 9) >= 0.25")
def kg_same_type_pairs(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr("vec_id % 7 as scope", "vec_id as item_id", "cast(null as string) as type", "embedding as vector")
    return entities.near_pairs(e, 0.25).select("a", "b", _r("score"))


@register(
    "kg_canonical",
    """e as (select vec_id as ord, (vec_id % 3)::varchar as scope, concat('n', vec_id * 7 % 180) as norm, case when vec_id % 11 > 0 then concat('t', vec_id % 2) end as type, embedding::double[] as v from embeddings),
n as (select *, row_number() over (partition by scope order by ord) as i from e),
steps as (select * from (with recursive r as (
  select scope, 0::bigint as i, []::struct(ord bigint, norm varchar, type varchar, v double[])[] as led from e group by scope
  union all
  select r.scope, n.i, case when len(list_filter(r.led, lambda l: l.norm = n.norm or ((l.type is null or n.type is null or l.type = n.type) and round(list_cosine_similarity(l.v, n.v), 9) >= 0.25))) = 0 then list_append(r.led, {'ord': n.ord, 'norm': n.norm, 'type': n.type, 'v': n.v}) else r.led end
  from r join n on n.scope = r.scope and n.i = r.i + 1) select * from r)),
l as (select scope, unnest(led) as x from (select scope, led from steps qualify row_number() over (partition by scope order by i desc) = 1)),
m as (select n.scope, n.ord, l.x.ord as leader, l.x.norm = n.norm as named, round(list_cosine_similarity(l.x.v, n.v), 9) as score from n join l on l.scope = n.scope and l.x.ord <= n.ord and (l.x.norm = n.norm or ((l.x.type is null or n.type is null or l.x.type = n.type) and round(list_cosine_similarity(l.x.v, n.v), 9) >= 0.25)))
select scope, ord, leader, case when leader = ord then 'new' when named then 'name' else 'alike' end as how from m qualify row_number() over (partition by scope, ord order by named desc, score desc, leader) = 1""",
)
def kg_canonical(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr("vec_id as ord", "cast(vec_id % 3 as string) as scope", "concat('n', vec_id * 7 % 180) as norm", "case when vec_id % 11 > 0 then concat('t', vec_id % 2) end as type", "embedding as vector")
    return entities.canonical(e, least=0.25)


# --- usage and accounts ------------------------------------------------------------------------------------------


@register("signups_daily", f"{VIDEOS}, f as (select user_id, min(created_at) as t0 from videos group by 1), s as (select t0::date as day, count(*) as signups from f where t0 >= timestamp '1995-01-01' and t0 < timestamp '1995-07-01' group by 1) select * from s")
def signups_daily(spark, sf):
    first = V.videos(spark, sf).groupBy("user_id").agg(F.min(F.col("created_at").cast("timestamp_ntz")).alias("at"))
    return accounts.daily_count(first.where("at >= timestamp_ntz'1995-01-01' and at < timestamp_ntz'1995-07-01'"), "at", "signups")


@register("moderation_review", f"{VERDICT}, {VIDEOS} select d.video_id, v.created_at, max_nsfw, max_violence, max_toxic, n_nsfw + n_violence + n_toxic as flagged_count, len(string_split(labels, ',')) as n_labels, row_number() over (order by v.created_at desc, d.video_id) as place from verdict d join videos v using (video_id) where flagged qualify place <= 200")
def moderation_review(spark, sf):
    rows = accounts.review_list(rollups.moderation_verdict(V.moderation(spark, sf)), V.videos(spark, sf).select("video_id", "created_at"), 200)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "video_id"))).select("video_id", "created_at", "max_nsfw", "max_violence", "max_toxic", "flagged_count", "n_labels", "place")


@register("eval_breaches", f"""{CASES}, t as (select expected as tool from cases union select predicted from cases), c as (select tool, (select count(*) from cases where expected = tool and predicted = tool) as tp, (select count(*) from cases where expected <> tool and predicted = tool) as fp, (select count(*) from cases where expected = tool and predicted <> tool) as fn from t),
m as (select (select avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)) from c) as f1, (select avg(case when arg_ok is null then null when arg_ok then 1.0 else 0.0 end) from cases) as args, (select avg(completion) from cases) as task),
r as (select 'routing_f1_macro' as metric, f1 as value, 0.90::double as least from m union all select 'arg_correctness_rate', args, 0.95 from m union all select 'mean_task_completion', task, 0.80 from m) select metric, round(value, 6) as value, least, printf('%s=%.3f < %.2f', metric, value, least) as breach from r where value < least""")
def eval_breaches(spark, sf):
    cases = V.cases(spark, sf)
    f1 = rollups.precision_recall(cases).agg(F.avg("f1").alias("routing_f1_macro"))
    means = cases.agg(F.avg(F.col("arg_ok").cast("double")).alias("arg_correctness_rate"), F.avg("completion").alias("mean_task_completion"))
    floors = {"routing_f1_macro": 0.90, "arg_correctness_rate": 0.95, "mean_task_completion": 0.80}
    return accounts.breaches(f1.crossJoin(means), floors).withColumn("value", F.round("value", 6))  # one row each


@register("developer_bill", f"{USAGE}, rates as (select concat('model-', k) as item, case when k % 2 = 0 then 'even' else 'odd' end as family, k * 0.01::double as rate from range(1, 7) t(k)), b as (select user_id, family, item, sum(prompt * rate) as amount from usage join rates on model = item group by rollup (user_id, family, item)) select coalesce(user_id, -1) as user_id, coalesce(family, '') as family, coalesce(item, '') as item, round(amount, 2) as amount from b where user_id is not null")
def developer_bill(spark, sf):
    rates = spark.range(1, 7).selectExpr("concat('model-', id) as item", "if(id % 2 = 0, 'even', 'odd') as family", "id * 0.01D as rate")
    usage = V.usage(spark, sf).selectExpr("user_id", "model as item", "prompt as quantity")
    return accounts.bill(usage, rates).withColumn("amount", F.round("amount", 2))


@register("invoice_periods", f"{SUBS}, p as (select c_custkey as user_id, coalesce(plan_id, 'free') as plan_id from customer left join subs on c_custkey = user_id), k as (select user_id, plan_id, unnest([1, 2]) as k from p where plan_id <> 'free'), s as (select user_id, k, (date '2024-02-01' - to_months(k))::date as period_start from k) select user_id, k, period_start, (period_start + 7)::date as due, (period_start + interval 1 month - interval 1 day)::date as period_end, 22.0::double as total from s")
def invoice_periods(spark, sf):
    return accounts.invoices(_plans(spark, sf).select("user_id", "plan_id"), "2024-02-17").select("user_id", "k", "period_start", "due", "period_end", "total")


@register("subscription_caps", f"{SUBS}, {VIDEOS}, v as (select user_id, count(*) as used from videos group by 1), c as (select c_custkey as user_id, coalesce(plan_id, 'free') as plan_id, coalesce(used, 0) as used, case coalesce(plan_id, 'free') when 'free' then 8 when 'BUILDING' then 12 end as cap from customer left join subs s on s.user_id = c_custkey left join v on v.user_id = c_custkey) select user_id, plan_id, used, cap::int as cap, cap is null or used <= cap as allowed from c")
def subscription_caps(spark, sf):
    used = V.videos(spark, sf).groupBy("user_id").agg(F.count("*").alias("used"))
    caps = spark.createDataFrame([("free", 8), ("BUILDING", 12)], "plan_id string, cap int")
    return accounts.within_caps(_plans(spark, sf).select("user_id", "plan_id"), used, caps)


@register("admin_users_full", f"{SUBS}, {VIDEOS}, {USAGE}, v as (select user_id, count(*) as n_videos, round(sum(duration), 2) as duration, max(created_at) as last_at, count(*) filter (status = 'ready') as n_ready from videos group by 1), u as (select user_id, sum(prompt + completion) as tokens from usage group by 1) select c_custkey as user_id, coalesce(plan_id, 'free') as plan_id, coalesce(n_videos, 0) as n_videos, coalesce(n_ready, 0) as n_ready, coalesce(duration, 0) as duration, last_at, coalesce(tokens, 0) as tokens from customer left join subs s on s.user_id = c_custkey left join v on v.user_id = c_custkey left join u on u.user_id = c_custkey")
def admin_users_full(spark, sf):
    videos = V.videos(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_videos"), F.round(F.sum("duration"), 2).alias("duration"), F.max("created_at").alias("last_at"), F.count_if(F.col("status") == "ready").alias("n_ready"))
    tokens = V.usage(spark, sf).groupBy("user_id").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"))
    return accounts.with_rollups(_plans(spark, sf).select("user_id", "plan_id"), [videos, tokens], ["n_videos", "n_ready", "duration", "tokens"]).select("user_id", "plan_id", "n_videos", "n_ready", "duration", "last_at", "tokens")


@register("jobs_usage", f"{VIDEOS}, j as (select l_orderkey as video_id, l_linenumber as job, l_shipdate as finished_at from lineitem where l_returnflag <> 'R') select user_id, count(*) as jobs, round(sum(duration), 2) as seconds from j join videos using (video_id) where finished_at >= timestamp '1995-01-01' group by 1")
def jobs_usage(spark, sf):
    jobs = table(spark, sf, "lineitem").where("l_returnflag <> 'R' and l_shipdate >= timestamp_ntz'1995-01-01'").selectExpr("l_orderkey as video_id", "l_linenumber as job")
    return jobs.join(V.videos(spark, sf).select("video_id", "user_id", "duration"), "video_id").groupBy("user_id").agg(F.count("*").alias("jobs"), F.round(F.sum("duration"), 2).alias("seconds"))


@register("admin_patches", "c as (select c_custkey as id, case c_custkey % 4 when 0 then null when 1 then 'admin' when 2 then 'root' else 'user' end as role, case when c_custkey % 8 = 0 then null else c_custkey % 3 = 0 end as active from customer) select id, case when role is null and active is null then 400 when role is not null and role not in ('user', 'admin') then 400 when id % 5 = 0 then 403 end as status from c")
def admin_patches(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey as id", "case c_custkey % 4 when 0 then cast(null as string) when 1 then 'admin' when 2 then 'root' else 'user' end as role", "if(c_custkey % 8 = 0, cast(null as boolean), c_custkey % 3 = 0) as active")
    return rows.select("id", accounts.patch_refusal(F.col("role"), F.col("active"), F.expr("id % 5 = 0")).alias("status"))


@register("users_ilike", "select_ as (select c_custkey as user_id, c_name as name from customer) select user_id, name from select_ where name ilike '%R#0__0%'")
def users_ilike(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey as user_id", "c_name as name").where(T.like_any(F.col("name"), "R#0__0"))


@register("messages_by_time", "m as (select conv_id, turn // 2 as created_at, role, turn from conversations) select conv_id, created_at, role, turn, row_number() over (partition by conv_id order by created_at, case when role = 'user' then 0 else 1 end, turn) - 1 as position from m")
def messages_by_time(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn div 2 as created_at", "role", "turn")
    order = Window.partitionBy("conv_id").orderBy("created_at", F.when(F.col("role") == "user", 0).otherwise(1), "turn")
    return rows.withColumn("position", F.row_number().over(order) - 1)


@register("tools_missing", f"{CASES} select distinct expected as tool from cases where golden_id % 7 = 0 except select predicted from cases where golden_id % 3 = 0 and length(predicted) < 6")
def tools_missing(spark, sf):
    cases = V.cases(spark, sf)
    return cases.where("golden_id % 7 = 0").selectExpr("expected as tool").distinct().join(cases.where("golden_id % 3 = 0 and length(predicted) < 6").selectExpr("predicted as tool"), "tool", "left_anti")


@register("ocr_lines_joined", f"{TURNS}, t as (select video_id, ord, concat('line ', ord % 3) as line from turns), f as (select video_id, line, min(ord) as first_at from t group by 1, 2) select video_id, string_agg(line, ' | ' order by first_at) as lines from f group by 1")
def ocr_lines_joined(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("line "), F.col("ord") % 3).alias("line")))), lambda x: x["line"])
    return V.turns(spark, sf).groupBy("video_id").agg(F.array_join(F.array_distinct(lines), " | ").alias("lines"))


@register("args_checked", f"{CASES}, a as (select golden_id, case golden_id % 3 when 0 then 'x' when 1 then '' end as query, golden_id % 4 as top_k, 2 as want from cases) select golden_id, coalesce(trim(query) <> '', false) and top_k = want as passed from a")
def args_checked(spark, sf):
    calls = V.cases(spark, sf).select("golden_id", F.expr("map_from_arrays(array('query', 'top_k'), array(case golden_id % 3 when 0 then 'x' when 1 then '' end, cast(golden_id % 4 as string)))").alias("actual"), F.expr("map('query', 'anything', 'top_k', '2')").alias("expected"))
    return calls.select("golden_id", accounts.arguments_fit(F.col("expected"), F.col("actual"), ("top_k",)).alias("passed"))


@register("library_totals", f"{VIDEOS} select user_id, count(*) as n_videos, round(sum(coalesce(duration, 0)), 2) as seconds, count(*) filter (status = 'ready') as n_ready, count(*) filter (status = 'processing') as n_processing, count(*) filter (status = 'error') as n_error from videos group by 1")
def library_totals(spark, sf):
    t = accounts.library_totals(V.videos(spark, sf))
    return t.select("user_id", "n_videos", _r("seconds", 2), *(F.coalesce(F.col("by_status")[k], F.lit(0)).alias(f"n_{k}") for k in ("ready", "processing", "error")))


# --- dumps and versioned tables ----------------------------------------------------------------------------------

LINES = "lines as (select l_orderkey as video_id, l_linenumber as ord, max(l_quantity) as v from lineitem group by 1, 2)"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("ord")).agg(F.max("l_quantity").alias("v"))


@register("index_dump", f"{VIDEOS}, s as (select l_orderkey as video_id, l_linenumber as shot_idx, l_tax * 100 as t_start, l_tax * 100 + l_quantity as t_end from lineitem), n as (select video_id, count(*) as n from s group by 1) select v.video_id, v.status, case when v.status = 'ready' then coalesce(n, 0) else 0 end as n_shots, s.shot_idx::bigint as shot_idx, round(s.t_end - s.t_start, 3) as duration from videos v left join n using (video_id) left join s on s.video_id = v.video_id and v.status = 'ready'")
def index_dump(spark, sf):
    shots = table(spark, sf, "lineitem").selectExpr("l_orderkey as video_id", "cast(l_linenumber as long) as shot_idx", "l_tax * 100 as t_start", "l_tax * 100 + l_quantity as t_end")
    dump = sinks.index_dump(V.videos(spark, sf).select("video_id", "status"), shots)
    return dump.select("video_id", "status", F.col("n_shots").cast("long").alias("n_shots"), F.explode_outer("shots").alias("s")).select("video_id", "status", "n_shots", "s.shot_idx", "s.duration")


@register("collection_stats", "e as (select * from embeddings) select 'shots' as collection, count(*) as total_points, count(embedding) as with_vector, max(len(embedding))::int as vector_size from e")
def collection_stats(spark, sf):
    return sinks.collection_stats(table(spark, sf, "embeddings"), "shots", "embedding")


@register("table_upserted", f"{LINES}, old as (select *, 0 as version from lines where ord <= 4), new as (select video_id, ord, v + 100 as v, ord % 3 - 1 as version from lines where ord >= 3), both_ as (select *, 0 as is_new from old union all select *, 1 from new) select video_id, ord::bigint as ord, v from both_ qualify row_number() over (partition by video_id, ord order by version desc, is_new desc) = 1")
def table_upserted(spark, sf):
    lines = _lines(spark, sf)
    with folders.scratch(spark) as path:
        snapshots.upsert(lines.where("ord <= 4").withColumn("version", F.lit(0)), path, ["video_id", "ord"], "version")
        snapshots.upsert(lines.where("ord >= 3").selectExpr("video_id", "ord", "v + 100 as v", "cast(ord % 3 - 1 as int) as version"), path, ["video_id", "ord"], "version")
        return folders.durable(snapshots.read(spark, path).select("video_id", "ord", "v"))


@register("table_replaced", f"{LINES}, new as (select video_id, ord, v from lines where video_id % 3 = 0 and ord > 1), after_ as (select * from lines where video_id not in (select video_id from new) union all select * from new) select video_id, ord::bigint as ord, v from after_ where video_id % 7 > 0")
def table_replaced(spark, sf):
    lines = _lines(spark, sf)
    with folders.scratch(spark) as path:
        snapshots.purge_and_insert(lines, path)
        for _ in range(2):  # the second changes nothing
            snapshots.purge_and_insert(lines.where("video_id % 3 = 0 and ord > 1"), path, token="again")
        snapshots.remove(lines.where("video_id % 7 = 0").select("video_id"), path)
        return folders.durable(snapshots.read(spark, path).select("video_id", "ord", "v"))
