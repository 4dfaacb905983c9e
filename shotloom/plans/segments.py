"""Queries over windows, runs, groups, tracks and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals, presets, spans, timeline
from ..sources import media
from ..sources import views as V
from ..sources.views import table
from .catalogue import ISLES, RUNS, SAL, SEGS, SHOTS, SPANS, TURNS, VIDEOS, _r, _segs
from .registry import register


@register("windows_uniform", f"{VIDEOS}, v as (select video_id, duration / 1000 - 20 as d from videos), n as (select *, greatest(1, ceil(round((d - 0.001) / 30, 9)))::int as n from v), m as (select *, case when n >= 2 and d - (n - 1) * 30 < 15 then n - 1 else n end as m from n), k as (select *, unnest(range(m))::int as k from m) select video_id, k as window_idx, k * 30.0::double as t_start, round(case when d <= 0 then 0.1 when k = m - 1 then d else (k + 1) * 30.0 end, 6) as t_end from k")
def windows_uniform(spark, sf):
    v = V.videos(spark, sf).select("video_id", (F.col("duration") / 1000 - 20).alias("duration"))
    return spans.uniform_windows(v).select("video_id", "window_idx", "t_start", _r("t_end"))


@register("groups_from_boundaries", f"{SHOTS}, g as (select video_id, shot_idx, sum(case when shot_idx * 37 % 101 < 15 then 1 else 0 end) over (partition by video_id order by shot_idx rows unbounded preceding) - 1 as group_no from shots) select video_id, group_no, min(shot_idx) as first_idx, max(shot_idx) as last_idx, count(*) as n from g where group_no >= 0 group by 1, 2")
def groups_from_boundaries(spark, sf):
    g = spans.groups_from(V.shots(spark, sf), F.expr("shot_idx * 37 % 101 < 15"))
    return g.groupBy("video_id", "group_no").agg(F.min("shot_idx").alias("first_idx"), F.max("shot_idx").alias("last_idx"), F.count("*").alias("n"))


CAPTIONED = "cap as (select s.video_id, s.shot_idx, s.t_start, s.t_end, s.vector, case when s.shot_idx % 3 = 0 then text when s.shot_idx % 3 = 1 then ' ' end as chunk_caption, case when s.shot_idx % 2 = 0 then concat(' said ', s.shot_idx, '. more') end as asr_text from shots s left join documents on doc_id = s.shot_idx)"


def _captioned(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("shot_idx"), F.col("text").alias("t"))
    rows = V.shots(spark, sf).join(docs, "shot_idx", "left")
    return rows.selectExpr("video_id", "shot_idx", "t_start", "t_end", "vector", "case when shot_idx % 3 = 0 then t when shot_idx % 3 = 1 then ' ' end as chunk_caption", "case when shot_idx % 2 = 0 then concat(' said ', shot_idx, '. more') end as asr_text")


CLEAN = "nullif(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '')"


@register("topic_segments", f"""{SHOTS}, {CAPTIONED}, c as (select *, lag(vector) over (partition by video_id order by shot_idx) as prev, row_number() over (partition by video_id order by shot_idx) as n from cap),
g as (select *, sum(case when n > 1 and round(list_cosine_similarity(prev, vector), 9) < 0.05 then 1 else 0 end) over (partition by video_id order by shot_idx rows unbounded preceding) as grp, {CLEAN.format('chunk_caption')} as cc, {CLEAN.format('asr_text')} as aa from c),
t as (select video_id, grp, (list(t_start order by shot_idx))[1] as t_start, (list(t_end order by shot_idx desc))[1] as t_end, count(*) as shot_count, min(shot_idx) as first_idx, max(shot_idx) as last_idx, (list(cc order by shot_idx) filter (cc is not null))[1] as c1, (list(aa order by shot_idx) filter (aa is not null))[1] as a1 from g group by 1, 2)
select video_id, grp as group_no, t_start, t_end, shot_count, first_idx, last_idx, coalesce(substr(string_split(c1, '.')[1], 1, 80), substr(string_split(a1, '.')[1], 1, 80), concat('Topic (', shot_count, ' shots)')) as title from t""")
def topic_segments(spark, sf):
    rows = intervals.split_where_unlike(_captioned(spark, sf), 0.05).withColumnRenamed("group", "group_no")
    return spans.described_groups(rows, ["video_id", "group_no"])


@register("segments_partition", f"""{TURNS}, {SEGS}, d as (select video_id, max(ord) * 10 + 5.0::double as duration from turns group by 1),
r as (select t.video_id, ord, duration, greatest(0, least(ord * 10 + ord * 7 % 5 - 3.0, duration)) as a, greatest(0, least(ord * 10 + ord * 7 % 5 + 5.0 + ord % 4, duration)) as b from turns t join d using (video_id)),
k as (select * from r where b > a), c as (select distinct video_id, t from (select video_id, t_start as t from segs union all select video_id, t_end from segs union all select video_id, 0.0 from d union all select video_id, duration from d)),
s as (select k.*, coalesce((select x.t from c x where x.video_id = k.video_id and abs(x.t - k.a) <= 1.5 order by abs(x.t - k.a), x.t limit 1), a) as x, coalesce((select x.t from c x where x.video_id = k.video_id and abs(x.t - k.b) <= 1.5 order by abs(x.t - k.b), x.t limit 1), b) as y from k),
n as (select *, lag(y) over w as py, lead(x) over w as nx from s window w as (partition by video_id order by a, ord)),
z as (select video_id, ord, case when py is null then 0.0 else (py + x) / 2 end as t_start, case when nx is null then duration else (y + nx) / 2 end as t_end from n) select video_id, ord, round(t_start, 6) as t_start, round(t_end, 6) as t_end from z where t_end > t_start""")
def segments_partition(spark, sf):
    turns = V.turns(spark, sf)
    raw = turns.selectExpr("video_id", "ord", "ord * 10 + ord * 7 % 5 - 3D as t_start", "ord * 10 + ord * 7 % 5 + 5D + ord % 4 as t_end")
    videos = turns.groupBy("video_id").agg((F.max("ord") * 10 + 5.0).alias("duration"))
    segs = _segs(spark, sf)
    cuts = segs.select("video_id", F.col("t_start").alias("t")).union(segs.select("video_id", "t_end"))
    return spans.partition_of(raw, videos, cuts, 1.5).select("video_id", "ord", _r("t_start"), _r("t_end"))


@register("clip_runs", f"{SAL}, r as (select distinct video_id, clip_idx, clip_idx - dense_rank() over (partition by video_id order by clip_idx) as run from sal where score >= 250) select video_id, min(clip_idx) as first, max(clip_idx) as last from r group by video_id, run")
def clip_runs(spark, sf):
    return spans.clip_runs(V.saliency(spark, sf).where("score >= 250"), ["video_id"])


@register("windows_to_runs", f"""{SPANS}, w as (select video_id, ord % 997 * 1.5::double as t0, ord % 997 * 1.5::double + score / 30 - 1 as t1, 600 as n from spans), c as (select video_id, greatest(0, least(n - 1, floor(t0 / 2)::bigint)) as f, n, t1 from w where t1 > t0),
ids as (select distinct video_id, unnest(generate_series(f, greatest(f, least(n - 1, ceil(t1 / 2)::bigint - 1)))) as clip from c), r as (select *, clip - row_number() over (partition by video_id order by clip) as run from ids)
select video_id, min(clip) as first, max(clip) as last, min(clip) * 2.0::double as t_start, (max(clip) + 1) * 2.0::double as t_end from r group by video_id, run""")
def windows_to_runs(spark, sf):
    w = V.spans(spark, sf).selectExpr("video_id", "ord % 997 * 1.5D as t_start", "ord % 997 * 1.5D + score / 30 - 1 as t_end", "600L as n")
    return spans.windows_to_runs(w)


BITS = f"{SAL}, bits as (select video_id, clip_idx, case when score >= 250 then 1 else 0 end as bit from sal), br as (select *, clip_idx - row_number() over (partition by video_id, bit order by clip_idx) as run from bits), groups as (select video_id, bit, min(clip_idx) * 2.0::double as t_start, (max(clip_idx) + 1) * 2.0::double as t_end from br group by video_id, bit, run)"


def _bit_groups(spark, sf):
    return spans.bit_groups(V.saliency(spark, sf).selectExpr("video_id", "clip_idx", "if(score >= 250, 1, 0) as bit"))


@register("bit_groups", f"{BITS} select * from groups")
def bit_groups(spark, sf):
    return _bit_groups(spark, sf)


@register("moment_bins", f"{BITS}, b as (select *, case when t_end - t_start >= 12 then 0 when t_end - t_start >= 6 then 1 when t_end - t_start >= 4 then 2 end as bin from groups) select bin, video_id, bit, t_start, t_end from b where bin is not null")
def moment_bins(spark, sf):
    return _bit_groups(spark, sf).withColumn("bin", spans.length_bin(F.col("t_end") - F.col("t_start"), (12.0, 6.0, 4.0))).where("bin is not null")


@register("lad_balanced_top", f"{SPANS}, p as (select video_id, ord, (ord * 37 % 101)::double / 101 as score, score / 490 as width from spans), c as (select *, (width > 0.089)::int + (width > 0.21)::int + (width > 0.5)::int as class from p), r as (select *, row_number() over (partition by video_id, class order by score desc, ord) as n from c) select video_id, class * 3 + n - 1 as slot, ord, class from r where n <= 3")
def lad_balanced_top(spark, sf):
    p = V.spans(spark, sf).selectExpr("video_id", "ord", "cast(ord * 37 % 101 as double) / 101 as score", "score / 490 as width")
    return spans.class_balanced_top(p, (0.089, 0.21, 0.5), 12).withColumn("slot", F.col("slot").cast("long"))


PIECES = "lines as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as piece from lineitem), pieces as (select l_orderkey as mix_id, piece, l_partkey as src, l_suppkey % 10 as s, l_suppkey % 10 + l_quantity::bigint % 7 as e, first_value(l_partkey) over (partition by l_orderkey order by piece) as own from lines), pos as (select *, coalesce(sum(e - s) over (partition by mix_id order by piece rows between unbounded preceding and 1 preceding), 0)::bigint as m0 from pieces), placed as (select *, m0 + e - s as m1 from pos)"


def _pieces(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("piece", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    rows = lines.selectExpr("l_orderkey as mix_id", "piece", "l_partkey as src", "l_suppkey % 10 as s", "l_suppkey % 10 + cast(l_quantity as bigint) % 7 as e")
    return rows.withColumn("own", F.first("src").over(Window.partitionBy("mix_id").orderBy("piece")))


@register("mix_resolve", f"{PIECES}, r as (select o_orderkey as mix_id, o_custkey % 5 as b, o_custkey % 5 + 9 as t from orders) select p.mix_id, 0 as range_id, piece, src, s + greatest(b, m0) - m0 as s, s + least(t, m1) - m0 as e from placed p join r using (mix_id) where greatest(b, m0) < least(t, m1)")
def mix_resolve(spark, sf):
    ranges = table(spark, sf, "orders").selectExpr("o_orderkey as mix_id", "0 as range_id", "o_custkey % 5 as begin", "o_custkey % 5 + 9 as end")
    return spans.resolve_order(_pieces(spark, sf), ranges)


@register("mix_consistency", f"{PIECES} select mix_id, m0, m1, s, e from placed where src = own")
def mix_consistency(spark, sf):
    return spans.consistency_map(_pieces(spark, sf))


@register("resample_linear", f"""{SAL}, p as (select video_id, clip_idx * 2.0::double as t, score as v from sal), g as (select video_id, unnest(range(40)) * 3.0::double as t from (select distinct video_id from sal)),
b as (select g.*, p.t as t0, p.v as v0 from g asof left join p on g.video_id = p.video_id and g.t >= p.t), a as (select b.*, p.t as t1, p.v as v1 from b asof left join p on b.video_id = p.video_id and b.t <= p.t)
select video_id, t, round(case when t0 is null then v1 when t1 is null or t0 = t1 then v0 else v0 + (t - t0) / (t1 - t0) * (v1 - v0) end, 6) as value from a""")
def resample_linear(spark, sf):
    sal = V.saliency(spark, sf).selectExpr("video_id", "clip_idx * 2D as t", "score as value")
    grid = sal.select("video_id").distinct().withColumn("t", F.explode(F.expr("transform(sequence(0, 39), k -> k * 3D)")))
    return spans.interpolated(sal, grid).select("video_id", "t", _r("value"))


@register("turn_texts", f"""{TURNS}, {SEGS}, cl as (select video_id, idx, t_start, t_end, {CLEAN.format('text')} as text from segs), sp as (select * from cl where text is not null), p as (select s.video_id, s.idx, s.t_start, s.text, t.ord, least(s.t_end, t.t_end) - greatest(s.t_start, t.t_start) as o from sp s join turns t on s.video_id = t.video_id and s.t_start < t.t_end and s.t_end > t.t_start),
w as (select * from p qualify row_number() over (partition by video_id, idx order by round(o, 9) desc, ord) = 1), u as (select video_id, ord, text, min(t_start) as a, min(idx) as i from w group by 1, 2, 3), j as (select video_id, ord, string_agg(text, ' ' order by a, i) as said from u group by 1, 2)
select t.video_id, t.ord as turn_idx, coalesce(case when length(said) > 400 then concat(substr(said, 1, 400), '…') else said end, '') as transcript from turns t left join j on j.video_id = t.video_id and j.ord = t.ord""")
def turn_texts(spark, sf):
    return spans.merged_transcripts(_segs(spark, sf).withColumnRenamed("idx", "shot_idx"), V.turns(spark, sf).selectExpr("video_id", "ord as turn_idx", "t_start", "t_end"))


@register("chunk_pack_capped", f"{SPANS}, o as (select video_id, ord, t_start, t_end, row_number() over (partition by video_id order by t_start, ord) as n from spans), rec as (select * from (with recursive r as (select video_id, ord, n, t_start, t_end, t_start as s, 0::bigint as chunk from o where n = 1 union all select o.video_id, o.ord, o.n, o.t_start, o.t_end, case when o.t_end - r.s > 86400 then o.t_start else r.s end, case when o.t_end - r.s > 86400 then r.chunk + 1 else r.chunk end from r join o on o.video_id = r.video_id and o.n = r.n + 1) select * from r)) select video_id, ord, chunk from rec where chunk < 10")
def chunk_pack_capped(spark, sf):
    return intervals.pack_chunks(V.spans(spark, sf), 86400.0, chunks=10).select("video_id", "ord", "chunk")


# --- tracks ------------------------------------------------------------------------------------------------------

TRACKS = f"""{TURNS}, {SAL}, sm as (select *, count(*) over (partition by video_id) as n, (coalesce(lag(score) over w, 0) + score + coalesce(lead(score) over w, 0)) / 3.0 as three from sal window w as (partition by video_id order by clip_idx)), s1 as (select *, case when n >= 3 then three else score end as smooth from sm), s2 as (select *, avg(smooth) over (partition by video_id) as mean from s1), s3 as (select *, clip_idx - row_number() over (partition by video_id order by clip_idx) as run from s2 where round(smooth, 9) >= round(mean, 9)), s4 as (select video_id, min(clip_idx) as f, max(clip_idx) as l, max(smooth) as score from s3 group by video_id, run), moments as (select video_id, f * 2.0 as t_start, (l + 1) * 2.0 as t_end, score, row_number() over (partition by video_id order by round(score, 9) desc, f) as rank from s4 qualify rank <= 8),
texts as (select video_id, ord, t_start, t_end, substr(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), 1, 200) as label, 1.0::double as score from turns), shown as (select * from texts where label <> ''), {RUNS.format(label='label', src='shown')}, {ISLES.format(by='video_id, run', tie='ord', src='runs', gap=1.0)},
first_at as (select video_id, speaker, min(t_start) as first_at, min(ord) as first_ord from turns group by 1, 2), num as (select *, row_number() over (partition by video_id order by first_at, first_ord) as number from first_at),
snip as (select e.video_id, e.ord, substr(string_agg(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g'), ' ' order by s.t_start, s.ord) filter (regexp_replace(coalesce(s.text, ''), '^\\s+|\\s+$', '', 'g') <> ''), 1, 120) as said from turns e join turns s on e.video_id = s.video_id and s.t_start < e.t_end and s.t_end > e.t_start group by 1, 2),
topics as (select video_id, floor(t_start / 30)::bigint as w, min(t_start) as t_start, max(t_end) as t_end, bool_or(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> '') as spoken from turns group by 1, 2),
tracks as (select 'on_screen_text' as kind, video_id, min(t_start) as t_start, max(t_end) as t_end, label, min(ord) as tie from b group by video_id, run, label, isle
union all select 'shots', video_id, t_start, t_end, concat('Scene ', row_number() over (partition by video_id order by t_start, ord)), ord from turns
union all select 'spoken_topics', video_id, t_start, t_end, concat('window ', w), w from topics where spoken and w % 3 <> 2
union all select 'highlights', video_id, t_start::double, t_end::double, concat('Highlight ', rank), rank from moments
union all select 'speakers', t.video_id, t.t_start, t.t_end, substr(case when coalesce(said, '') <> '' then concat('Speaker ', number, ': ', said) else concat('Speaker ', number) end, 1, 200), t.ord from turns t join num n on n.video_id = t.video_id and n.speaker = t.speaker left join snip s on s.video_id = t.video_id and s.ord = t.ord where t.speaker is not null),
events as (select *, (row_number() over (partition by kind, video_id order by case when kind = 'highlights' then 0 else t_start end, tie) - 1)::bigint as i from tracks)"""


def _tracks(spark, sf) -> DataFrame:
    turns, sal = V.turns(spark, sf), V.saliency(spark, sf)
    summaries = turns.selectExpr("video_id", "cast(floor(t_start / 30) as long) as window_idx").distinct().where("window_idx % 3 <> 2").withColumn("summary", F.concat(F.lit("window "), "window_idx"))
    segments = turns.select("video_id", "ord", "t_start", "t_end", "text")
    return timeline.build(
        {
            "on_screen_text": timeline.text_track(turns.select("video_id", "ord", "t_start", "t_end", "text")),
            "shots": timeline.scene_track(segments),
            "spoken_topics": timeline.topic_track(segments, summaries, 30.0),
            "highlights": timeline.highlight_track(intervals.saliency_moments(sal)),
            "speakers": timeline.speaker_track(turns.select("video_id", "ord", "speaker", "t_start", "t_end"), segments),
        }
    )


@register("timeline_build", f"{TRACKS} select video_id, kind, i, t_start, t_end, label, concat(video_id, ':', kind, ':', i) as event_key from events")
def timeline_build(spark, sf):
    return _tracks(spark, sf).select("video_id", "kind", "i", "t_start", "t_end", "label", "event_key")


@register("timeline_shape", f"{TRACKS} select video_id, kind, count(*) as n, string_agg(label, ' / ' order by t_start, i) as labels from events group by 1, 2")
def timeline_shape(spark, sf):
    return timeline.shape(_tracks(spark, sf)).select("video_id", "kind", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda s: s["label"]), " / ").alias("labels"))


@register("timeline_event_texts", f"{TRACKS}, t as (select e.video_id, e.kind, e.i, e.label, string_agg(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g'), ' | ' order by s.t_start, s.ord) filter (regexp_replace(coalesce(s.text, ''), '^\\s+|\\s+$', '', 'g') <> '') as said from events e left join turns s on e.video_id = s.video_id and s.t_start < e.t_end and s.t_end > e.t_start where e.kind <> 'highlights' group by 1, 2, 3, 4) select video_id, kind, i, substr(concat_ws(' | ', label, said), 1, 1000) as text from t")
def timeline_event_texts(spark, sf):
    turns = V.turns(spark, sf).select("video_id", F.col("ord").alias("idx"), "t_start", "t_end", "text")
    return timeline.event_texts(_tracks(spark, sf).where("kind <> 'highlights'"), turns).select("video_id", "kind", "i", "text")


ACTIONS = "acts as (select conv_id as video_id, turn, turn * 10.0::double as c0, least(20.0, greatest(0.0, turn * 1.7 - 1)) as t, trim(substr(concat(role, ' ', turn % 2), 1, 200)) as action, concat(' ', upper(role), '  ', turn % 2) as raw from conversations)"


@register("actions_parsed", f"{ACTIONS}, d as (select video_id, turn, action, round(c0 + t, 2) as t_start, round(least(c0 + 20, c0 + t + 3), 2) as t_end from acts where turn % 5 <> 4) select video_id, turn, action, t_start, t_end from d union all select video_id, turn, 'second', round(c0, 2), round(c0 + 3, 2) from acts where turn % 5 <> 4")
def actions_parsed(spark, sf):
    raw = F.expr("""case when turn % 5 = 4 then 'no list here' else concat('Sure: [{"t": ', turn * 1.7 - 1, ', "action": " ', role, ' ', turn % 2, ' "}, {"t": 15, "action": "', upper(role), '  ', turn % 2, '"}, 7, {"t": "x", "action": "never"}, {"action": "never"}, {"t": -4, "action": "second"}, {"t": 3, "action": " "}] thanks') end""")
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), "turn", raw.alias("raw"), (F.col("turn") * 10.0).alias("clip_start"), F.lit(20.0).alias("clip_dur"))
    return timeline.parsed_actions(rows, 3.0).select("video_id", "turn", "action", "t_start", "t_end")


@register("sports_highlights", f"""{SPANS}, t as (select video_id, ord, unnest([{{'n': 1, 'label': case label when 'view' then 'Cheering' when 'click' then 'Speech' when 'purchase' then 'Slam dunk' else 'Air Horn' end, 'score': score / 490}}, {{'n': 2, 'label': 'Crowd', 'score': (ord * 37 % 101) / 101.0::double}}, {{'n': 3, 'label': 'Music', 'score': 0.99::double}}]) as tag from spans),
h as (select video_id, ord, lower(tag.label) as label, tag.score as score, tag.n as n from t where tag.score >= 0.15 and lower(tag.label) similar to '.*(cheer|applause|crowd|shout|yell|whistle|horn|siren|slam|dunk).*'), b as (select * from h qualify row_number() over (partition by ord order by score desc, n) = 1)
select video_id, ord, case when label like '%cheer%' then 'cheer' when label like '%crowd%' then 'crowd' when label like '%horn%' then 'horn' when label like '%slam%' then 'slam' end as event, case when score >= 0.6 then 'high' when score >= 0.35 then 'medium' else 'low' end as intensity, round(score, 6) as score from b""")
def sports_highlights(spark, sf):
    tags = F.expr("array(struct(case label when 'view' then 'Cheering' when 'click' then 'Speech' when 'purchase' then 'Slam dunk' else 'Air Horn' end as label, score / 490 as score), struct('Crowd' as label, (ord * 37 % 101) / 101D as score), struct('Music' as label, 0.99D as score))")
    return timeline.sports_plays(V.spans(spark, sf).select("video_id", "ord", tags.alias("tags"))).select("video_id", "ord", "event", "intensity", _r("score"))


@register("sequence_check_all", f"{SPANS}, q as (select c_custkey as seq from customer), s as (select video_id as seq, ord, score >= 5 as found, t_start, lag(t_start) over (partition by video_id order by ord) as late from spans), g as (select seq, bool_and(found and coalesce(late <= t_start, true)) as ok, count(*) as n from s group by 1) select q.seq, coalesce(ok, false) as in_order, coalesce(n, 0) as n_steps from q left join g using (seq)")
def sequence_check_all(spark, sf):
    steps = V.spans(spark, sf).selectExpr("video_id as seq", "ord", "score >= 5 as found", "t_start")
    asked = table(spark, sf, "customer").selectExpr("c_custkey as seq")
    rows = asked.join(intervals.rolling_order_ok(steps), "seq", "left")
    return rows.select("seq", F.coalesce("in_order", F.lit(False)).alias("in_order"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


@register("excitement_curve", f"{SPANS}, p as (select video_id, ord // 3 as step, case label when 'view' then 'Cheering' when 'click' then 'Speech' when 'purchase' then 'Hubbub, Chatter, Crowd' else 'Silence' end as label, score / 490 as prob from spans), e as (select video_id, step, sum(prob * case when label = 'Cheering' then 1.0 when label = 'Speech' then 0.15 when label like 'Hubbub%' then 0.8 else 0.0 end) as total from p group by 1, 2), m as (select *, min(total) over w as lo, max(total) over w as hi from e window w as (partition by video_id)) select video_id, step, round(total, 6) as total, round(case when hi > lo then (total - lo) / (hi - lo) else total end, 6) as norm from m")
def excitement_curve(spark, sf):
    probs = V.spans(spark, sf).selectExpr("video_id", "ord div 3 as step", "case label when 'view' then 'Cheering' when 'click' then 'Speech' when 'purchase' then 'Hubbub, Chatter, Crowd' else 'Silence' end as label", "score / 490 as prob")
    return timeline.excitement(probs).select("video_id", "step", _r("total"), _r("norm"))


@register("audio_top_tag_runs", f"{SPANS}, top as (select * from (select video_id, ord, t_start, t_end, case when ord % 5 = 0 then null else label end as label, score / 490 as score from spans) where label is not null and score >= 0.15), {RUNS.format(label='label', src='top')}, {ISLES.format(by='video_id, run', tie='ord', src='runs', gap=1.0)} select video_id, label, min(t_start) as t_start, max(t_end) as t_end, max(score) as score, min(ord) as ord from b group by video_id, run, label, isle")
def audio_top_tag_runs(spark, sf):
    tags = F.expr("if(ord % 5 = 0, cast(array() as array<struct<label:string,score:double>>), array(struct(label, score / 490 as score), struct('Second' as label, 0.01D as score)))")
    return timeline.top_tag_runs(V.spans(spark, sf).select("video_id", "ord", "t_start", "t_end", tags.alias("tags")))


@register("global_times", f"{VIDEOS}, c as (select user_id as parent_id, video_id as chunk_offset, round(duration) as d from videos), o as (select *, round(coalesce(sum(d) over (partition by parent_id order by chunk_offset rows between unbounded preceding and 1 preceding), 0), 3) as starts_at from c) select parent_id, chunk_offset, k as local_t, starts_at + k as global_t from o, (select unnest([0.0::double, 7.5]) as k)")
def global_times(spark, sf):
    from ..operators import rollups

    chunks = V.videos(spark, sf).selectExpr("user_id as parent_id", "video_id as chunk_offset", "round(duration) as duration")
    local = rollups.chunk_offsets(chunks).withColumn("local_t", F.explode(F.array(F.lit(0.0), F.lit(7.5))))
    return local.select("parent_id", "chunk_offset", "local_t", (F.col("starts_at") + F.col("local_t")).alias("global_t"))


@register("sequence_zip", f"{SPANS}, a as (select video_id, ord, row_number() over (partition by video_id order by ord) as n from spans where score >= 100), b as (select video_id, t_start, label, row_number() over (partition by video_id order by t_start, ord) as n from spans) select a.video_id, a.n as step, a.ord as asked, b.label, b.t_start, b.t_start is not null as found from a left join b on a.video_id = b.video_id and a.n = b.n")
def sequence_zip(spark, sf):
    rows = V.spans(spark, sf)
    asked = rows.where("score >= 100").select("video_id", F.col("ord").alias("asked"))
    return spans.zipped(asked, ["asked"], rows.select("video_id", "t_start", "ord", "label"), ["t_start", "ord"], "video_id").select("video_id", "step", "asked", "label", "t_start", F.col("t_start").isNotNull().alias("found"))


@register(
    "shots_speech_split",
    """s as (select conv_id as video_id, turn as shot_idx, turn * 100.0::double as t_start, turn * 100.0::double + least(length(coalesce(text, '')), 4000) / 10.0::double as t_end, replace(text, chr(10), ' ') as text from conversations),
w as (select video_id, shot_idx, t_start, t_end, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as k from s where text is not null),
x as (select *, t_start + k * 0.5::double as w_start, t_start + k * 0.5::double + (case when k % 9 = 0 then 0.05 else 0.3 end)::double as w_end from w where t_start + k * 0.5::double < t_end),
e as (select video_id, shot_idx, t_start, t_end, w_end as spot, regexp_matches(trim(word), '[.!?]$') or coalesce(lead(w_start) over (partition by video_id, shot_idx order by w_start) - w_end >= 0.4, false) as ends from x),
p as (select video_id, shot_idx, list(spot) as places from e where ends and spot - t_start >= 0.75 and t_end - spot >= 0.75 group by all),
b as (select s.video_id, s.shot_idx, s.t_start, s.t_end, coalesce(p.places, []) as places from s left join p using (video_id, shot_idx)),
steps as (select * from (with recursive r as (
  select video_id, shot_idx, t_start, t_end, places, [t_start] as cuts from b
  union all
  select video_id, shot_idx, t_start, t_end, places, list_append(cuts, coalesce(list_max(list_filter(places, lambda t: t >= cuts[-1] + 5 and t <= cuts[-1] + 10)), list_max(list_filter(places, lambda t: t > cuts[-1] and t <= cuts[-1] + 15)), cuts[-1] + 10)) from r where t_end - cuts[-1] > 10 and len(places) > 0) select * from r)),
last as (select video_id, shot_idx, t_start, t_end, len(places) as n, cuts from steps qualify row_number() over (partition by video_id, shot_idx order by len(cuts) desc) = 1),
marks as (select video_id, shot_idx, case when t_end - t_start <= 10 then [t_start, t_end] when n = 0 then list_transform(range(ceil((t_end - t_start) / 10)::bigint + 1), lambda i: t_start + i * ((t_end - t_start) / ceil((t_end - t_start) / 10))) when cuts[-1] < t_end - 0.001 then list_append(cuts, t_end) else cuts end as m from last)
select video_id, shot_idx, k::int as piece, round(m[k + 1], 6) as t_start, round(m[k + 2], 6) as t_end from (select video_id, shot_idx, m, unnest(range(len(m) - 1)) as k from marks)""",
)
def shots_speech_split(spark, sf):
    s = table(spark, sf, "conversations").selectExpr("conv_id as video_id", "turn as shot_idx", "turn * 100D as t_start", "turn * 100D + least(length(coalesce(text, '')), 4000) / 10D as t_end", "replace(text, '\n', ' ') as text")
    w = s.select("video_id", "shot_idx", "t_start", "t_end", F.posexplode(F.split("text", " ")).alias("k", "word"))
    w = w.selectExpr("video_id", "shot_idx", "word", "t_end", "t_start + k * 0.5D as w_start", "t_start + k * 0.5D + case when k % 9 = 0 then 0.05D else 0.3D end as w_end").where("w_start < t_end")
    return intervals.split_long_shots(s, w).select("video_id", "shot_idx", "piece", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


# --- segmenters that need no model -------------------------------------------------------------------------------

PLAYED = "played as (select conv_id as video_id, turn as shot_idx, turn * 10.0::double as t_start, turn * 10.0::double + 9 as t_end, concat(' ', left(text, 30), ' ') as chunk_caption, case when turn % 3 = 0 then left(text, 20) end as ocr_text, case when turn % 5 > 1 then role end as person, case when turn % 11 > 3 then concat('r', turn // 12 % 2) end as role from conversations)"


def _played(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id as video_id", "turn as shot_idx", "turn * 10D as t_start", "turn * 10D + 9 as t_end", "concat(' ', left(text, 30), ' ') as chunk_caption", "case when turn % 3 = 0 then left(text, 20) end as ocr_text", "case when turn % 5 > 1 then role end as person", "case when turn % 11 > 3 then concat('r', turn div 12 % 2) end as role")


@register("preset_shots", f"{PLAYED} select 'shot_detection' as definition, video_id, shot_idx as segment_idx, t_start, t_end, trim(coalesce(chunk_caption, '')) as label from played union all select 'ocr', video_id, shot_idx, t_start, t_end, trim(ocr_text) from played where trim(coalesce(ocr_text, '')) <> ''")
def preset_shots(spark, sf):
    return presets.segments(_played(spark, sf), [{"id": "shot_detection"}, {"id": "ocr"}])


@register("preset_persons", f"{PLAYED}, r as (select *, sum(case when person is distinct from before then 1 else 0 end) over (partition by video_id order by t_start, shot_idx) as run from (select *, lag(person) over (partition by video_id order by t_start, shot_idx) as before from played)), g as (select video_id, run, person, min(t_start) as t_start, max(t_end) as t_end from r where person is not null group by all) select 'person_of_focus' as definition, video_id, row_number() over (partition by video_id order by run) - 1 as segment_idx, t_start, t_end, person as label from g")
def preset_persons(spark, sf):
    return presets.segments(_played(spark, sf), [{"id": "person_of_focus"}])


@register(
    "preset_editorial",
    f"""{PLAYED}, o as (select *, row_number() over (partition by video_id order by t_start, shot_idx) as n from played),
rec as (select * from (with recursive r as (select video_id, shot_idx, n, t_start, t_end, t_start as s, 0::bigint as chunk, role from o where n = 1 union all select o.video_id, o.shot_idx, o.n, o.t_start, o.t_end, case when o.t_end - r.s > 90 then o.t_start else r.s end, case when o.t_end - r.s > 90 then r.chunk + 1 else r.chunk end, o.role from r join o on o.video_id = r.video_id and o.n = r.n + 1) select * from r)),
c as (select video_id, chunk, min(t_start) as t_start, max(t_end) as t_end, (list(role order by t_start, shot_idx) filter (role is not null))[1] as role from rec where chunk < 24 group by all),
m as (select *, sum(case when before is null or role is null or before <> role then 1 else 0 end) over (partition by video_id order by t_start, chunk) as isle from (select *, lag(role) over (partition by video_id order by t_start, chunk) as before from c)),
g as (select video_id, role, isle, min(t_start) as t_start, max(t_end) as t_end from m group by all)
select 'editorial_segment' as definition, video_id, row_number() over (partition by video_id order by t_start) - 1 as segment_idx, t_start, t_end, role as label from g""",
)
def preset_editorial(spark, sf):
    return presets.segments(_played(spark, sf), [{"id": "editorial_segment"}])


@register("modality_labels", "p as (select o_orderkey as video_id, case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then false else true end as probed, o_orderkey % 3 > 0 as v, o_orderkey % 4 > 0 as a, case when o_orderkey % 5 = 0 then 'N/A' else o_totalprice::varchar end as duration from orders), q as (select *, not coalesce(probed, false) as failed from p), r as (select *, failed or v as has_video, failed or a as has_audio from q) select video_id, has_video, has_audio, case when has_video and has_audio then 'video_audio' when has_video then 'video_only' else 'audio_only' end as modality, case when failed then 0.0 else coalesce(try_cast(duration as double), 0.0) end::double as duration_s from r")
def modality_labels(spark, sf):
    probes = table(spark, sf, "orders").selectExpr("o_orderkey as video_id", "case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then false else true end as probed", "filter(array(if(o_orderkey % 3 > 0, 'video', null), if(o_orderkey % 4 > 0, 'audio', null)), x -> x is not null) as codecs", "case when o_orderkey % 5 = 0 then 'N/A' else cast(o_totalprice as string) end as duration")
    return media.with_modality(probes).select("video_id", "has_video", "has_audio", "modality", "duration_s")


@register("frame_samples", "c as (select event_id as clip_id, (event_id % 97)::double as start_s, (event_id % 97 + value / 10)::double as end_s, 25.0::double as fps, (500 + event_id % 2500)::bigint as n_frames from events), d as (select *, trunc(start_s * fps)::bigint as a0, least(trunc(end_s * fps)::bigint, n_frames) as b0 from c), e as (select clip_id, case when b0 - a0 <= 0 then 0 else a0 end as a, case when b0 - a0 <= 0 then n_frames else b0 end as b from d), f as (select *, least(8, b - a) as n from e) select clip_id, k::bigint as k, (case when n = 1 then a when k = n - 1 then b - 1 else floor(k * ((b - 1 - a) / (n - 1)::double) + a) end)::bigint as frame from (select *, unnest(range(n)) as k from f)")
def frame_samples(spark, sf):
    clips = table(spark, sf, "events").selectExpr("event_id as clip_id", "cast(event_id % 97 as double) as start_s", "cast(event_id % 97 + value / 10 as double) as end_s", "25D as fps", "cast(500 + event_id % 2500 as long) as n_frames")
    return media.frame_numbers(clips).select("clip_id", F.posexplode("frames").alias("k", "frame")).select("clip_id", F.col("k").cast("long").alias("k"), "frame")
