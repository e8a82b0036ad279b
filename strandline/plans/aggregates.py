"""Queries of rollups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import islands as I
from ..operators import joins as J
from .bindings import HOUR, conv, ev_points, ev_ranges, ev_seg, ev_shots, spans, sql, table
from .islands import AUDIO, associations, overlap_ratios
from .joins import _AROUND, _ATTR, BUCKET, around, attributed, matches, match_sql
from ..operators import quality as Q
from .registry import QUERIES, query
from .signals import keyframes, _KEYS

_HITS = ", hit as (select s.video, s.seq, p.value, p.kind from ev_shots s left join ev_points p on p.video = s.video and time_ms >= start_ms and time_ms < end_ms)"


def hits(spark, sf):
    return J.point_in_shot(ev_points(spark, sf), ev_shots(spark, sf))


@query("energy_by_shot", sql("ev_shots", _HITS + """
select video, seq, round(median(value), 6) as median, min(value) as least, max(value) as most, count(value) as n, case when count(value) = 0 then 'unknown' when median(value) < 40 then '静音' when median(value) < 60 then '低' when median(value) < 75 then '中' when median(value) < 88 then '高' else '峰值' end as label from hit group by all"""))
def energy_by_shot(spark, sf):
    rows = A.by_shot(ev_shots(spark, sf), hits(spark, sf), "value", ["video", "seq"])
    return rows.withColumn("label", F.coalesce(S.loudness_label(F.col("median") - 100), F.lit("unknown"))).withColumn("median", F.round("median", 6))


@query("quality_flags", sql("ev_shots ev_seg", _HITS + """, q as (select video, seq, median(value) as m, max(value) as top, count(value) as n from hit group by all),
x as (select distinct s.video, s.seq, g.text from ev_shots s join ev_seg g on s.video = g.video and s.start_ms < g.end_ms and g.start_ms < s.end_ms and g.end_ms > g.start_ms where g.text in ('signup', 'purchase'))
select video, seq, array_to_string(list_filter([case when m >= 70 then '画面模糊' end, case when m <= 20 then '欠曝' end, case when m >= 60 then '过曝' end, case when top >= 150 and video % 7 <> 0 then '音频削波' end,
  case when exists (select 1 from x where x.video = q.video and x.seq = q.seq and text = 'signup') then '黑场' end, case when exists (select 1 from x where x.video = q.video and x.seq = q.seq and text = 'purchase') then '画面冻结' end], lambda x: x is not null), ',') as flags, case when n >= 2 then 'high' else 'unknown' end as confidence from q"""))
def quality_flags(spark, sf):
    """Medians over samples, events by overlap; no clipping without an audio track (multiples of 7 here)."""
    shots, seg = ev_shots(spark, sf), ev_seg(spark, sf)
    left = shots.select("video", "seq", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    events = seg.where("text in ('signup', 'purchase')").select("video", "text", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    seen = J.overlap_join(left, events, BUCKET).groupBy("video", "seq").agg(F.bool_or(F.col("text") == "signup").alias("black"), F.bool_or(F.col("text") == "purchase").alias("frozen"))
    rows = A.by_shot(shots, hits(spark, sf), "value", ["video", "seq"]).join(seen, ["video", "seq"], "left")
    m = F.col("median")
    tests = {"画面模糊": m >= 70, "欠曝": m <= 20, "过曝": m >= 60, "音频削波": (F.col("most") >= 150) & (F.col("video") % 7 != 0), "黑场": F.col("black"), "画面冻结": F.col("frozen")}
    return rows.select("video", "seq", F.array_join(A.flags(tests), ",").alias("flags"), F.when(F.col("n") >= 2, "high").otherwise("unknown").alias("confidence"))


_MUSIC = """, x as (select s.video, s.seq, sum(least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms)) filter (where g.text = 'view') as a, sum(least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms)) filter (where g.text <> 'view') as b
  from ev_shots s join ev_seg g on s.video = g.video and s.start_ms < g.end_ms and g.start_ms < s.end_ms and g.end_ms > g.start_ms group by all),
mus as (select s.video, s.seq, least(1, coalesce(a, 0) / (end_ms - start_ms)) as music, least(1, coalesce(b, 0) / (end_ms - start_ms)) as quiet from ev_shots s left join x on s.video = x.video and s.seq = x.seq),
music_state as (select video, seq, case when music >= 0.05 then 'music' when quiet >= 0.05 then 'silent' else 'unknown' end as state, case when music >= 0.05 or quiet >= 0.05 then case when video % 4 = 0 then 'medium' else 'high' end else 'unknown' end as confidence, round(music, 6) as music_ratio, round(quiet, 6) as silent_ratio from mus)"""


def music_states(spark, sf):
    """Limit 0.05 instead of 0.5 on this binding; videos divisible by 4 count as degraded."""
    shots, seg = ev_shots(spark, sf), ev_seg(spark, sf)
    a = overlap_ratios(shots, seg.where("text = 'view'")).select("video", "seq", F.col("ratio").alias("music"))
    b = overlap_ratios(shots, seg.where("text <> 'view'")).select("video", "seq", F.col("ratio").alias("quiet"))
    rows = a.join(b, ["video", "seq"])
    state = F.when(F.col("music") >= 0.05, "music").when(F.col("quiet") >= 0.05, "silent").otherwise("unknown")
    confidence = F.when(state == "unknown", "unknown").when(F.col("video") % 4 == 0, "medium").otherwise("high")
    return rows.select("video", "seq", state.alias("state"), confidence.alias("confidence"), F.round("music", 6).alias("music_ratio"), F.round("quiet", 6).alias("silent_ratio"))


@query("music_state_by_shot", sql("ev_shots ev_seg", _MUSIC + " select * from music_state"))
def music_state_by_shot(spark, sf):
    return music_states(spark, sf)


@query("state_tally", sql("ev_shots ev_seg", _MUSIC + " select v.video, s.state, count(m.state) as n from (select distinct video from ev_shots) v cross join (values ('music'), ('silent'), ('unknown')) s(state) left join music_state m on m.video = v.video and m.state = s.state group by all"))
def state_tally(spark, sf):
    states = F.array(F.lit("music"), F.lit("silent"), F.lit("unknown"))
    counts = music_states(spark, sf).groupBy("video").agg(F.count_if(F.col("state") == "music").alias("music"), F.count_if(F.col("state") == "silent").alias("silent"), F.count_if(F.col("state") == "unknown").alias("unknown"))
    return counts.select("video", F.explode(F.arrays_zip(states.alias("state"), F.array("music", "silent", "unknown").alias("n"))).alias("x")).select("video", F.col("x.state"), F.col("x.n").alias("n"))


@query("distribution", """
with r as (select c_nationkey as video, case when o_orderstatus = 'P' then 'unknown' else o_orderpriority end as v from orders join customer on c_custkey = o_custkey), g as (select video, v, count(*) as n from r where v <> 'unknown' group by all)
select video, v, n, round(n / sum(n) over (partition by video), 4) as share from g""")
def distribution(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("video"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderpriority")).alias("v"))
    return A.distribution(rows, "v")


@query("duration_stats", sql("spans", """ select video, count(*) as n, round(avg(end_ms - start_ms) / 1000, 3) as mean_sec, round(quantile_cont(end_ms - start_ms, 0.5) / 1000, 3) as p50_sec,
  case when count(*) >= 5 then round(quantile_cont(end_ms - start_ms, 0.1) / 1000, 3) end as p10_sec, case when count(*) >= 5 then round(quantile_cont(end_ms - start_ms, 0.9) / 1000, 3) end as p90_sec from spans group by video"""))
def duration_stats(spark, sf):
    return A.duration_stats(spans(spark, sf).withColumn("d", F.col("end_ms") - F.col("start_ms")), "d")


@query("duration_stats_spread", QUERIES["duration_stats"][1])
def duration_stats_spread(spark, sf):
    """Every key of more than 30 rows counts as hot here."""
    return A.duration_stats(spans(spark, sf).withColumn("d", F.col("end_ms") - F.col("start_ms")), "d", hot_rows=30)


_COVER = """, r as (select video, min(start_ms) + 864000000 as range_start, max(end_ms) as range_end from spans group by video having max(end_ms) > min(start_ms) + 864000000),
c as (select s.video, greatest(start_ms, range_start) as a, least(end_ms, range_end) as b from spans s join r using (video) where least(end_ms, range_end) > greatest(start_ms, range_start)),
o as (select *, max(b) over (partition by video order by a, b rows between unbounded preceding and 1 preceding) as before from c),
u as (select video, sum(greatest(0, b - greatest(a, coalesce(before, a)))) as union_ms from o group by video)"""


@query("coverage_ratio", sql("spans", _COVER + " select r.video, round(least(1.0, coalesce(union_ms, 0) / (range_end - range_start)), 4) as coverage from r left join u using (video)"))
def coverage_ratio(spark, sf):
    return A.extent_coverage(spans(spark, sf), 864_000_000)


@query("bgm_coverage", sql("ev_seg ev_ranges ev_shots", _MUSIC + """, c as (select s.video, greatest(start_ms, range_start) as a, least(end_ms, range_end) as b from ev_seg s join ev_ranges using (video) where text = 'click' and s.video % 2 = 0 and least(end_ms, range_end) > greatest(start_ms, range_start)),
o as (select *, max(b) over (partition by video order by a, b rows between unbounded preceding and 1 preceding) as before from c), u as (select video, sum(greatest(0, b - greatest(a, coalesce(before, a)))) as union_ms from o group by video),
p as (select video, sum(music * (end_ms - start_ms)) as weighted from mus join ev_shots using (video, seq) group by video)
select r.video, round(least(1.0, coalesce(union_ms, weighted, 0) / (range_end - range_start)), 4) as coverage from ev_ranges r left join u using (video) left join p using (video)"""))
def bgm_coverage(spark, sf):
    """Intervals where a video has them (even videos here), else the shots' ratios weighted by length."""
    ranges = ev_ranges(spark, sf)
    inside = I.clip(ev_seg(spark, sf).where("text = 'click' and video % 2 = 0").join(ranges, "video"), "range_start", "range_end")
    shots = ev_shots(spark, sf)
    weighted = overlap_ratios(shots, ev_seg(spark, sf).where("text = 'view'")).groupBy("video").agg(F.sum(F.col("ratio") * (F.col("end_ms") - F.col("start_ms"))).alias("weighted"))
    rows = ranges.join(I.union_length(inside), "video", "left").join(weighted, "video", "left")
    return rows.select("video", A.ratio(F.coalesce("union_ms", "weighted", F.lit(0)), F.col("range_end") - F.col("range_start")).alias("coverage"))


@query("text_stats", sql("ev_seg", " select video, count(*) as n_segments, sum(length(text))::bigint as n_chars, sum(end_ms - start_ms)::bigint as speech_ms from ev_seg group by video"))
def text_stats(spark, sf):
    return ev_seg(spark, sf).groupBy("video").agg(F.count("*").alias("n_segments"), F.sum(F.char_length("text")).alias("n_chars"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))


_HIER = """ from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey"""


def hierarchy(spark, sf):
    """Slots, blocks and shots with durations: regions, nations and customers."""
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("r_name").alias("slot_id"), F.col("n_nationkey").alias("block"), F.col("c_custkey").alias("shot_id"), (F.col("c_custkey") % 97 * 1000 + 500).alias("duration_ms"), (F.col("n_nationkey") * 100_000).alias("start_ms"), (F.col("n_nationkey") * 100_000 + 90_000).alias("end_ms"))


@query("modal_value", """
with g as (select o_custkey as video, o_orderpriority as density, count(*) as n, min(o_orderkey) as first from orders where o_orderpriority <> '4-NOT SPECIFIED' group by all)
select video, density, n from g qualify row_number() over (partition by video order by n desc, first) = 1""")
def modal_value(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("video"), F.col("o_orderpriority").alias("density"), "o_orderkey")
    return A.modal(rows, "density", ["o_orderkey"], excluded=["4-NOT SPECIFIED"])


@query("slot_pacing", f"with x as (select r_name as slot_id, c_custkey % 97 * 1000 + 500 as d {_HIER}) select slot_id, count(*) as n_shots, round(avg(d) / 1000, 3) as avg_sec from x group by slot_id")
def slot_pacing(spark, sf):
    return hierarchy(spark, sf).groupBy("slot_id").agg(F.count("*").alias("n_shots"), A.seconds(F.avg("duration_ms")).alias("avg_sec"))


@query("boundary_alignment_by_slot", sql("ev_shots", ", " + AUDIO + """, a as (select c.video, c.cut_ms, case when c.video % 5 = 0 then 'unavailable' else classification end as classification from assoc c where video % 3 <> 1), v as (select distinct video from ev_shots)
select v.video, case when count(a.cut_ms) = 0 then true when count(*) filter (where classification <> 'unavailable') = 0 then false else avg((classification = 'synchronizedCut')::int) filter (where classification <> 'unavailable') >= 0.5 end as aligned from v left join a on a.video = v.video group by v.video"""))
def boundary_alignment_by_slot(spark, sf):
    """Videos 1 mod 3 stand for slots without seams, multiples of 5 have no audio."""
    seams = associations(spark, sf).where("video % 3 <> 1").select("video", F.when(F.col("video") % 5 == 0, "unavailable").otherwise(F.col("classification")).alias("classification"))
    return A.seam_alignment(ev_shots(spark, sf).select("video").distinct(), seams)


@query("music_alignment", sql("ev_shots ev_seg", """, e as (select video, end_ms as t from ev_shots qualify row_number() over (partition by video order by seq desc) > 1),
c as (select e.video, t, exists (select 1 from ev_seg g where g.video = e.video and text = 'view' and start_ms <= t and t < g.end_ms and g.end_ms > start_ms) as covered from e),
n as (select v.video, avg(covered::int) as share, count(covered) as n, exists (select 1 from ev_seg g where g.video = v.video and text = 'view' and g.end_ms > start_ms) and v.video % 6 <> 0 as music from (select distinct video from ev_shots) v left join c on c.video = v.video group by v.video)
select video, case when not music then 'no music detected' when n = 0 then 'unknown' when share >= 0.5 then 'music aligned with story boundaries' else 'music not aligned with story boundaries' end as label from n"""))
def music_alignment(spark, sf):
    """Block ends but the last, in document order, that lie inside music; detection did not complete for multiples of 6."""
    w = W.partitionBy("video").orderBy(F.desc("seq"))
    ends = ev_shots(spark, sf).withColumn("k", F.row_number().over(w)).where("k > 1").select("video", "seq", F.col("end_ms").alias("s1"), (F.col("end_ms") + 1).alias("e1"))
    music = ev_seg(spark, sf).where("text = 'view' and end_ms > start_ms").select("video", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    hit = J.overlap_join(ends, music, BUCKET).select("video", "seq").distinct().withColumn("hit", F.lit(1))
    g = ends.join(hit, ["video", "seq"], "left").groupBy("video").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    any_ = music.where("video % 6 <> 0").select("video").distinct().withColumn("music", F.lit(True))
    rows = ev_shots(spark, sf).select("video").distinct().join(g, "video", "left").join(any_, "video", "left")
    return rows.select("video", F.when(F.col("music").isNull(), "no music detected").when(F.col("share").isNull(), "unknown").when(F.col("share") >= 0.5, "music aligned with story boundaries").otherwise("music not aligned with story boundaries").alias("label"))


@query("expectation_chains", """
with b as (select n_nationkey as id, 'B' || lpad(n_nationkey::varchar, 4, '0') as block_id, 'echo → B' || lpad(((n_nationkey * 7 + 3) % 30)::varchar, 4, '0') as relation, n_regionkey as slot from nation),
m as (select block_id, min(slot) as slot from (select block_id, slot from b union all select block_id, (slot + 1) % 5 from b where id % 4 = 0) group by block_id)
select b.block_id as from_block, t.block_id as to_block, s.slot as from_slot, t.slot as to_slot from b join m s using (block_id) join m t on t.block_id = regexp_extract(relation, '(B\\d{4})', 1) where s.slot <> t.slot""")
def expectation_chains(spark, sf):
    """Relations whose two ends lie in different slots; a block's first slot wins."""
    n = table(spark, sf, "nation")
    block = lambda c: F.format_string("B%04d", c.cast("bigint"))
    b = n.select(block(F.col("n_nationkey")).alias("from_block"), F.concat(F.lit("echo → "), block((F.col("n_nationkey") * 7 + 3) % 30)).alias("relation"))
    member = n.select(block(F.col("n_nationkey")).alias("block"), F.col("n_regionkey").alias("slot")).unionByName(n.where("n_nationkey % 4 = 0").select(block(F.col("n_nationkey")).alias("block"), ((F.col("n_regionkey") + 1) % 5).alias("slot")))
    first = member.groupBy("block").agg(F.min("slot").alias("slot"))
    rows = b.withColumn("to_block", S.relation_target("relation")["target"])
    rows = rows.join(first.select(F.col("block").alias("from_block"), F.col("slot").alias("from_slot")), "from_block").join(first.select(F.col("block").alias("to_block"), F.col("slot").alias("to_slot")), "to_block")
    return rows.where("from_slot <> to_slot").select("from_block", "to_block", "from_slot", "to_slot")


@query("speech_by_shot", sql("ev_seg ev_shots", _ATTR + " select video, seq, string_agg(trim(text), ' ' order by start_ms, end_ms, pos) as text from attr group by video, seq"))
def speech_by_shot(spark, sf):
    return A.joined_text(attributed(spark, sf), "text", ["s1", "e1", "pos"], ["video", "seq"])


@query("shot_summaries", """
with l as (select l_orderkey, count(*) as n_lines, string_agg(distinct l_returnflag, '、' order by l_returnflag) as flags from lineitem group by l_orderkey)
select o_orderkey as shot_id, o_orderpriority || '；' || o_orderstatus as visual, coalesce(n_lines, 0) as n_texts, coalesce(flags, '') as texts, coalesce(c_mktsegment, 'unknown') as camera from orders left join l on l_orderkey = o_orderkey left join (select * from customer where c_custkey % 5 <> 0) on c_custkey = o_custkey""")
def shot_summaries(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("shot_id")).agg(F.count("*").alias("n_texts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "、").alias("texts"))
    c = table(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("camera"))
    rows = table(spark, sf, "orders").withColumn("shot_id", F.col("o_orderkey")).join(l, "shot_id", "left").join(c, "o_custkey", "left")
    return rows.select("shot_id", S.content_summary("o_orderpriority", "o_orderstatus").alias("visual"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("texts", F.lit("")).alias("texts"), F.coalesce("camera", F.lit("unknown")).alias("camera"))


_PAIRS = _HITS + _AROUND + """, e as (select video, seq, median(value) as m from hit group by all),
p as (select video, seq, lead(seq) over (partition by video order by seq) as nxt, end_ms as b_ms from ev_shots),
w as (select p.video, p.seq as left_seq, p.nxt as right_seq, round(r.m - l.m, 6) as luma, g.gap_ms, g.spans from p join e l on l.video = p.video and l.seq = p.seq join e r on r.video = p.video and r.seq = p.nxt join gaps g on g.video = p.video and g.seq = p.seq where nxt is not null)"""


def pair_metrics(spark, sf):
    e = A.by_shot(ev_shots(spark, sf), hits(spark, sf), "value", ["video", "seq"]).select("video", "seq", "median")
    pairs = J.adjacent_pairs(ev_shots(spark, sf).join(e, ["video", "seq"]), "seq", ["seq", "median"])
    gaps = around(spark, sf).select("video", F.col("seq").alias("left_seq"), "gap_ms", "spans")
    return pairs.join(gaps, ["video", "left_seq"]).select("video", "left_seq", "right_seq", F.round(F.col("right_median") - F.col("left_median"), 6).alias("luma"), "gap_ms", "spans")


@query("review_reasons", sql("ev_shots ev_seg", _PAIRS + """, r as (select *, list_filter([case when luma is null then 'lumaUnavailable' when abs(luma) >= 40 then 'lumaJump' when abs(luma) < 0.8 then 'lumaFlat' end, case when gap_ms >= 7200000 then 'longGap' end], lambda x: x is not null) as l from w)
select video, left_seq, right_seq, array_to_string(l, ',') as reasons, len(l) > 0 as needs_review from r"""))
def review_reasons(spark, sf):
    luma = F.col("luma")
    reasons = F.array_compact(F.array(F.when(luma.isNull(), "lumaUnavailable").when(F.abs(luma) >= 40, "lumaJump").when(F.abs(luma) < 0.8, "lumaFlat"), F.when(F.col("gap_ms") >= 2 * HOUR, "longGap")))
    return pair_metrics(spark, sf).select("video", "left_seq", "right_seq", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("needs_review"))


@query("motion_shot_summary", sql("ev_series ev_shots", _KEYS + """, k as (select k.video, property, coalesce(s.seq, (select max(seq) from ev_shots z where z.video = k.video)) as seq from keyf k left join ev_shots s on s.video = k.video and time_ms >= start_ms and time_ms < end_ms)
select s.video, s.seq, count(property) as n, coalesce(string_agg(distinct property, ',' order by property), '') as properties, count(property) > 0 as needs_review from ev_shots s left join k on k.video = s.video and k.seq = s.seq group by s.video, s.seq"""))
def motion_shot_summary(spark, sf):
    g = keyframes(spark, sf).groupBy("video", "seq").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("property")), ",").alias("properties"))
    rows = ev_shots(spark, sf).select("video", "seq").join(g, ["video", "seq"], "left").fillna({"n": 0, "properties": ""})
    return rows.withColumn("needs_review", F.col("n") > 0)


@query("status_rollups", "select o_custkey as video, case when bool_and(o_orderstatus = 'F') then 'complete' when bool_or(o_orderstatus = 'F') then 'partial' else 'failed' end as status from orders group by o_custkey")
def status_rollups(spark, sf):
    return A.status_rollup(table(spark, sf, "orders").select(F.col("o_custkey").alias("video"), "o_orderstatus"), "o_orderstatus", complete="F")


_SCORES = """, g as (select video, count(*) as g from gold group by video), f as (select video, n as f from det), h as (select video, count(*) as hits from matched group by video),
scores as (select video, coalesce(hits, 0) as hits, coalesce(g, 0) - coalesce(hits, 0) as missed, coalesce(f, 0) - coalesce(hits, 0) as false_positives, case when coalesce(g, 0) = 0 then 1.0 else coalesce(hits, 0) / g end as recall, case when coalesce(f, 0) = 0 then 1.0 else coalesce(hits, 0) / f end as precision
  from g full join f using (video) left join h using (video))"""


@query("eval_boundary", match_sql("7200000") + _SCORES + " select * from scores")
def eval_boundary(spark, sf):
    """On greedy matches; also compared with a plain loop in the tests."""
    golden, found, tolerance = matches(spark, sf)
    return A.recall_precision(golden, found, J.greedy_match(golden, found, tolerance))


@query("eval_enum_accuracy", """
with g as (select doc_id, quality as v from labels), p as (select doc_id, lang, (n_chars > 300)::int as v from documents), x as (select coalesce(g.doc_id, p.doc_id) as id, coalesce(lang, 'none') as lang, g.v is not distinct from p.v as same from g full join p using (doc_id))
select lang, count(*) as n, sum(same::int)::bigint as n_same, round(avg(same::int), 6) as accuracy from x group by lang""")
def eval_enum_accuracy(spark, sf):
    g = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("g"))
    p = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 300).cast("int").alias("p"))
    rows = g.join(p, "doc_id", "full").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("g").eqNullSafe(F.col("p")).cast("int").alias("same"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("same").alias("n_same"), F.round(F.avg("same"), 6).alias("accuracy"))


@query("analysis_range", sql("ev_shots ev_ranges", """, s as (select video, sum(end_ms - start_ms)::bigint as total from ev_shots group by video), m as (select video, case when video % 3 = 0 then null else range_start end as a, case when video % 5 = 0 then range_start else range_end end as b from ev_ranges)
select video, coalesce(case when b > a then b - a end, total) as total_ms, case when coalesce(case when b > a then b - a end, total, 0) <= 0 then 'rejected' else 'ok' end as status from m left join s using (video)"""))
def analysis_range(spark, sf):
    total = ev_shots(spark, sf).groupBy("video").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    a, b = F.when(F.col("video") % 3 != 0, F.col("range_start")), F.when(F.col("video") % 5 == 0, F.col("range_start")).otherwise(F.col("range_end"))
    rows = ev_ranges(spark, sf).join(total, "video", "left").withColumn("total_ms", F.coalesce(F.when(b > a, b - a), "total"))
    return rows.select("video", "total_ms", F.when(F.coalesce("total_ms", F.lit(0)) <= 0, "rejected").otherwise("ok").alias("status"))


@query("transcript_text", sql("conv", " select video, string_agg(trim(text), ' ' order by seq) as text from conv where trim(text) <> '' group by video"))
def transcript_text(spark, sf):
    return A.joined_text(conv(spark, sf), "text", ["seq"])


@query("slot_rollup", f"""
with x as (select r_name as slot_id, n_nationkey, c_custkey, c_custkey % 97 * 1000 + 500 as duration_ms, n_nationkey * 100000 as start_ms, n_nationkey * 100000 + 90000 as end_ms, c_mktsegment as kind {_HIER}), t as (select sum(duration_ms) as total from x),
b as (select slot_id, string_agg(n_nationkey::varchar, ',' order by start_ms) as block_ids from (select distinct slot_id, n_nationkey, start_ms from x) group by slot_id), k as (select slot_id, string_agg(kind, '、' order by kind) as types from (select distinct slot_id, kind from x) group by slot_id)
select slot_id, count(distinct n_nationkey) as min_blocks, count(distinct c_custkey) as n_shots, round((arg_max(end_ms, start_ms) - min(start_ms)) / any_value(total), 4) as duration_share, round(min(start_ms) / 1000, 3) as start_sec, round(arg_max(end_ms, start_ms) / 1000, 3) as end_sec,
  round(avg(duration_ms) / 1000, 3) as avg_shot_sec, any_value(block_ids) as block_ids, any_value(types) as types from x join b using (slot_id) join k using (slot_id), t group by slot_id""")
def slot_rollup(spark, sf):
    """Blocks in the order of their start; types are the distinct kinds of the slot's shots."""
    x = hierarchy(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id"), F.col("c_mktsegment").alias("kind")), "shot_id")
    total = x.agg(F.sum("duration_ms").alias("total"))
    blocks = F.transform(F.array_sort(F.collect_set(F.struct("start_ms", "block"))), lambda b: b["block"].cast("string"))
    rows = x.groupBy("slot_id").agg(
        F.countDistinct("block").alias("min_blocks"), F.countDistinct("shot_id").alias("n_shots"), F.min("start_ms").alias("s"), F.max_by("end_ms", "start_ms").alias("e"),
        F.avg("duration_ms").alias("d"), F.array_join(blocks, ",").alias("block_ids"), F.array_join(F.array_sort(F.collect_set("kind")), "、").alias("types"))
    rows = rows.withColumn("total", total.scalar())
    return rows.select("slot_id", "min_blocks", "n_shots", F.round((F.col("e") - F.col("s")) / F.col("total"), 4).alias("duration_share"), A.seconds("s").alias("start_sec"), A.seconds("e").alias("end_sec"), A.seconds("d").alias("avg_shot_sec"), "block_ids", "types")


_WIDE = _HITS + _AROUND + """, e as (select video, seq, median(value) as m, count(value) as n, end_ms from hit join ev_shots using (video, seq) group by all),
f as (select *, case when n >= 2 then floor(m) - 100 end as db, case n % 3 when 1 then 'pan' when 2 then 'static' end as mv, case when n % 4 <> 0 then 'music' || n % 4 end as mu from e),
g as (select video, seq as l, lead(seq) over w as r, end_ms as b, m as lm, lead(m) over w as rm, db as ld, lead(db) over w as rd, mv as lv, lead(mv) over w as rv, mu as lu, lead(mu) over w as ru from f window w as (partition by video order by seq)),
w as (select g.*, gp.gap_ms, gp.spans, case when exists (select 1 from ev_points a where a.video = g.video and a.kind = 'purchase') then exists (select 1 from ev_points a where a.video = g.video and a.kind = 'purchase' and abs(a.time_ms - b) <= 3600000) end as aligned,
  'shots[' || (l - 1) || '],' as p1, '#shots[' || (r - 1) || ']' as p2 from g join gaps gp on gp.video = g.video and gp.seq = l where r is not null)
"""
_AT = "case when {t} then 'raw/{d}.json#shots[' || (l - 1) || '],raw/{d}.json#shots[' || (r - 1) || ']' else '' end"


def _cell(name: str, there: str, value: str, refs: str, unit: str = "null", lacking: str = "unknown") -> str:
    if refs == "#frames":
        refs = "concat_ws(',', case when lm is not null then 'frames/' || l || '--' || r || '/left-exit.jpg' end, case when rm is not null then 'frames/' || l || '--' || r || '/right-entry.jpg' end)"
        return f"select video, l as left_shot, r as right_shot, '{name}' as metric, case when {there} then ({value})::varchar end as value, case when {there} then 'value' else '{lacking}' end as status, {unit}::varchar as unit, {refs} as refs from w"
    refs = _AT.format(t=there, d=refs) if "#" not in refs else f"case when {there} then '{refs}' else '' end"
    return f"select video, l as left_shot, r as right_shot, '{name}' as metric, case when {there} then ({value})::varchar end as value, case when {there} then 'value' else '{lacking}' end as status, {unit}::varchar as unit, {refs} as refs from w"


_CELLS = _WIDE + " , cells as (" + " union all ".join([
    _cell("lumaDelta", "lm is not null and rm is not null", "printf('%.3f', round(rm - lm, 3))", "#frames", lacking="unavailable"), _cell("audioLevelDeltaDb", "ld is not null and rd is not null", "printf('%.2f', round(rd - ld, 2))", "audio-energy", "'dB'"),
    _cell("cameraMotionChange", "lv is not null or rv is not null", "coalesce(lv, '-') || ' > ' || coalesce(rv, '-')", "camera-motion"), _cell("audioCutAligned", "aligned is not null", "aligned", "raw/audio-cuts.json#boundaries"),
    _cell("speechGapMs", "gap_ms is not null", "gap_ms", "raw/asr.json#segments", "'ms'"), _cell("speechSpansBoundary", "spans is not null", "spans", "raw/asr.json#segments"),
    _cell("musicContinuity", "lu is not null or ru is not null", "coalesce(lu, '-') || ' > ' || coalesce(ru, '-')", "music-flags")]) + ")"


def wide_pairs(spark, sf):
    e = A.by_shot(ev_shots(spark, sf), hits(spark, sf), "value", ["video", "seq"]).select("video", "seq", "median", "n")
    n, m = F.col("n"), F.col("median")
    rows = ev_shots(spark, sf).join(e, ["video", "seq"]).select("video", "seq", "end_ms", m.alias("luma"), F.when(n >= 2, F.floor(m) - 100).alias("db"), F.when(n % 3 == 1, "pan").when(n % 3 == 2, "static").alias("move"), F.when(n % 4 != 0, F.concat(F.lit("music"), n % 4)).alias("music"))
    pairs = J.adjacent_pairs(rows, "seq", ["seq", "end_ms", "luma", "db", "move", "music"])
    gaps = around(spark, sf).select("video", F.col("seq").alias("left_seq"), "gap_ms", "spans")
    cuts = J.band_exists(pairs.select("video", F.col("left_end_ms").alias("cut_ms")), ev_points(spark, sf, "purchase").select("video", F.col("time_ms").alias("audio_ms")), HOUR)
    pairs = pairs.join(gaps, ["video", "left_seq"]).join(cuts.select("video", F.col("cut_ms").alias("left_end_ms"), "aligned"), ["video", "left_end_ms"])
    frame = lambda side, name: F.when(F.col(f"{side}_luma").isNotNull(), F.format_string(f"frames/%d--%d/{name}.jpg", "left_seq", "right_seq"))
    pairs = pairs.withColumn("left_frame", frame("left", "left-exit")).withColumn("right_frame", frame("right", "right-entry"))
    return pairs.withColumn("left", F.col("left_seq")).withColumn("right", F.col("right_seq")).withColumn("left_at", F.col("left_seq") - 1).withColumn("right_at", F.col("right_seq") - 1)


@query("pair_metrics_table", sql("ev_shots ev_seg", _CELLS + " select * from cells"))
def pair_metrics_table(spark, sf):
    """Seven metrics of each adjacent pair in long form."""
    rows = A.pair_metric_rows(wide_pairs(spark, sf))
    return rows.select("video", F.col("left").alias("left_shot"), F.col("right").alias("right_shot"), "metric", "value", "status", "unit", F.array_join("refs", ",").alias("refs"))


@query("pair_view", sql("ev_shots ev_seg", _CELLS + """, t as (select w.video, l, b, max(time_ms) filter (where time_ms < b) as lp, min(time_ms) filter (where time_ms >= b) as rp, count(p.video) > 0 as has from w left join ev_points p on p.video = w.video and p.kind = 'click' and w.video % 4 <> 0 group by all)
select c.video, c.left_shot || '--' || c.right_shot as pair_id, """ + ", ".join(f"max(value) filter (where metric = '{m}') as \"{m}\"" for m in Q.METRICS) + """, count(*) filter (where status <> 'value') as n_lacking, case when count(*) filter (where status <> 'value') = 0 then 'complete' else 'partial' end as status,
  case when c.left_shot % 3 = 0 then 'value' else 'unknown' end as semantics, case when any_value(has) then 'pts' else 'average-rate' end as frame_source, any_value(case when has then coalesce(lp, b - 40) else b - 40 end) as left_frame_ms, any_value(case when has then coalesce(rp, b) else b end) as right_frame_ms
from cells c join t on t.video = c.video and t.l = c.left_shot group by c.video, c.left_shot, c.right_shot"""))
def pair_view(spark, sf):
    """One row a pair for review: metrics, semantics and the frames beside the boundary, from the frame index or, where a video has none (here of multiples of 4), from the frame rate."""
    pairs = wide_pairs(spark, sf)
    frames = ev_points(spark, sf, "click").where("video % 4 <> 0").select("video", F.col("time_ms").alias("pts_ms"))
    semantics = pairs.where("left % 3 = 0").select("video", "left", F.lit("value").alias("semantics"))
    view = A.pair_view(A.pair_metric_rows(pairs), pairs.select("video", "left", F.col("left_end_ms").alias("boundary_ms")), semantics, frames, 40, list(Q.METRICS))
    return view.select("video", F.concat_ws("--", "left", "right").alias("pair_id"), *Q.METRICS, "n_lacking", "status", "semantics", "frame_source", "left_frame_ms", "right_frame_ms")


@query("golden_gate", match_sql("(case when g.video % 2 = 0 then 7200000 else 3600000 end)") + _SCORES + """ select video, recall, precision,
  video % 7 = 0 or recall >= (case when video % 2 = 0 then 0.2 else 0.5 end)::double and precision >= (case when video % 2 = 0 then 0.1 else 0.25 end)::double as passed from scores""")
def golden_gate(spark, sf):
    """Each video against its own minimum recall and precision, with its own tolerance; every seventh has no limits."""
    v = F.col("video")
    golden, found, tolerance = matches(spark, sf)
    parts = [golden.where(v % 2 == k).transform(lambda g, k=k: A.recall_precision(g, found.where(v % 2 == k), J.greedy_match(g, found.where(v % 2 == k), tolerance // (k + 1)))) for k in (0, 1)]
    scores = parts[0].unionByName(parts[1])
    limits = scores.where("video % 7 <> 0").select("video", F.when(v % 2 == 0, 0.2).otherwise(0.5).alias("least_recall"), F.when(v % 2 == 0, 0.1).otherwise(0.25).alias("least_precision"))
    return A.golden_gate(scores, limits).select("video", "recall", "precision", "passed")


@query("review_kpis", """with m as (select o_custkey as video, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45 group by o_custkey)
select o_custkey as video, count(*) as n_shots, count(*) filter (where o_orderstatus = 'P') as n_review, sum(o_orderkey % 1000)::bigint as total, count(*) filter (where o_orderpriority = '1-URGENT') as n_music, count(*) filter (where o_orderpriority = '4-NOT SPECIFIED') as n_unknown,
  count(*) filter (where o_totalprice > 200000) as n_flagged, coalesce(any_value(n), 0) as n_motion, case when bool_and(o_orderstatus = 'F') then 'complete' when bool_or(o_orderstatus = 'F') then 'partial' else 'failed' end as status from orders left join m on m.video = o_custkey group by o_custkey""")
def review_kpis(spark, sf):
    """Per video one row of counts; flagged quality are dear orders, motion candidates large lines."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("video"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    shots = o.select("video", (F.col("o_orderstatus") == "P").alias("needs_review"), (F.col("o_orderkey") % 1000).alias("duration_ms"), F.when(F.col("o_orderpriority") == "1-URGENT", "music").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("silent").alias("music"), (F.col("o_totalprice") > 200_000).alias("flagged"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"))
    motion = table(spark, sf, "lineitem").where("l_quantity > 45").join(o.select("video", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("video")
    return A.review_kpis(shots, motion).withColumnRenamed("total_ms", "total")
