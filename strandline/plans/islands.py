"""Queries of gaps-and-islands and interval algebra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import islands as I
from ..operators import joins as J
from .bindings import HOUR, conv, ev_points, ev_ranges, ev_seg, ev_series, ev_shots, spans, sql
from .registry import query

GAP = 2 * HOUR
_MERGED = """, o as (select *, max(end_ms) over (partition by video order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from spans where end_ms > start_ms),
g as (select *, sum((before is null or start_ms > before)::int) over (partition by video order by start_ms, end_ms rows unbounded preceding) as island from o),
merged as (select video, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from g group by video, island)"""
_RUNS = f""", o as (select *, max(end_ms) over (partition by video order by start_ms, end_ms, pos rows between unbounded preceding and 1 preceding) as before from ev_seg),
g as (select *, sum((before is null or start_ms - before >= {GAP})::int) over (partition by video order by start_ms, end_ms, pos rows unbounded preceding) as run from o),
runs as (select video, run - 1 as run, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from g group by video, run)"""


@query("merge_intervals", sql("spans", _MERGED + " select * from merged"))
def merge_intervals(spark, sf):
    return I.merge_intervals(spans(spark, sf).select("video", "start_ms", "end_ms"))


@query("speech_runs", sql("ev_seg", _RUNS + " select * from runs"))
def speech_runs(spark, sf):
    return I.speech_runs(ev_seg(spark, sf), GAP)


@query("interval_union_length", sql("spans", _MERGED + " select video, sum(end_ms - start_ms) as union_ms from merged group by video"))
def interval_union_length(spark, sf):
    return I.union_length(spans(spark, sf))


_GAPS = f""", c as (select s.video, greatest(start_ms, range_start) as a, least(end_ms, range_end) as b, range_start, 0 as tail from ev_seg s join ev_ranges using (video)
  union all select video, range_end, range_end, range_start, 1 from ev_ranges),
p as (select *, greatest(range_start, coalesce(max(b) over (partition by video order by tail, a, b rows between unbounded preceding and 1 preceding), range_start)) as gap_start from c),
gaps as (select video, gap_start, a as gap_end from p where a - gap_start >= {HOUR})"""


@query("complement_gaps", sql("ev_seg ev_ranges", _GAPS + " select * from gaps"))
def complement_gaps(spark, sf):
    return I.complement_gaps(ev_seg(spark, sf), ev_ranges(spark, sf), HOUR)


@query("group_hits", sql("ev_series", """, h as (select video, i, value, i - lag(i) over (partition by video order by i) as step from ev_series where value > 40),
g as (select *, sum((step is null or step > 2)::int) over (partition by video order by i rows unbounded preceding) as grp from h)
select video, grp, min(i) as first_i, max(i) as last_i, count(*) as n from g group by video, grp"""))
def group_hits(spark, sf):
    rows = I.group_hits(ev_series(spark, sf).where("value > 40").select("video", "i", "value"))
    return rows.groupBy("video", "grp").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))


@query("rle_blocks", sql("conv", """, r as (select *, row_number() over (partition by video order by seq) - row_number() over (partition by video, state order by seq) as d from conv),
b as (select video, state, min(seq) as start, max(seq) as last, string_agg(seq::varchar, ',' order by seq) as members from r group by video, state, d)
select video, 'B' || lpad(row_number() over (partition by video order by start)::varchar, 4, '0') as block_id, state, start, last as "end", members from b"""))
def rle_blocks(spark, sf):
    out = I.rle_blocks(conv(spark, sf), "state", "seq", "seq", "seq", ["seq"])
    return out.select("video", "block_id", "state", "start", "end", F.array_join("members", ",").alias("members"))


def _rle_sql(name: str, source: str, state: str) -> str:
    return f"""{name}0 as (select *, ({state} is distinct from lag({state}) over (partition by video order by i) or row_number() over (partition by video order by i) = 1)::int as opens from {source}),
{name} as (select * exclude (opens), sum(opens) over (partition by video order by i rows unbounded preceding) as run from {name}0)"""


def _smooth_sql(source: str, merge_gap: int, minimum: int, blocked: str, out: str) -> str:
    """CTEs that smooth column m of ``source`` (video, i, m)."""
    return f"""{_rle_sql(out + "1", source, "m")},
{out}2 as (select *, count(*) over (partition by video, run) as size, bool_or({blocked}) over (partition by video, run) as stop, max(run) over (partition by video) as last_run from {out}1),
{out}3 as (select * exclude (m, run, size, stop, last_run), m or (run > 1 and run < last_run and size <= {merge_gap} and not stop) as m from {out}2),
{_rle_sql(out + "4", out + "3", "m")},
{out} as (select * exclude (m, run), m and count(*) over (partition by video, run) >= {minimum} as m from {out}4)"""


@query("smooth_mask", sql("ev_series", ", src as (select video, i, value > 20 as m, value > 15 and value <= 17 as blocked from ev_series), " + _smooth_sql("src", 2, 3, "blocked", "s") + " select video, i, m as mask from s"))
def smooth_mask(spark, sf):
    rows = ev_series(spark, sf).select("video", "i", (F.col("value") > 20).alias("mask"), F.col("value").between(15.0000001, 17).alias("b"))
    return I.smooth_mask(rows, "mask", 2, 3, F.col("b")).select("video", "i", "mask")


def _intervals_sql(source: str, mask: str, half: int, out: str) -> str:
    return f"""{_rle_sql(out + "1", source, mask)},
{out}2 as (select video, min(time_ms) - {half} as a, max(time_ms) + {half} as b from {out}1 where {mask} group by video, run),
{out} as (select video, greatest(a, range_start) as start_ms, least(b, range_end) as end_ms from {out}2 join ev_ranges using (video) where least(b, range_end) > greatest(a, range_start))"""


@query("mask_to_intervals", sql("ev_series ev_ranges", ", src as (select video, i, time_ms, value > 20 as m from ev_series), " + _intervals_sql("src", "m", 30000, "x") + " select * from x"))
def mask_to_intervals(spark, sf):
    rows = ev_series(spark, sf).select("video", "i", "time_ms", (F.col("value") > 20).alias("m"))
    return I.mask_to_intervals(rows, "m", "time_ms", 30_000, ev_ranges(spark, sf))


@query("overlap_ratio", sql("ev_shots ev_seg", """
, x as (select s.video, s.seq, sum(least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms)) as shared from ev_shots s join ev_seg g on s.video = g.video and s.start_ms < g.end_ms and g.start_ms < s.end_ms and g.end_ms > g.start_ms group by all)
select s.video, s.seq, round(least(1, coalesce(shared, 0) / (end_ms - start_ms)), 9) as ratio from ev_shots s left join x on s.video = x.video and s.seq = x.seq"""))
def overlap_ratio(spark, sf):
    return overlap_ratios(ev_shots(spark, sf), ev_seg(spark, sf)).select("video", "seq", F.round("ratio", 9).alias("ratio"))


def overlap_ratios(shots, intervals, bucket=HOUR * 6):
    """Share of each shot that the intervals cover, clamped to 1; 0 without any."""
    left = shots.select("video", "seq", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    right = intervals.select("video", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    shared = J.overlap_join(left, right, bucket).groupBy("video", "seq").agg(F.sum("overlap_ms").alias("shared"))
    ratio = F.least(F.lit(1.0), F.coalesce("shared", F.lit(0)) / (F.col("end_ms") - F.col("start_ms")))
    return shots.join(shared, ["video", "seq"], "left").withColumn("ratio", ratio)


@query("cuts_to_partition", sql("ev_shots", """
 select video, 'SH' || lpad(seq::varchar, 4, '0') as shot_id, start_ms, end_ms, end_ms - start_ms as duration_ms,
  case when seq = 1 then 'sourceStart' else 'hardCutCandidate' end as boundary_in, case when lead(seq) over (partition by video order by seq) is null then 'sourceEnd' else 'hardCutCandidate' end as boundary_out,
  end_ms - start_ms <= 600000 or seq % 10 = 0 as needs_review from ev_shots"""))
def cuts_to_partition(spark, sf):
    return I.shot_table(ev_shots(spark, sf), 600_000, F.col("seq") % 10 == 0).drop("seq")


@query("contiguity_and_overlap_check", sql("spans", """, o as (select video, start_ms, end_ms, max(end_ms) over (partition by video order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from spans where end_ms > start_ms)
select video, count(*) filter (where start_ms < before) as n_overlap, count(*) filter (where start_ms > before) as n_gap, sum(abs(start_ms - before))::bigint as off_ms from o where start_ms <> before group by video"""))
def contiguity_and_overlap_check(spark, sf):
    rows = I.contiguity_violations(spans(spark, sf).select("video", "start_ms", "end_ms"))
    return rows.groupBy("video").agg(F.count_if(F.col("kind") == "overlap").alias("n_overlap"), F.count_if(F.col("kind") == "gap").alias("n_gap"), F.sum(F.abs(F.col("start_ms") - F.col("before"))).alias("off_ms"))


def _packed(spark, sf):
    """Greedy packing with a limit of six hours and a pad of ten minutes on this binding (30 s and 200 ms in production)."""
    segments = ev_seg(spark, sf).join(ev_ranges(spark, sf), "video").where("start_ms < range_end and end_ms > start_ms")
    segments = segments.withColumn("end_ms", F.least("end_ms", "range_end"))
    return I.pack_windows(segments.select("video", "start_ms", "end_ms", "pos", "range_end"), 6 * HOUR, 600_000)


# the same greedy packing, as a recursive walk over the segments of a video
_PACKED = f""", s0 as (select g.video, start_ms, least(end_ms, range_end) as end_ms, range_end, row_number() over (partition by g.video order by start_ms, least(end_ms, range_end)) as k
  from ev_seg g join ev_ranges using (video) where start_ms < range_end and end_ms > start_ms),
walk as (select video, k, start_ms as a, end_ms as b, 1 as n, range_end from s0 where k = 1
  union all select s.video, s.k, case when s.end_ms - w.a <= {6 * HOUR} then w.a else s.start_ms end, case when s.end_ms - w.a <= {6 * HOUR} then greatest(w.b, s.end_ms) else s.end_ms end,
    case when s.end_ms - w.a <= {6 * HOUR} then w.n else w.n + 1 end, s.range_end from walk w join s0 s on s.video = w.video and s.k = w.k + 1),
packed as (select video, greatest(0, min(a) - 600000) as start_ms, least(any_value(range_end), max(b) + 600000) as end_ms from walk group by video, n)"""


def _recursive(text: str) -> str:
    return "with recursive " + text.removeprefix("with ")


@query("pack_windows", _recursive(sql("ev_seg ev_ranges", _PACKED + " select * from packed")))
def pack_windows(spark, sf):
    return _packed(spark, sf)


_CONCAT = """, axis as (select video, start_ms, end_ms, n, (coalesce(sum(end_ms - start_ms) over (partition by video order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) + 500 * (n - 1))::bigint as concat_ms
  from (select *, row_number() over (partition by video order by start_ms, end_ms) as n from packed))"""


@query("concat_timeline", _recursive(sql("ev_seg ev_ranges", _PACKED + _CONCAT + " select * from axis")))
def concat_timeline(spark, sf):
    return I.concat_timeline(_packed(spark, sf))


@query("timeline_remap", _recursive(sql("ev_seg ev_ranges", _PACKED + _CONCAT + """, t as (select video, concat_ms + k * 7000000 as concat_time from axis, range(3) r(k))
select t.video, concat_time, least(arg_max(start_ms, concat_ms) + concat_time - max(concat_ms), arg_max(end_ms, concat_ms)) as source_ms
from t join axis a on t.video = a.video and a.concat_ms <= t.concat_time group by t.video, concat_time, t.rowid_ """.replace(", t.rowid_", ""))))
def timeline_remap(spark, sf):
    axis = I.concat_timeline(_packed(spark, sf))
    times = axis.select("video", F.explode(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.col("concat_ms") + k * 7_000_000)).alias("concat_time")).distinct()
    return I.timeline_remap(times, axis)


@query("fixed_windows", sql("ev_ranges", """
, w as (select video, range_end, unnest(generate_series(range_start, range_end - 1, 86400000)) as start_ms from ev_ranges)
select video, start_ms, least(range_end, start_ms + 86400000) as end_ms from w"""))
def fixed_windows(spark, sf):
    return I.fixed_windows(ev_ranges(spark, sf), 24 * HOUR)


@query("normalize_segments", sql("ev_seg", """
, b as (select min(start_ms) + 864000000 as low, max(start_ms) - 864000000 as high from ev_seg),
r as (select video, pos, start_ms, end_ms - (case when pos % 11 = 0 then 99999999 else 0 end) as end_ms, case when pos % 13 = 0 then null else text end as text, low, high from ev_seg, b)
select video, pos, case when start_ms is null or end_ms is null or text is null then 'malformed' when start_ms >= end_ms then 'bad order' when greatest(start_ms, low) >= least(end_ms, high) then 'outside'
    when greatest(start_ms, low) <> start_ms or least(end_ms, high) <> end_ms then 'clamped' else 'kept' end as action,
  case when text is not null and start_ms < end_ms and greatest(start_ms, low) < least(end_ms, high) then greatest(start_ms, low) end as clamped_start,
  case when text is not null and start_ms < end_ms and greatest(start_ms, low) < least(end_ms, high) then least(end_ms, high) end as clamped_end from r"""))
def normalize_segments(spark, sf):
    seg = ev_seg(spark, sf)
    low, high = seg.agg(F.min("start_ms") + 864_000_000).scalar(), seg.agg(F.max("start_ms") - 864_000_000).scalar()
    rows = seg.withColumn("end_ms", F.col("end_ms") - F.when(F.col("pos") % 11 == 0, 99_999_999).otherwise(0)).withColumn("text", F.when(F.col("pos") % 13 != 0, F.col("text")))
    rows = rows.withColumn("low", low).withColumn("high", high)
    return I.normalize_segments(rows, F.col("low"), F.col("high")).select("video", "pos", "action", "clamped_start", "clamped_end")


def audio_points(spark, sf):
    """Audio boundaries: purchases and carts, shifted to fall near cuts."""
    rows = ev_points(spark, sf).where("kind <> 'view'")
    return rows.select("video", F.col("time_ms").alias("audio_ms"), F.col("value").alias("score"), F.col("id").alias("audio_id"))


AUDIO = """audio as (select video, time_ms as audio_ms, value as score, id as audio_id from ev_points where kind <> 'view'),
cuts as (select video, start_ms as cut_ms from ev_shots where seq > 1),
best as (select c.video, c.cut_ms, audio_ms, score, audio_id from cuts c left join audio a on c.video = a.video and abs(audio_ms - cut_ms) <= 3600000
  qualify row_number() over (partition by c.video, c.cut_ms order by score desc nulls last, audio_ms, audio_id) = 1),
assoc as (select *, audio_ms - cut_ms as offset_ms, case when audio_ms is null then 'pictureCutAudioContinuous' when abs(audio_ms - cut_ms) <= 1200000 then 'synchronizedCut' else 'audioBoundaryUndetermined' end as classification,
  case when score >= 12 then 'high' else 'medium' end as confidence from best)"""
SYNC, WINDOW = 1_200_000, HOUR


def associations(spark, sf):
    cuts = ev_shots(spark, sf).where("seq > 1").select("video", F.col("start_ms").alias("cut_ms"))
    return J.band_best(cuts, audio_points(spark, sf), SYNC, WINDOW).withColumn("confidence", S.cut_confidence("score"))


_MOVES = """, sides as (select video, start_ms as l, end_ms as cut_ms, lead(end_ms) over (partition by video order by seq) as r, seq as left_seq from ev_shots),
moves as (select s.video, left_seq, s.cut_ms, audio_ms from sides s join assoc a on s.video = a.video and s.cut_ms = a.cut_ms
  where r is not null and classification = 'synchronizedCut' and confidence = 'high' and audio_ms <> s.cut_ms and audio_ms - l >= 60000 and r - audio_ms >= 60000)"""


@query("boundary_shift", sql("ev_shots", ", " + AUDIO + _MOVES + """
, x as (select s.video, s.seq, coalesce(b.audio_ms, s.start_ms) as start_ms, coalesce(e.audio_ms, s.end_ms) as end_ms from ev_shots s
  left join moves e on s.video = e.video and s.seq = e.left_seq left join moves b on s.video = b.video and s.seq = b.left_seq + 1)
select *, end_ms - start_ms as duration_ms from x"""))
def boundary_shift(spark, sf):
    shots = ev_shots(spark, sf)
    return I.apply_shifts(shots, I.plan_shifts(shots, associations(spark, sf), 60_000))


@query("state_scan_intervals", sql("ev_series ev_ranges", """
, st as (select video, i, time_ms, case when value <= 8 then 'silent' when value >= 30 then 'music' else 'unknown' end as state from ev_series),
a as (select video, i, time_ms, state = 'music' as m, state = 'silent' as quiet from st), b as (select video, i, time_ms, state = 'silent' as m from st), """
+ _smooth_sql("a", 2, 2, "quiet", "am") + ", " + _smooth_sql("b", 0, 2, "false", "bm") + ", " + _intervals_sql("am", "m", 30000, "ai") + ", " + _intervals_sql("bm", "m", 30000, "bi") + """
select 'music' as state, * from ai union all select 'silent', * from bi"""))
def state_scan_intervals(spark, sf):
    """Music: gaps of up to 2 windows without silence are bridged, runs of 2 kept; silence: runs of 2, nothing bridged."""
    state = F.when(F.col("value") <= 8, "silent").when(F.col("value") >= 30, "music").otherwise("unknown")
    rows, ranges, out = ev_series(spark, sf).select("video", "i", "time_ms", state.alias("state")), ev_ranges(spark, sf), None
    for name, bridged in (("music", 2), ("silent", 0)):
        mask = rows.withColumn("m", F.col("state") == name)
        mask = I.smooth_mask(mask, "m", bridged, 2, F.col("state") == "silent" if name == "music" else None)
        part = I.mask_to_intervals(mask, "m", "time_ms", 30_000, ranges).select(F.lit(name).alias("state"), "video", "start_ms", "end_ms")
        out = part if out is None else out.unionByName(part)
    return out


@query("music_interval_fusion", sql("ev_seg ev_ranges ev_series", ", src as (select video, i, time_ms, value > 20 as m from ev_series), " + _intervals_sql("src", "m", 30000, "scan") + _GAPS + """
, u as (select video, start_ms, end_ms from scan union all select video, gap_start, gap_end from gaps where video % 2 = 0),
o as (select *, max(end_ms) over (partition by video order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as before from u where end_ms > start_ms),
g as (select *, sum((before is null or start_ms - before > 600)::int) over (partition by video order by start_ms, end_ms rows unbounded preceding) as island from o)
select video, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from g group by video, island"""))
def music_interval_fusion(spark, sf):
    """Even videos have a complete transcript, so their gaps are anchors."""
    mask = ev_series(spark, sf).select("video", "i", "time_ms", (F.col("value") > 20).alias("m"))
    scan = I.mask_to_intervals(mask, "m", "time_ms", 30_000, ev_ranges(spark, sf))
    gaps = I.complement_gaps(ev_seg(spark, sf), ev_ranges(spark, sf), HOUR).select("video", F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"))
    return I.fuse_intervals(scan, gaps, F.col("video") % 2 == 0, 600)
