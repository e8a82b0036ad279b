"""Queries of signal and change-point operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import islands as I
from ..operators import joins as J
from ..operators import signal as G
from .bindings import HOUR, emb_frames, emb_planes, ev_points, ev_ranges, ev_seg, ev_series, ev_shots, sql, table
from .islands import _GAPS, _recursive
from .registry import query

_FRAMES = ", f as (select *, lag(x) over (partition by video order by i) as p from emb_frames)"


def _avg(a: str, b: str) -> str:
    return f"list_avg(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


@query("frame_pair_metrics", sql("emb_planes", """
, e as (select *, list_transform(range(2, 17), lambda k: abs("value"[k] - "value"[k-1])) as edges, list_transform(range(0, 4), lambda b: len(list_filter(hue, lambda a: floor(a * 4) = b)) / 16.0::double) as hist from emb_planes),
f as (select *, lag(hue) over w as ph, lag(saturation) over w as ps, lag("value") over w as pv, lag(edges) over w as pe, lag(hist) over w as pb from e window w as (partition by video order by i)),
m as (select video, i, 255 * (2 * list_avg(list_transform(list_zip(hue, ph), lambda z: least(abs(z[1] - z[2]), 1 - abs(z[1] - z[2])))) + """ + _avg("saturation", "ps") + " + " + _avg('"value"', "pv") + ") / 3 as content, 255 * " + _avg("edges", "pe") + """ as edge,
  abs(list_avg("value") - list_avg(pv)) as bd, list_sum(list_transform(list_zip(hist, pb), lambda z: least(z[1], z[2]))) as hs from f where ph is not null)
select video, i, round(content, 6) as content, round(edge, 6) as edge, round(content + 0.25 * edge, 6) as change, round(-(content + 0.25 * edge), 6) as score, round(greatest(0.0, 1 - edge / 255), 6) as edge_similarity,
  round(hs, 6) as histogram_similarity, round(bd, 6) as brightness_delta from m"""))
def frame_pair_metrics(spark, sf):
    rows = G.pair_metrics(emb_planes(spark, sf))
    return rows.select("video", "i", *[F.round(c, 6).alias(c) for c in ("content", "edge", "change", "score", "edge_similarity", "histogram_similarity", "brightness_delta")])


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_SSIM = f""", m as (select video, i, list_avg(x) as mx, list_avg(p) as my, {_DOT.format('x', 'x')} / len(x) as xx, {_DOT.format('p', 'p')} / len(x) as yy, {_DOT.format('x', 'p')} / len(x) as xy from f where p is not null)
select video, i, round(least(1.0, greatest(-1.0, ((2 * mx * my + 0.0001) * (2 * (xy - mx * my) + 0.0009)) / ((mx * mx + my * my + 0.0001) * (xx - mx * mx + yy - my * my + 0.0009)))), 6) as ssim from m"""


@query("global_ssim", sql("emb_frames", _FRAMES + _SSIM))
def global_ssim(spark, sf):
    rows = emb_frames(spark, sf).withColumn("p", F.lag("x").over(W.partitionBy("video").orderBy("i"))).where("p is not null")
    return rows.select("video", "i", F.round(G.global_ssim(F.col("x"), F.col("p")), 6).alias("ssim"))


_RATIO = """, r as (select *, (coalesce(sum(value) over (partition by video order by i rows between 3 preceding and 1 preceding), 0) + coalesce(sum(value) over (partition by video order by i rows between 1 following and 3 following), 0))
    / (count(value) over (partition by video order by i rows between 3 preceding and 1 preceding) + count(value) over (partition by video order by i rows between 1 following and 3 following)) as near,
  lag(i) over (partition by video order by i) is not null and lead(i) over (partition by video order by i) is not null as inner_ from ev_series),
a as (select * exclude (near, inner_), case when inner_ then value / greatest(near, 1.0) end as ratio from r),
c as (select *, case when value >= 150 then 'rawNegativeScore' when value >= 50 and ratio >= 2 then 'adaptiveOutlier' end as reason from a where ratio is not null),
cand as (select *, case when reason = 'rawNegativeScore' then 'high' when ratio >= 3 then 'medium' else 'low' end as confidence, case when reason = 'adaptiveOutlier' and event_id % 5 = 0 then 'ssimSimilarityRejected' end as suppressed from c where reason is not null)"""


@query("adaptive_ratio", sql("ev_series", _RATIO + " select video, i, round(ratio, 6) as ratio from a"))
def adaptive_ratio(spark, sf):
    return G.adaptive_ratio(ev_series(spark, sf)).select("video", "i", F.round("ratio", 6).alias("ratio"))


def candidates(spark, sf):
    ssim = F.when(F.col("event_id") % 5 == 0, 0.99).otherwise(0.5)
    return G.cut_candidates(G.adaptive_ratio(ev_series(spark, sf)), 150, 50, 2, ssim)


@query("cut_candidates", sql("ev_series", _RATIO + " select video, i, reason, confidence, suppressed from cand"))
def cut_candidates(spark, sf):
    return candidates(spark, sf).select("video", "i", "reason", "confidence", "suppressed")


@query("nms_confidence", _recursive(sql("ev_series", _RATIO + """, o as (select video, i, confidence, row_number() over (partition by video order by value desc, i) as k from cand where suppressed is null),
rec as (select distinct video, 0::bigint as k, 0::bigint as i, '' as confidence, null::bigint as merged_into, []::struct(p bigint, c varchar)[] as kept from o union all
  select o.video, o.k, o.i, o.confidence, w.way, case when w.way is null then list_append(rec.kept, {'p': o.i, 'c': o.confidence}) else rec.kept end
  from rec join o on o.video = rec.video and o.k = rec.k + 1, lateral (select list_filter(rec.kept, lambda x: abs(o.i - x.p) < case when x.c = 'high' and o.confidence = 'high' then 2 else 6 end)[1].p as way) w)
select video, i, confidence, merged_into from rec where k > 0""")))
def nms_confidence(spark, sf):
    """Greedy by descending value; also compared with a plain loop in the tests."""
    rows = candidates(spark, sf).where("suppressed is null").select("video", F.col("i").cast("long").alias("i"), "value", "confidence")
    return G.merge_short(rows, 6, 2).select("video", "i", "confidence", "merged_into")


@query("audio_frame_features", sql("emb_frames", f""", e as (select video, i, x, {_DOT.format('x', 'x')} as p, list_transform(range(0, 4), lambda k: sqrt(list_sum(list_transform(x[k * 16 + 1:k * 16 + 16], lambda a: a * a)) / 16)) as subs,
  list_sum(list_transform(range(2, 65), lambda k: abs((x[k] >= 0)::int - (x[k-1] >= 0)::int))) as crossed, list_max(list_transform(x, lambda a: abs(a))) as top,
  list_sum(list_transform(range(1, 61), lambda k: x[k] * x[k + 4])) as c4, {_DOT.format('x[1:60]', 'x[1:60]')} as a4, {_DOT.format('x[5:64]', 'x[5:64]')} as b4 from emb_frames)
select video, i, round(case when p > 0 then greatest(-99.0, 20 * log10(sqrt(p / 64))) else -99.0 end, 6) as rms_db, round(crossed / 63.0, 6) as zcr,
  round(coalesce(sqrt(list_avg(list_transform(subs, lambda s: (s - list_avg(subs)) * (s - list_avg(subs))))) / nullif(list_avg(subs), 0), 0), 6) as roughness, round(case when p > 0 then top / sqrt(p / 64) else 0 end, 6) as crest,
  round(case when a4 * b4 > 0 then c4 / sqrt(a4 * b4) else 0 end, 6) as lag4 from e"""))
def audio_frame_features(spark, sf):
    rows = emb_frames(spark, sf).select("video", "i", G.frame_features(F.col("x")).alias("f"), G.autocorrelation(F.col("x"), 4).alias("lag4"))
    return rows.select("video", "i", *[F.round(f"f.{c}", 6).alias(c) for c in ("rms_db", "zcr", "roughness", "crest")], F.round("lag4", 6).alias("lag4"))


@query("novelty_scores", sql("ev_series", """, d as (select *, abs(value - lag(value) over (partition by video order by i)) as d, abs(ln(value + 1) - lag(ln(value + 1)) over (partition by video order by i)) as e from ev_series),
s as (select video, i, d, e, median(d) over w as md, median(e) over w as me from d window w as (partition by video order by i rows between 50 preceding and 50 following))
select video, i, round(0.6 * d / greatest(md, 1.0) + 0.4 * e / greatest(me, 0.05), 6) as novelty from s"""))
def novelty_scores(spark, sf):
    rows = ev_series(spark, sf).withColumn("level", F.log(F.col("value") + 1))
    return G.novelty(rows, {"value": (0.6, 1.0), "level": (0.4, 0.05)}).select("video", "i", F.round("novelty", 6).alias("novelty"))


_PEAKS = ", n as (select *, coalesce(lag(value) over (partition by video order by i), '-inf'::double) as l, coalesce(lead(value) over (partition by video order by i), '-inf'::double) as r from ev_series), peaks as (select * from n where value > 40 and value >= l and value >= r and (value > l or value > r))"


@query("local_peaks", sql("ev_series", _PEAKS + " select video, i, value from peaks"))
def local_peaks(spark, sf):
    return G.local_peaks(ev_series(spark, sf), 40).select("video", "i", "value")


def _apart(rows: str, score: str, position: str, step: int) -> str:
    """Greedy suppression as a recursion over the rank of each row: the list of kept positions goes along."""
    return f""", o as (select *, row_number() over (partition by video order by {score} desc, {position}) as k from {rows}),
rec as (select distinct video, 0::bigint as k, false as keep, []::bigint[] as kept from o union all
  select o.video, o.k, w.free, case when w.free then list_append(rec.kept, o.{position}::bigint) else rec.kept end
  from rec join o on o.video = rec.video and o.k = rec.k + 1, lateral (select len(list_filter(rec.kept, lambda x: abs(o.{position} - x) < {step})) = 0 as free) w),
left_ as (select o.* from o join rec on o.video = rec.video and o.k = rec.k where rec.keep)"""


@query("nms_distance", _recursive(sql("ev_series", _PEAKS + _apart("peaks", "value", "i", 4) + " select video, i, value from left_")))
def nms_distance(spark, sf):
    """Greedy by descending value; also compared with a plain loop in the tests."""
    return G.suppress_close(G.local_peaks(ev_series(spark, sf).select("video", "i", "value"), 40), "value", 4)


@query("texture_events", _recursive(sql("ev_series", ", d as (select video, i, time_ms, value / 100 - lag(value / 100) over (partition by video order by i) as delta from ev_series), e as (select *, abs(delta) as size from d where abs(delta) >= 0.1)"
    + _apart("e", "size", "time_ms", 6 * HOUR) + " select video, i, time_ms, case when delta > 0 then 'textureRise' else 'textureFall' end as kind, round(delta, 6) as delta from left_")))
def texture_events(spark, sf):
    """Greedy by descending step; also compared with a plain loop in the tests."""
    rows = ev_series(spark, sf).select("video", "i", "time_ms", (F.col("value") / 100).alias("flatness"))
    return G.texture_events(rows, 0.1, 6 * HOUR).select("video", "i", "time_ms", "kind", F.round("delta", 6).alias("delta"))


@query("rms_windows", """
with s as (select l_suppkey as video, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) as i, l_quantity - 25 as v from lineitem)
select video, (i - 1) // 50 as win, round(case when avg(v * v) > 0 then 20 * log10(sqrt(avg(v * v)) / 32768) else -99.0 end, 6) as db from s group by all having count(*) = 50""")
def rms_windows(spark, sf):
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("video"), F.row_number().over(w).alias("i"), (F.col("l_quantity") - 25).alias("v"))
    return G.rms_windows(rows, 50, "v").withColumn("db", F.round("db", 6))


@query("waveform_envelope", sql("ev_points ev_ranges", """, b as (select video, range_start, unnest(generate_series(0, (range_end - 1 - range_start) // 21600000)) as bin from ev_ranges),
h as (select p.video, (time_ms - range_start) // 21600000 as bin, min(value) as lo, max(value) as hi from ev_points p join ev_ranges using (video) group by all)
select b.video, b.bin, coalesce(round(least(1.0, greatest(-1.0, lo / 117)), 3), 0) as lo, coalesce(round(least(1.0, greatest(-1.0, hi / 117)), 3), 0) as hi from b left join h on b.video = h.video and b.bin = h.bin"""))
def waveform_envelope(spark, sf):
    return G.waveform(ev_points(spark, sf), ev_ranges(spark, sf), 6 * HOUR, "value", 117.0)


@query("gap_measure", sql("ev_seg ev_ranges ev_points", _GAPS + """, m as (select g.video, gap_start, gap_end, median(value) - 60 as level, median(value * 2) as bass, count(value) as n from gaps g left join ev_points p on p.video = g.video and time_ms >= gap_start and time_ms < gap_end group by all)
select video, gap_start, gap_end, round(level, 6) as level, case when n = 0 then 'unknown' when level >= -18 or bass >= 150 then 'music' when level <= -55 then 'silent' else 'unknown' end as state from m"""))
def gap_measure(spark, sf):
    gaps = I.complement_gaps(ev_seg(spark, sf), ev_ranges(spark, sf), HOUR)
    shots = gaps.select("video", F.col("gap_start").alias("seq"), F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"))
    hits = J.point_in_shot(ev_points(spark, sf), shots).groupBy("video", F.col("seq").alias("gap_start")).agg((F.median("value") - 60).alias("level"), (F.median("value") * 2).alias("bass"))
    rows = gaps.join(hits, ["video", "gap_start"], "left")
    return rows.select("video", "gap_start", "gap_end", F.round("level", 6).alias("level"), F.when(F.col("level").isNull(), "unknown").otherwise(S.gap_state("level", "bass")).alias("state"))


@query("motion_frame_metrics", sql("emb_frames", _FRAMES + ", m as (select video, i, " + _avg("x", "p") + """ as diff, list_avg(x) - list_avg(p) as bd, abs(x[1]) + abs(x[2]) as shake, abs(x[3]) as zoom from f where p is not null)
select video, i, round(diff, 6) as diff, round(bd, 6) as brightness_delta, round(1 - least(1, diff / 0.25), 6) as repeat, round(diff + 0.7 * abs(bd), 6) as cut, round(zoom, 6) as zoom, round(shake, 6) as shake from m"""))
def motion_frame_metrics(spark, sf):
    """dx, dy and scale arrive as the first three values of a frame."""
    rows = emb_frames(spark, sf).withColumn("p", F.lag("x").over(W.partitionBy("video").orderBy("i"))).where("p is not null")
    rows = rows.withColumn("diff", G.mean_abs_diff(F.col("x"), F.col("p"))).withColumn("bd", G.mean(F.col("x")) - G.mean(F.col("p")))
    x = lambda k: F.abs(F.col("x")[k])
    out = {"diff": F.col("diff"), "brightness_delta": F.col("bd"), "repeat": 1 - F.least(F.lit(1.0), F.col("diff") / 0.25), "cut": F.col("diff") + 0.7 * F.abs("bd"), "zoom": x(2), "shake": x(0) + x(1)}
    return rows.select("video", "i", *[F.round(c, 6).alias(k) for k, c in out.items()])


_METRICS = """, m as (select video, i, time_ms, event_id, value as motion, 1 - least(1, value / 100) as repeat, value * (1 + event_id % 3) as cut, value * (event_id % 5) as move, value * (event_id % 7) / 1000 as zoom, value * (event_id % 11) / 10 as shake, (event_id % 13) / 40.0::double as bright from ev_series)"""
_LIMITS = _METRICS + """, lim as (select video, """ + ", ".join(f"round(quantile_cont({c}, {q}), 4) as {n}" for n, (c, q) in G.THRESHOLDS.items()) + " from m group by video)"


def metrics(spark, sf):
    v, e = F.col("value"), F.col("event_id")
    return ev_series(spark, sf).select("video", "i", "time_ms", "event_id", v.alias("motion"), (1 - F.least(F.lit(1.0), v / 100)).alias("repeat"), (v * (1 + e % 3)).alias("cut"), (v * (e % 5)).alias("move"), (v * (e % 7) / 1000).alias("zoom"), (v * (e % 11) / 10).alias("shake"), ((e % 13) / 40.0).alias("bright"))


@query("adaptive_thresholds", sql("ev_series", _LIMITS + " select * from lim"))
def adaptive_thresholds(spark, sf):
    return G.adaptive_thresholds(metrics(spark, sf))


def _groups(name: str, cond: str, gap: int) -> str:
    return f"""{name}0 as (select m.*, i - lag(i) over (partition by m.video order by i) as step from m join lim using (video) where {cond}),
{name} as (select *, sum((step is null or step > {gap})::int) over (partition by video order by i) as grp from {name}0)"""


_RAMPS = _LIMITS + ", " + _groups("lo", "motion <= p20 and repeat > 0.78", 2) + ", " + _groups("hi", "motion >= p80", 2) + ", " + _groups("im", "(cut >= cut90 or abs(bright) > 0.28) and motion >= p50", 1) + ", regions as (" + " union all ".join(
    f"select '{kind}' as kind, video, min(time_ms) as start_ms, max(time_ms) + 40 as end_ms, count(*) as n, avg(motion) as avg_m, max(cut) as top, arg_min(i, (-cut, i)) as peak, min(i) as first_i, max(i) as last_i from {t} group by video, grp having count(*) >= {least}"
    for kind, t, least in (("low_motion_or_freeze", "lo", 2), ("high_motion_region", "hi", 2), ("impact_cut", "im", 1))) + """),
sure as (select *, case when kind = 'impact_cut' then top when kind = 'low_motion_or_freeze' and avg_m > 0 then p20 / avg_m else avg_m end as v, case when kind = 'impact_cut' then cut90 when kind = 'low_motion_or_freeze' then 1.0 else p80 end as l from regions join lim using (video)),
ramps as (select kind, video, start_ms, end_ms, end_ms - start_ms as duration_ms, n, round(avg_m, 4) as avg_motion, case when kind = 'impact_cut' then peak end as peak_i,
  case when l <= 0 then 'unknown' when v / l >= 1.8 then 'high' when v / l >= 1.25 then 'medium' else 'low' end as confidence, case when kind = 'impact_cut' then peak::varchar else first_i || ',' || last_i end as refs from sure)"""


@query("speed_ramps", sql("ev_series", _RAMPS + " select * from ramps"))
def speed_ramps(spark, sf):
    rows = metrics(spark, sf)
    return G.speed_ramps(rows, G.adaptive_thresholds(rows), 2, 0.28, 40).withColumn("refs", F.array_join(F.col("refs").cast("array<string>"), ","))


_KEYS = _LIMITS + "".join(", " + _groups(n, f"{c} >= greatest({limit}, {floor})" + ("" if n == "exposure" else " and cut < cut90"), 1 if n == "exposure" else 2) for n, (c, limit, floor) in G.KEYFRAMES.items()) + ", keyf as (" + " union all ".join(
    f"select '{n}' as property, video, arg_min(i, (-{c}, i)) as i, arg_min(time_ms, (-{c}, i)) as time_ms, round(max({c}), 6) as peak, count(*) as n from {n} group by video, grp" for n, (c, _, _) in G.KEYFRAMES.items()) + ")"


@query("keyframe_candidates", sql("ev_series ev_shots", _KEYS + " select k.*, coalesce(s.seq, (select max(seq) from ev_shots z where z.video = k.video)) as seq from keyf k left join ev_shots s on s.video = k.video and time_ms >= start_ms and time_ms < end_ms"))
def keyframe_candidates(spark, sf):
    return keyframes(spark, sf).withColumn("peak", F.round("peak", 6))


def keyframes(spark, sf):
    rows = metrics(spark, sf)
    found = G.keyframe_candidates(rows, G.adaptive_thresholds(rows))
    return J.point_in_shot(found, ev_shots(spark, sf), tail=True)


@query("motion_digest", sql("ev_series", _RAMPS.replace("with ", "") + _KEYS.replace(_LIMITS, "") + """, u as (select video, kind, start_ms as t, n from ramps union all select video, property, time_ms, n from keyf)
select video, kind, t, n from u qualify row_number() over (partition by video order by case when n >= 3 then 0 when n = 2 then 1 else 2 end, t::varchar, kind) <= 12"""))
def motion_digest(spark, sf):
    """First twelve events by confidence (here: size), then by the time as text."""
    rows = metrics(spark, sf)
    limits = G.adaptive_thresholds(rows)
    a = G.speed_ramps(rows, limits, 2, 0.28).select("video", "kind", F.col("start_ms").alias("t"), "n")
    b = G.keyframe_candidates(rows, limits).select("video", F.col("property").alias("kind"), F.col("time_ms").alias("t"), "n")
    rank = F.when(F.col("n") >= 3, 0).when(F.col("n") == 2, 1).otherwise(2)
    w = W.partitionBy("video").orderBy(rank, F.col("t").cast("string"), "kind")
    return a.unionByName(b).withColumn("_k", F.row_number().over(w)).where("_k <= 12").drop("_k")


_MOTION = """with f0 as (select l_orderkey as video, (l_quantity - 25) / 4 as dx, l_discount * 100 - 5 as dy, 1 + l_tax - 0.04 as scale, l_linenumber <> 3 as ok from lineitem),
f as (select *, sqrt(dx * dx + dy * dy) as px from f0 where ok), n as (select video, count(*) as n from f0 group by video),
m as (select video, count(*) as pairs, median(dx) as mx, median(dy) as my, median(px) as score, median(scale) as ms from f group by video),
r as (select video, bool_or(px > 5 * score and px >= 8) as jump, avg((mx <> 0 and dx * sign(mx) >= 0.25)::int) as cx, avg((my <> 0 and dy * sign(my) >= 0.25)::int) as cy, avg((scale > 1.001)::int) as zi, avg((scale < 1 / 1.001)::int) as zo from f join m using (video) group by video),
c as (select n.video, n, coalesce(pairs, 0) as pairs, coalesce(score, 0) as score, coalesce(jump, false) as jump, coalesce(cx, 0) as cx, coalesce(cy, 0) as cy, list_filter([
  case when abs(mx) >= 2 and abs(mx) > 1.5 * abs(my) and cx > 0.7 then case when mx > 0 then 'pan_left' else 'pan_right' end end, case when abs(my) >= 2 and abs(my) > 1.5 * abs(mx) and cy > 0.7 then case when my > 0 then 'tilt_up' else 'tilt_down' end end,
  case when zi >= 0.7 and ms > 1 then 'zoom_in' when zo >= 0.7 and ms < 1 then 'zoom_out' end], lambda x: x is not null) as l from n left join m using (video) left join r using (video)),
k as (select *, case when n < 3 or pairs < 2 then 'unknown' when jump then 'discontinuity' when len(l) > 0 then l[1] when score < 1 then 'static' when cx < 0.7 and cy < 0.7 then 'handheld' else 'unknown' end as movement from c)
select video, movement, case when n >= 3 and pairs >= 2 and not jump and len(l) > 0 then array_to_string(l, ',') else movement end as candidates, case when n < 3 or pairs < 2 then 'unknown' when score < 1 then 'static' when score < 3 then 'low' when score < 10 then 'medium' else 'high' end as intensity,
  case when n < 3 or pairs < 2 then 'unknown' when jump then 'low' when len(l) > 0 then case when pairs >= 4 then 'medium' else 'low' end when score < 1 then case when pairs >= 4 then 'high' else 'medium' end else 'low' end as confidence from k"""


@query("shot_motion_classify", _MOTION)
def shot_motion_classify(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video"), ((F.col("l_quantity") - 25) / 4).alias("dx"), (F.col("l_discount") * 100 - 5).alias("dy"), (1 + F.col("l_tax") - 0.04).alias("scale"), (F.col("l_linenumber") != 3).alias("ok"))
    return G.classify_motion(rows).select("video", "movement", F.array_join("candidates", ",").alias("candidates"), "intensity", "confidence")


@query("frame_motion_contract", """
with r as (select event_id, case event_id % 5 when 0 then '{"k": "x"}' when 1 then '{"k": ' when 2 then '{}' else props end as doc from events)
select event_id, case when not json_valid(doc) then 'not json' when not json_exists(doc, '$.k') then 'missing k' when json_type(doc, '$.k') not in ('BIGINT', 'UBIGINT', 'DOUBLE') then 'k is no number' else 'ok' end as verdict from r""")
def frame_motion_contract(spark, sf):
    doc = F.expr("case event_id % 5 when 0 then '{\"k\": \"x\"}' when 1 then '{\"k\": ' when 2 then '{}' else props end")
    v = F.try_parse_json(doc)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.k", "variant"))
    verdict = F.when(v.isNull(), "not json").when(F.try_variant_get(v, "$.k", "variant").isNull(), "missing k").when(~kind.isin("BIGINT", "DOUBLE") & ~kind.startswith("DECIMAL"), "k is no number").otherwise("ok")
    return table(spark, sf, "events").select("event_id", verdict.alias("verdict"))
