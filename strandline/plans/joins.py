"""Queries of joins on time and identity, of window functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import joins as J
from ..operators.scan import running
from .bindings import SQL, HOUR, conv, ev_points, ev_ranges, ev_seg, ev_series, ev_shots, spans, sql, table
from .islands import _RUNS, AUDIO, GAP, SYNC, associations, audio_points
from .registry import QUERIES, query

BUCKET = 6 * HOUR


@query("point_in_interval_assign", sql("ev_shots", """
select id, s.seq from ev_points p left join ev_shots s on s.video = p.video and time_ms >= start_ms and time_ms < end_ms - 1"""))
def point_in_interval_assign(spark, sf):
    """Shots end 1 ms early here, so that points on the last frame fall outside."""
    shots = ev_shots(spark, sf).withColumn("end_ms", F.col("end_ms") - 1)
    return J.point_in_shot(ev_points(spark, sf), shots).select("id", "seq")


@query("point_assign_tail_clamp", sql("ev_shots", """, l as (select video, max(seq) as last_seq, max(end_ms) as last_end from ev_shots group by video)
select id, coalesce(s.seq, case when time_ms + 3600000 >= last_end then last_seq end) as seq from ev_points p join l on l.video = p.video
  left join ev_shots s on s.video = p.video and time_ms + 3600000 >= start_ms and time_ms + 3600000 < end_ms"""))
def point_assign_tail_clamp(spark, sf):
    points = ev_points(spark, sf).withColumn("time_ms", F.col("time_ms") + HOUR)
    return J.point_in_shot(points, ev_shots(spark, sf), tail=True).select("id", "seq")


_OPEN = "case when line = 7 then null else end_ms end"


@query("interval_overlap_join", sql("spans", f""", a as (select distinct video, start_ms as s1, end_ms as e1 from spans where line % 2 = 1 and end_ms > start_ms), b as (select distinct video, start_ms as s2, {_OPEN} as e2 from spans where line % 2 = 0 or line = 7)
select a.video, s1, e1, s2, e2, least(e1, coalesce(e2, {J.FOREVER})) - greatest(s1, s2) as overlap_ms from a join b on a.video = b.video and s1 < coalesce(e2, {J.FOREVER}) and s2 < e1 and coalesce(e2, {J.FOREVER}) > s2"""))
def interval_overlap_join(spark, sf):
    rows = spans(spark, sf)
    left = rows.where("line % 2 = 1").select("video", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1")).distinct()
    right = rows.where("line % 2 = 0 or line = 7").select("video", F.col("start_ms").alias("s2"), F.expr(_OPEN).alias("e2")).distinct()
    return J.overlap_join(left, right, 10 * 24 * HOUR)


_ATTR = """, shared as (select g.video, g.pos, s.seq, g.start_ms, g.end_ms, g.text, least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms) as overlap_ms, s.start_ms <= g.start_ms and g.end_ms <= s.end_ms as inside
  from ev_seg g join ev_shots s on s.video = g.video and s.start_ms < g.end_ms and g.start_ms < s.end_ms and g.end_ms > g.start_ms),
attr as (select * from shared where inside or overlap_ms >= 0.5 * (end_ms - start_ms))"""


def attributed(spark, sf):
    seg = ev_seg(spark, sf).select("video", "pos", "text", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    return J.attribute(seg, ev_shots(spark, sf).select("video", "seq", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2")), BUCKET)


@query("overlap_attribution", sql("ev_seg ev_shots", _ATTR + " select video, pos, seq, overlap_ms from attr"))
def overlap_attribution(spark, sf):
    return attributed(spark, sf).select("video", "pos", "seq", "overlap_ms")


_DOMINANT = _RUNS + """, best as (select s.video, s.seq, run from ev_shots s join runs r on s.video = r.video and s.start_ms < r.end_ms and r.start_ms < s.end_ms
  qualify row_number() over (partition by s.video, s.seq order by least(s.end_ms, r.end_ms) - greatest(s.start_ms, r.start_ms) desc, run) = 1),
ended as (select s.video, s.seq, max(run) as run from ev_shots s join runs r on s.video = r.video and r.end_ms <= s.start_ms group by all),
dom as (select s.video, s.seq, s.start_ms, s.end_ms, coalesce(b.run, e.run, case when exists (select 1 from runs r where r.video = s.video) then 0 end, -1) as run
  from ev_shots s left join best b on b.video = s.video and b.seq = s.seq left join ended e on e.video = s.video and e.seq = s.seq)"""


def dominant(spark, sf):
    runs = I.speech_runs(ev_seg(spark, sf), GAP).select("video", "run", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    return J.dominant_overlap(ev_shots(spark, sf).select("video", "seq", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1")), runs, BUCKET)


@query("dominant_overlap", sql("ev_seg ev_shots", _DOMINANT + " select video, seq, run from dom"))
def dominant_overlap(spark, sf):
    return dominant(spark, sf).select("video", "seq", "run")


_AROUND = """, b as (select video, seq, end_ms as b_ms from ev_shots),
around as (select b.video, b.seq, b_ms, max(g.end_ms) filter (where g.end_ms <= b_ms) as prev_end, min(g.start_ms) filter (where g.start_ms >= b_ms) as next_start, coalesce(bool_or(g.start_ms < b_ms and g.end_ms > b_ms), false) as spans
  from b left join ev_seg g on g.video = b.video group by all),
gaps as (select *, case when spans then 0 when prev_end is not null and next_start is not null then greatest(next_start - prev_end, 0) end as gap_ms from around)"""


def around(spark, sf, segment_rows=None):
    return J.speech_around(ev_shots(spark, sf).select("video", "seq", F.col("end_ms").alias("b_ms")), ev_seg(spark, sf), segment_rows=segment_rows)


@query("asof_prev_next", sql("ev_shots ev_seg", _AROUND + " select * from gaps"))
def asof_prev_next(spark, sf):
    return around(spark, sf)


@query("pts_bracket", sql("ev_shots", """, c0 as (select video, start_ms, end_ms as cut_ms, lead(end_ms) over (partition by video order by seq) as right_ms from ev_shots),
c as (select video, start_ms, cut_ms, right_ms as end_ms from c0 where right_ms is not null),
x as (select c.video, c.start_ms, cut_ms, c.end_ms, max(time_ms) filter (where time_ms < cut_ms) as l, min(time_ms) filter (where time_ms >= cut_ms) as r from c left join ev_points p on p.video = c.video and kind = 'click' group by all)
select video, cut_ms, case when l >= start_ms then l else cut_ms - 1 end as left_pts, case when r < end_ms then r else cut_ms end as right_pts from x"""))
def pts_bracket(spark, sf):
    w = W.partitionBy("video").orderBy("seq")
    cuts = ev_shots(spark, sf).select("video", "start_ms", F.col("end_ms").alias("cut_ms"), F.lead("end_ms").over(w).alias("end_ms")).where("end_ms is not null")
    frames = ev_points(spark, sf, "click").select("video", F.col("time_ms").alias("pts_ms"))
    return J.pts_bracket(cuts, frames).select("video", "cut_ms", "left_pts", "right_pts")


@query("band_best_match", sql("ev_shots", ", " + AUDIO + " select video, cut_ms, audio_ms, offset_ms, classification, confidence from assoc"))
def band_best_match(spark, sf):
    return associations(spark, sf).select("video", "cut_ms", "audio_ms", "offset_ms", "classification", "confidence")


@query("band_exists", sql("ev_shots", """, cuts as (select video, start_ms as cut_ms from ev_shots where seq > 1), audio as (select video, time_ms as audio_ms from ev_points where kind = 'purchase')
select c.video, cut_ms, case when exists (select 1 from audio a where a.video = c.video) then exists (select 1 from audio a where a.video = c.video and abs(audio_ms - cut_ms) <= 3600000) end as aligned from cuts c"""))
def band_exists(spark, sf):
    cuts = ev_shots(spark, sf).where("seq > 1").select("video", F.col("start_ms").alias("cut_ms"))
    return J.band_exists(cuts, ev_points(spark, sf, "purchase").select("video", F.col("time_ms").alias("audio_ms")), HOUR)


@query("nearby_text_topk", sql("ev_shots ev_seg", f""", b as (select distinct video, end_ms as b_ms from ev_shots),
x as (select b.video, b_ms, g.start_ms, g.end_ms, g.pos, g.text from b join ev_seg g on g.video = b.video and g.start_ms < b_ms + {4 * HOUR} and b_ms - {4 * HOUR} < g.end_ms and g.end_ms > g.start_ms
  qualify row_number() over (partition by b.video, b_ms order by g.start_ms, g.end_ms, g.pos) <= 4)
select video, b_ms, string_agg(text, ' ' order by start_ms, end_ms, pos) as texts from x group by video, b_ms"""))
def nearby_text_topk(spark, sf):
    return J.nearby_texts(ev_shots(spark, sf).select("video", F.col("end_ms").alias("b_ms")), ev_seg(spark, sf), 4 * HOUR, BUCKET)


def matches(spark, sf):
    golden = ev_points(spark, sf, "signup").select("video", F.col("time_ms").alias("t"))
    return golden, ev_points(spark, sf, "purchase", "click").select("video", F.col("time_ms").alias("t")), 2 * HOUR


def match_sql(tolerance: str) -> str:
    """Greedy matching as a recursion over the golden times of a video: the list of free detections goes along. ``tolerance`` may use the video."""
    return f"""with recursive ev_points as ({SQL["ev_points"]}), gold as (select video, time_ms as t, row_number() over (partition by video order by time_ms) as k from ev_points where kind = 'signup'),
det as (select video, list(time_ms order by time_ms) as free, count(*) as n from ev_points where kind in ('purchase', 'click') group by video),
rec as (select g.video, 0::bigint as k, 0::bigint as t, null::bigint as found, coalesce(free, []::bigint[]) as free from (select distinct video from gold) g left join det using (video) union all
  select g.video, g.k, g.t, w.near, case when w.near is null then rec.free else list_concat(rec.free[:list_position(rec.free, w.near) - 1], rec.free[list_position(rec.free, w.near) + 1:]) end
  from rec join gold g on g.video = rec.video and g.k = rec.k + 1,
  lateral (select list_sort(list_transform(list_filter(rec.free, lambda x: abs(x - g.t) <= {tolerance}), lambda x: {{'d': abs(x - g.t), 'x': x}}))[1].x as near) w),
matched as (select video, t as golden_t, found as found_t from rec where found is not null)"""


@query("greedy_tolerance_match", match_sql("7200000") + " select * from matched")
def greedy_tolerance_match(spark, sf):
    """Sequential by definition; also compared with a plain loop in the tests."""
    golden, found, tolerance = matches(spark, sf)
    return J.greedy_match(golden, found, tolerance).select("video", "golden_t", "found_t")


@query("entity_lookup_join", "select o_orderkey, coalesce(c_mktsegment, 'unknown') as segment from orders left join (select * from customer where c_custkey % 7 <> 0) on o_custkey = c_custkey")
def entity_lookup_join(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("shot_story_context", """
select c_custkey as shot_id, string_agg(n_name, '、' order by n_name) as blocks, string_agg(distinct r_name, '、' order by r_name) as slots
from customer join nation n on n_nationkey = c_nationkey or n_nationkey = (c_nationkey + 7) % 25 join region on r_regionkey = n_regionkey group by c_custkey""")
def shot_story_context(spark, sf):
    """A shot is in two blocks; a block is in one slot."""
    shots = table(spark, sf, "customer").select(F.col("c_custkey").alias("shot_id"), F.explode(F.array_distinct(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 7) % 25))).alias("n_nationkey"))
    rows = shots.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("shot_id").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "、").alias("blocks"), F.array_join(F.array_sort(F.collect_set("r_name")), "、").alias("slots"))


@query("first_overlap_shot", sql("ev_shots ev_seg", """
 select g.pos, min(s.seq) as seq from ev_seg g left join ev_shots s on s.video = g.video and s.start_ms < g.end_ms and g.start_ms < s.end_ms and g.end_ms > g.start_ms group by g.pos"""))
def first_overlap_shot(spark, sf):
    seg = ev_seg(spark, sf)
    left = seg.select("video", "pos", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    right = ev_shots(spark, sf).select("video", "seq", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    first = J.overlap_join(left, right, BUCKET).groupBy("pos").agg(F.min("seq").alias("seq"))
    return seg.select("pos").join(first, "pos", "left")


@query("adjacent_pairs", sql("conv", """ select video, seq || '--' || lead(seq) over w as pair_id, state as left_state, lead(state) over w as right_state from conv window w as (partition by video order by seq) qualify pair_id is not null"""))
def adjacent_pairs(spark, sf):
    rows = J.adjacent_pairs(conv(spark, sf), "seq", ["seq", "state"])
    return rows.select("video", F.concat_ws("--", "left_seq", "right_seq").alias("pair_id"), "left_state", "right_state")


@query("group_merge_all", """select l_orderkey, sum(l_quantity) filter (where l_returnflag = 'A') as a_q, sum(l_quantity) filter (where l_returnflag = 'N') as n_q, sum(l_quantity) filter (where l_returnflag = 'R') as r_q
from lineitem group by l_orderkey having count(distinct l_returnflag) filter (where l_returnflag in ('A', 'N', 'R')) = 3""")
def group_merge_all(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    out = J.merge_parts(rows.withColumn("m", F.create_map("l_returnflag", "q")), "l_returnflag", list("ANR"), "m", ["l_orderkey"])
    return out.select("l_orderkey", *[F.col("m")[k].alias(f"{k.lower()}_q") for k in "ANR"])


@query("whitelist_merge", """
select o_orderkey, o_totalprice, case when o_orderkey % 3 = 0 then lower(o_orderpriority) else o_orderpriority end as o_orderpriority, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders""")
def whitelist_merge(spark, sf):
    """The model may fill priority and status, not the price; a null of the model leaves the scaffold's value."""
    scaffold = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    model = scaffold.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice"), F.lower("o_orderpriority").alias("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"))
    return J.whitelist_merge(scaffold, model, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])


@query("boundary_sides", sql("ev_shots", ", " + AUDIO + """, t as (select *, lead(seq) over (partition by video order by seq) is null as last from ev_shots),
x as (select video, seq, 'in' as side, start_ms as visual_ms, case when seq = 1 then 'sourceStart' end as fixed from t union all select video, seq, 'out', end_ms, case when last then 'sourceEnd' end from t)
select x.video, seq, side, visual_ms, coalesce(fixed, case when x.video % 5 <> 0 then classification else 'unavailable' end) as classification from x left join assoc a on a.video = x.video and a.cut_ms = visual_ms"""))
def boundary_sides(spark, sf):
    cuts = associations(spark, sf).select("video", "cut_ms", "classification")
    return J.boundary_sides(ev_shots(spark, sf), cuts, F.col("video") % 5 != 0)


@query("sequence_index", sql("ev_points", " select id, row_number() over w as seq, 'SH' || lpad((row_number() over w)::varchar, 4, '0') as shot_id from ev_points window w as (partition by video order by time_ms, id)"))
def sequence_index(spark, sf):
    n = F.row_number().over(W.partitionBy("video").orderBy("time_ms", "id"))
    return ev_points(spark, sf).select("id", n.alias("seq"), F.format_string("SH%04d", n).alias("shot_id"))


@query("neighbour_access", sql("ev_series", " select video, i, round(value - lag(value) over w, 6) as step, lead(kind) over w as next_kind from ev_series window w as (partition by video order by i)"))
def neighbour_access(spark, sf):
    w = W.partitionBy("video").orderBy("i")
    return ev_series(spark, sf).select("video", "i", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"), F.lead("kind").over(w).alias("next_kind"))


@query("centered_rows_frame", sql("ev_series", " select video, i, round(avg(value) over w, 6) as mean, round(median(value) over w, 6) as middle from ev_series window w as (partition by video order by i rows between 3 preceding and 3 following)"))
def centered_rows_frame(spark, sf):
    w = W.partitionBy("video").orderBy("i").rowsBetween(-3, 3)
    return ev_series(spark, sf).select("video", "i", F.round(F.avg("value").over(w), 6).alias("mean"), F.round(F.expr("percentile(value, 0.5)").over(w), 6).alias("middle"))


@query("running_extent", sql("spans", """ select video, start_ms, end_ms, order_key, line, max(end_ms) over w as far_ms, sum(end_ms - start_ms) over w as total_ms from spans window w as (partition by video order by start_ms, end_ms, order_key, line, quantity rows unbounded preceding)"""))
def running_extent(spark, sf, segment_rows=None):
    folds = {"far_ms": ("max", "end_ms"), "total_ms": ("sum", F.col("end_ms") - F.col("start_ms"))}
    return running(spans(spark, sf), ("start_ms", "end_ms", "order_key", "line", "quantity"), folds, segment_rows=segment_rows).drop("quantity")


@query("forward_fill", sql("doc_lines", """ select video, pos::int as pos, last_value(case when length(line) < 40 then line end ignore nulls) over (partition by video order by pos) as header from doc_lines"""))
def forward_fill(spark, sf, segment_rows=None):
    from .bindings import doc_lines

    return running(doc_lines(spark, sf), ("pos",), {"header": ("last", F.when(F.length("line") < 40, F.col("line")))}, segment_rows=segment_rows).drop("line")


@query("topn_per_group", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 4")
def topn_per_group(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 4").select("o_custkey", "o_orderkey")


@query("stable_sorts", sql("ev_points", """ select video, string_agg(id::varchar, ',' order by case when kind = 'view' then null else time_ms end nulls last, id) as ids from ev_points group by video"""))
def stable_sorts(spark, sf):
    """Rows without a start come last, in input order."""
    start = F.when(F.col("kind") != "view", F.col("time_ms"))
    rows = ev_points(spark, sf).groupBy("video").agg(F.array_sort(F.collect_list(F.struct(start.isNull().alias("none"), start.alias("t"), "id"))).alias("r"))
    return rows.select("video", F.array_join(F.transform("r", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("coverage_difference", """
with l as (select distinct l_partkey from lineitem where l_quantity > 45), p as (select p_partkey from part where p_size < 40)
select p_partkey as id, 'missing' as kind from p where p_partkey not in (select l_partkey from l) union all select l_partkey, 'foreign' from l where l_partkey not in (select p_partkey from p)""")
def coverage_difference(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).distinct()
    known = table(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"))
    return known.join(seen, "id", "left_anti").withColumn("kind", F.lit("missing")).unionByName(seen.join(known, "id", "left_anti").withColumn("kind", F.lit("foreign")))


@query("multiset_equality", """
with a as (select l_orderkey as k, l_linenumber % 3 as id, count(*) as n from lineitem group by all), b as (select l_orderkey as k, (l_linenumber + l_orderkey) % 3 as id, count(*) as n from lineitem group by all)
select coalesce(a.k, b.k) as k, bool_and(a.n is not distinct from b.n) as equal from a full join b on a.k = b.k and a.id = b.id group by all""")
def multiset_equality(spark, sf):
    rows = table(spark, sf, "lineitem")
    count = lambda e, n: rows.groupBy(F.col("l_orderkey").alias("k"), F.expr(e).alias("id")).agg(F.count("*").alias(n))
    both = count("l_linenumber % 3", "n").join(count("(l_linenumber + l_orderkey) % 3", "m"), ["k", "id"], "full")
    return both.groupBy("k").agg(F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("equal"))


@query("ordered_dedupe", """
with t as (select doc_id, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) as i from documents), f as (select doc_id, w, min(i) as i from t group by all)
select doc_id, sha256(string_agg(w, ' ' order by i)) as words, count(*) as n from f group by doc_id""")
def ordered_dedupe(spark, sf):
    words = F.array_distinct(F.split("text", " ", -1))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2(F.array_join(words, " "), 256).alias("words"), F.size(words).cast("long").alias("n"))


@query("union_events", """
select o_orderkey as k, 'order' as kind, (epoch_us(o_orderdate) // 1000) as t_ms, null::double as quantity from orders union all select l_orderkey, 'ship', epoch_us(l_shipdate) // 1000, l_quantity from lineitem""")
def union_events(spark, sf):
    from .bindings import ms

    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind"), ms("o_orderdate").alias("t_ms"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("ship").alias("kind"), ms("l_shipdate").alias("t_ms"), F.col("l_quantity").alias("quantity"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_alignment", """
with s as (select distinct c_nationkey as v, c_mktsegment as id from customer where c_acctbal > 9000), p as (select distinct c_nationkey as v, c_mktsegment as id from customer where c_acctbal < -900)
select coalesce(s.v, p.v) as v, bool_and(s.id is not null and p.id is not null) as aligned from s full join p on s.v = p.v and s.id = p.id group by all""")
def set_alignment(spark, sf):
    c = table(spark, sf, "customer")
    part = lambda cond, mark: c.where(cond).select(F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("id")).distinct().withColumn(mark, F.lit(True))
    both = part("c_acctbal > 9000", "a").join(part("c_acctbal < -900", "b"), ["v", "id"], "full")
    return both.groupBy("v").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("aligned"))


#: Videos of more rows than this are cut into segments in the queries below, few enough that most of the tables' videos are.
SEGMENT_ROWS = 16
query("running_extent_segmented", QUERIES["running_extent"][1])(lambda spark, sf: running_extent(spark, sf, SEGMENT_ROWS))
query("forward_fill_segmented", QUERIES["forward_fill"][1])(lambda spark, sf: forward_fill(spark, sf, SEGMENT_ROWS))
query("asof_prev_next_segmented", QUERIES["asof_prev_next"][1])(lambda spark, sf: around(spark, sf, SEGMENT_ROWS))
query("merge_intervals_segmented", QUERIES["merge_intervals"][1])(lambda spark, sf: I.merge_intervals(spans(spark, sf).select("video", "start_ms", "end_ms"), segment_rows=SEGMENT_ROWS))
query("interval_union_length_segmented", QUERIES["interval_union_length"][1])(lambda spark, sf: I.union_length(spans(spark, sf), segment_rows=SEGMENT_ROWS))
query("speech_runs_segmented", QUERIES["speech_runs"][1])(lambda spark, sf: I.speech_runs(ev_seg(spark, sf), GAP, segment_rows=SEGMENT_ROWS))
