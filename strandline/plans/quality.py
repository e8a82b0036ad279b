"""Queries of integrity rules: the tables have no violations of their own, so each query injects some by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import quality as Q
from ..operators.rules import judge
from .bindings import ev_ranges, ev_series, ev_shots, sql, table
from .registry import QUERIES, query

FACTS = {}


def facts_query(name: str, text: str):
    """Registers a group of facts as a query of its issues, and for the gate."""

    def add(group):
        FACTS[name] = group
        query(name, text)(lambda spark, sf: judge(group(spark, sf)))
        return group

    return add


_I = "select '{sev}' as severity, '{art}' as artifact, ({path})::varchar as path, '{msg}' as message, ({exp})::varchar as expected, ({act})::varchar as actual from {src}"


def _issue(art: str, path: str, msg: str, src: str, exp: str = "null", act: str = "null", sev: str = "error") -> str:
    return _I.format(sev=sev, art=art, path=path, msg=msg, exp=exp, act=act, src=src)


def _union(*parts: str) -> str:
    return " union all ".join(parts)


@facts_query("schema_rules", "with o as (select o_orderkey, case when o_orderkey % 17 = 0 then null else o_orderpriority end as priority, case when o_orderkey % 19 = 0 then 'X' else o_orderstatus end as status, o_orderkey % 101 as score from orders) " + _union(
    _issue("orders", "o_orderkey", "priority: required", "o where priority is null"), _issue("orders", "o_orderkey", "priority: pattern", "o where not regexp_matches(priority, '^[1-4]-')", act="priority"),
    _issue("orders", "o_orderkey", "status: enum", "o where status not in ('F', 'O', 'P')", act="status"), _issue("orders", "o_orderkey", "score: minimum", "o where score < 2", act="score"), _issue("orders", "o_orderkey", "score: maximum", "o where score > 98", act="score")))
def schema_rules(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 17 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 19 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), (k % 101).alias("score"))
    rules = {"priority": {"required": True, "pattern": "^[1-4]-"}, "status": {"enum": ["F", "O", "P"]}, "score": {"least": 2, "most": 98}}
    return Q.schema_facts(rows, "orders", k, rules)


@facts_query("revision_consistency", "with l as (select l_orderkey, l_linenumber, l_orderkey % 1000 as rev, case when l_suppkey % 23 = 0 then null when l_suppkey % 29 = 0 then -1 else l_orderkey % 1000 end as own from lineitem) " + _issue("lineitem", "l_orderkey || '/' || l_linenumber", "revision", "l where own <> rev", "rev", "own"))
def revision_consistency(spark, sf):
    """A null revision is allowed."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 1000).alias("rev"))
    own = F.when(F.col("l_suppkey") % 23 != 0, F.when(F.col("l_suppkey") % 29 == 0, -1).otherwise(F.col("l_orderkey") % 1000))
    rows = table(spark, sf, "lineitem").withColumn("own", own).join(o, "l_orderkey").where("own is not null")
    return Q.equal_facts(rows, "lineitem", F.concat_ws("/", "l_orderkey", "l_linenumber"), "revision", F.col("rev"), F.col("own"))


@facts_query("audio_cut_rules", "with a as (select event_id, user_id, floor(value)::bigint * 10 - 500 as offset_ms, floor(value)::bigint * 10 - 500 + (case when event_id % 37 = 0 then 1 else 0 end) as declared, case when event_id % 43 = 0 then -1 else user_id end as ref from events) " + _union(
    _issue("audio_cuts", "event_id", "offset", "a where declared <> offset_ms", "offset_ms", "declared"), _issue("audio_cuts", "event_id", "beyond tolerance", "a where abs(offset_ms) > 900", "900", "offset_ms"),
    _issue("audio_cuts", "event_id", "unknown ref", "a where ref not in (select user_id from events)", act="ref")))
def audio_cut_rules(spark, sf):
    i = F.col("event_id")
    off = F.floor("value") * 10 - 500
    e = table(spark, sf, "events")
    a = e.select("event_id", off.alias("offset_ms"), (off + F.when(i % 37 == 0, 1).otherwise(0)).alias("declared"), F.when(i % 43 == 0, -1).otherwise(F.col("user_id")).alias("ref"))
    return Q.audio_cut_facts(a.withColumnRenamed("event_id", "id"), e.select(F.col("user_id").alias("ref")), 900)


@facts_query("music_rules", """with d as (select user_id as video, event_type as state, count(*) + (case when user_id % 13 = 0 and event_type = 'view' then 1 else 0 end) as n from events group by user_id, event_type), f as (select user_id as video, event_type as state, count(*) as n from events group by all),
r as (select event_id, value / 100 as ratio from events) """ + _union(_issue("music", "coalesce(d.video, f.video) || '/' || coalesce(d.state, f.state)", "tally", "d full join f on d.video = f.video and d.state = f.state where coalesce(d.n, 0) <> coalesce(f.n, 0)", "coalesce(f.n, 0)", "coalesce(d.n, 0)"),
    _issue("music", "event_id", "ratio outside", "r where ratio < 0 or ratio > 1")))
def music_rules(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("state"), "event_id", (F.col("value") / 100).alias("ratio"))
    f = e.groupBy("video", "state").agg(F.count("*").alias("n"))
    d = f.withColumn("n", F.col("n") + F.when((F.col("video") % 13 == 0) & (F.col("state") == "view"), 1).otherwise(0))
    return Q.music_facts(e.withColumnRenamed("event_id", "id"), d)



_P = "video || '/' || "
_SHOTS = """, s as (select video, case when seq % 31 = 0 then seq + 1000 else seq end as seq, start_ms, case when seq % 7 = 0 then end_ms - 5 when seq % 11 = 0 then end_ms + 5 else end_ms end as end_ms, end_ms - start_ms as duration_ms,
  case when seq > 1 then 'cut' when video % 10 = 3 then 'fade' else 'sourceStart' end as tin, case when lead(seq) over (partition by video order by seq) is not null then 'cut' when video % 10 = 4 then 'fade' else 'sourceEnd' end as tout from ev_shots),
n as (select *, lead(start_ms) over w as nxt, row_number() over w as k, case when video % 2 = 0 then 'warning' else 'error' end as sev from s window w as (partition by video order by seq)),
e as (select video, min(start_ms) as a, max(end_ms) as b, count(*) - 1 as n, arg_min(tin, seq) as tin, arg_max(tout, seq) as tout from s group by video) """


@facts_query("shots_internal", sql("ev_shots ev_ranges", _SHOTS + _union(
    _issue("shots", _P + "seq", "sequence", "n where k <> seq", "k", "seq"), _issue("shots", _P + "seq", "end before start", "n where end_ms <= start_ms", "start_ms", "end_ms"),
    _issue("shots", _P + "seq", "duration", "n where end_ms - start_ms <> duration_ms", "end_ms - start_ms", "duration_ms"), _issue("shots", _P + "seq", "overlap", "n where nxt < end_ms", "end_ms", "nxt"),
    _issue("shots", _P + "seq", "not adjacent", "n where nxt > end_ms", "end_ms", "nxt", "' || sev || '"), _issue("shots", "video", "range start not covered", "e join ev_ranges using (video) where a <> range_start", "range_start", "a"),
    _issue("shots", "video", "range end not covered", "e join ev_ranges using (video) where b <> range_end", "range_end", "b"), _issue("shots", "video", "first boundary", "e where tin <> 'sourceStart'", "'sourceStart'", "tin"),
    _issue("shots", "video", "last boundary", "e where tout <> 'sourceEnd'", "'sourceEnd'", "tout"), _issue("shots", "video", "boundary count", "e where video % 6 = 0", "n", "n + 1"))))
def shots_internal(spark, sf):
    """Even videos count as partly analysed; every sixth declares one boundary too many."""
    q, v = F.col("seq"), F.col("video")
    shots = ev_shots(spark, sf)
    last = shots.groupBy("video").agg(F.max("seq").alias("last"))
    end = F.when(q % 7 == 0, F.col("end_ms") - 5).when(q % 11 == 0, F.col("end_ms") + 5).otherwise(F.col("end_ms"))
    rows = shots.join(last, "video").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).withColumn("end_ms", end)
    rows = rows.withColumn("type_in", F.when(q > 1, "cut").when(v % 10 == 3, "fade").otherwise("sourceStart")).withColumn("type_out", F.when(q < F.col("last"), "cut").when(v % 10 == 4, "fade").otherwise("sourceEnd"))
    declared = last.select("video", (F.col("last") - 1 + (v % 6 == 0).cast("int")).alias("n"))
    return Q.shot_facts(rows.withColumn("seq", F.when(q % 31 == 0, q + 1000).otherwise(q)), ev_ranges(spark, sf), v % 2 == 0, declared)


@facts_query("shot_refs_and_coverage", """with r as (select l_returnflag as artifact, l_orderkey || '/' || l_linenumber as path, case when l_partkey % 41 = 0 then -l_partkey else l_partkey end as shot from lineitem),
w as (select p_partkey as shot, unnest(['A', 'R']) as artifact from part)
select 'error' as severity, artifact, path, 'unknown shot' as message, null::varchar as expected, shot::varchar as actual from r where shot not in (select p_partkey from part)
union all select 'warning', artifact, shot::varchar, 'not covered', null, shot::varchar from w where (artifact, shot) not in (select (artifact, shot) from r)""")
def shot_refs_and_coverage(spark, sf):
    """Every line names a shot; the artifacts of returned and accepted lines say that they are complete."""
    p = F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("artifact"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.when(p % 41 == 0, -p).otherwise(p).alias("shot"))
    return Q.coverage_facts(rows, table(spark, sf, "part").select(F.col("p_partkey").alias("shot")), ["A", "R"])


_FRAMES = """, f as (select s.video, i, case when i % 47 = 0 then i + 1 else i end as id, case when i % 53 = 0 then range_end + 1 else time_ms end as t, range_start, range_end, i // 4 + 1 as shot, event_id from ev_series s join ev_ranges using (video)) """


@facts_query("frame_rules", sql("ev_series ev_shots", _FRAMES + _union(
    _issue("frames", _P + "i", "id", "f where id <> i", "i", "id"), _issue("frames", _P + "i", "time outside", "f where t < range_start or t >= range_end", "range_end", "t"),
    _issue("frames", _P + "i", "unknown shot", "f anti join ev_shots s on f.video = s.video and f.shot = s.seq", act="shot").replace("video ||", "f.video ||"), _issue("frames", _P + "i", "no such file", "f where event_id % 67 = 0", act="'f' || event_id"))))
def frame_rules(spark, sf):
    """The file of every 67th event is missing from the listing."""
    i, name = F.col("i"), F.concat(F.lit("f"), F.col("event_id")).alias("file")
    series, ranges = ev_series(spark, sf), ev_ranges(spark, sf)
    f = series.join(ranges, "video").select("video", "i", F.when(i % 47 == 0, i + 1).otherwise(i).alias("id"), F.when(i % 53 == 0, F.col("range_end") + 1).otherwise(F.col("time_ms")).alias("t"), (F.floor(i / 4) + 1).alias("shot"), name)
    return Q.frame_facts(f, ev_shots(spark, sf).withColumnRenamed("seq", "shot"), ranges, series.where("event_id % 67 <> 0").select(name))


_BATCHES = """with l as (select o_custkey as video, o_orderkey as batch, o_orderkey || '-' || l_linenumber as shot, l_suppkey % 31 <> 0 as told, l_partkey, case when o_orderkey % 5 = 0 then 'failed' else 'done' end as status, o_orderkey % 10 <> 0 as has from lineitem join orders on l_orderkey = o_orderkey),
m as (select distinct video, batch, shot from l), r as (select distinct video, batch, shot from l where told and has), st as (select video, shot, case when l_partkey % 41 = 0 then 'pending' else 'done' end as status from l where l_partkey % 37 <> 0),
b as (select distinct video, batch, status, has from l where not (status = 'failed' and not has)),
d as (select video, video % 2 = 0 as terminal, case when video % 3 = 0 then 'complete' else 'partial' end as status, count(distinct case when status = 'failed' then batch end) as failed, count(*) filter (where l_partkey % 37 <> 0 and l_partkey % 41 = 0) as pending, 0 as permanent from l group by video),
odd as (select b.video, b.batch, count(*) filter (where r.shot is null) as lost from b join m on b.video = m.video and b.batch = m.batch left join r on r.video = m.video and r.batch = m.batch and r.shot = m.shot group by all having count(*) filter (where r.shot is null) > 0),
cnt as (select video, unnest(['failed', 'pending', 'permanent']) as field, unnest([failed, pending, permanent]) as n from d where status = 'complete') """


@facts_query("model_batch_rules", _BATCHES + _union(
    _issue("batches", _P + "batch", "response differs", "odd", "lost", "0"), _issue("batches", _P + "batch || '/' || shot", "no status", "m where (video, shot) not in (select (video, shot) from st)"),
    _issue("batches", "video", "pending in a terminal document", "(select d.video, count(*) as n from d join st using (video) where terminal and st.status = 'pending' group by d.video)", "0", "n"), _issue("batches", _P + "field", "complete with failures", "cnt where n <> 0", "0", "n")))
def model_batch_rules(spark, sf):
    """Orders as batches, lines as shots."""
    p, k = F.col("l_partkey"), F.col("o_orderkey")
    l = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == k)
    l = l.select(F.col("o_custkey").alias("video"), k.alias("batch"), F.concat_ws("-", k, "l_linenumber").alias("shot"), (F.col("l_suppkey") % 31 != 0).alias("told"), p, F.when(k % 5 == 0, "failed").otherwise("done").alias("status"), (k % 10 != 0).alias("has_response"))
    statuses = l.where("l_partkey % 37 <> 0").select("video", "shot", F.when(p % 41 == 0, "pending").otherwise("done").alias("status"))
    docs = l.groupBy("video").agg(F.countDistinct(F.when(F.col("status") == "failed", F.col("batch"))).alias("failed"), F.count_if((p % 37 != 0) & (p % 41 == 0)).alias("pending"), F.lit(0).alias("permanent"))
    docs = docs.withColumn("terminal", F.col("video") % 2 == 0).withColumn("status", F.when(F.col("video") % 3 == 0, "complete").otherwise("partial"))
    return Q.batch_facts(l.select("video", "batch", "status", "has_response").distinct(), l.select("video", "batch", "shot").distinct(), l.where("told and has_response").select("video", "batch", "shot"), statuses, docs)


_STORY = """, b0 as (select video, (seq - 1) // 4 as b, list(seq order by seq) as ids, min(start_ms) as s, max(end_ms) as e from ev_shots group by all),
b1 as (select video, b, 'B' || b as block, case (video + b) % 23 when 11 then list_reverse(ids) when 13 then list_append(ids, -1) when 17 then ids[:-2] when 19 then list_append(ids, ids[len(ids)] + 1) else ids end as ids, s + (case when (video + b) % 7 = 0 then 1 else 0 end) as start_ms, e - (case when (video + b) % 9 = 0 then 1 else 0 end) as end_ms,
  'after → B' || (case when (video + b) % 5 = 0 then b else b + 1 end) as relation from b0),
m as (select video, block, unnest(ids) as shot, generate_subscripts(ids, 1) - 1 as j from b1), k as (select m.*, s.seq, s.start_ms as s, s.end_ms as e, m.j from m left join ev_shots s on s.video = m.video and s.seq = m.shot),
bk as (select *, seq < lag(seq) over (partition by video, block order by j) as back from k),
per as (select video, block, coalesce(bool_or(back), false) as back, count(*) filter (where seq is null) as unknown, arg_min(s, j) as s, arg_max(e, j) as e, min(seq) as first from bk group by all),
der as (select p.*, b1.start_ms, b1.end_ms from per p join b1 using (video, block) where unknown = 0), tg as (select video, block, regexp_extract(relation, '→ *([A-Za-z0-9]+)', 1) as target from b1),
tm as (select s.video, s.seq as shot, count(m.shot) as n from ev_shots s left join m on m.video = s.video and m.shot = s.seq group by all),
laid as (select k.video, row_number() over (partition by k.video order by per.first, k.block, k.seq) as n, k.seq from k join per using (video, block) where k.seq is not null), line as (select video, row_number() over (partition by video order by seq) as n, seq from ev_shots),
torn as (select coalesce(line.video, laid.video) as video, min(coalesce(line.n, laid.n)) as n from line full join laid on line.video = laid.video and line.n = laid.n where line.seq is distinct from laid.seq group by 1),
sl as (select video, b // 3 as slot, b % 3 as j, block from b1 where (video + b) % 29 <> 3 union all select video, 0, 9, 'B999' from b1 where b = 0 and video % 6 = 0) """


@facts_query("story_rules", sql("ev_shots", _STORY + _union(
    _issue("story", _P + "block || '/' || j", "unknown shot", "k where seq is null", act="shot"), _issue("story", _P + "block", "shots out of order", "per where unknown = 0 and back"),
    _issue("story", _P + "block", "start", "der where start_ms <> s", "s", "start_ms"), _issue("story", _P + "block", "end", "der where end_ms <> e", "e", "end_ms"),
    _issue("story", _P + "block", "unknown target", "tg where (video, target) not in (select (video, block) from b1)", act="target"), _issue("story", _P + "block", "relation to itself", "tg where target = block"),
    _issue("story", _P + "shot", "in no block", "tm where n = 0"), _issue("story", _P + "shot", "in several blocks", "tm where n > 1", "1", "n"), _issue("story", "video", "blocks do not cover the sequence", "torn", act="n"),
    _issue("story", _P + "slot || '/' || j", "unknown block", "sl where (video, block) not in (select (video, block) from b1)", act="block"), _issue("story", _P + "block", "in no slot", "b1 where video % 2 = 0 and (video, block) not in (select (video, block) from sl)"))))
def story_rules(spark, sf):
    """Blocks of four shots, with members, times, relations and slots that are wrong here and there; stories of even videos are complete."""
    shots = ev_shots(spark, sf).withColumn("shot", F.col("seq").cast("long"))
    b = F.floor((F.col("seq") - 1) / 4)
    v, n, ids = F.col("video"), F.col("b"), F.col("ids")
    x = shots.groupBy("video", b.alias("b")).agg(F.sort_array(F.collect_list("shot")).alias("ids"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    at = (v + n) % 23
    ids = F.when(at == 11, F.reverse(ids)).when(at == 13, F.array_append(ids, F.lit(-1).cast("long"))).when(at == 17, F.slice(ids, F.lit(1), F.size(ids) - 1)).when(at == 19, F.array_append(ids, F.element_at(ids, -1) + 1)).otherwise(ids)
    blocks = x.select(
        "video", "b", F.concat(F.lit("B"), n).alias("block"), ids.alias("ids"), (F.col("s") + ((v + n) % 7 == 0).cast("int")).alias("start_ms"), (F.col("e") - ((v + n) % 9 == 0).cast("int")).alias("end_ms"),
        F.concat(F.lit("after → B"), F.when((v + n) % 5 == 0, n).otherwise(n + 1)).alias("relation"))
    members = blocks.select("video", "block", F.posexplode("ids").alias("j", "shot"))
    slots = blocks.where("(video + b) % 29 <> 3").select("video", F.floor(n / 3).alias("slot"), (n % 3).alias("j"), "block")
    slots = slots.unionByName(blocks.where("b = 0 and video % 6 = 0").select("video", F.lit(0).cast("long").alias("slot"), F.lit(9).cast("long").alias("j"), F.lit("B999").alias("block")))
    docs = shots.select("video").distinct().withColumn("status", F.when(v % 2 == 0, "complete").otherwise("partial"))
    return Q.story_facts(blocks, members, shots, slots, docs)


_PROFILE = """with c as (select n_regionkey as video, n_nationkey as slot, n_nationkey * 4 + c_custkey % 4 as block, c_custkey as shot, c_custkey % 97 * 1000 + 500 as d from customer join nation on n_nationkey = c_nationkey),
bl as (select distinct video, slot, block from c), sb as (select video, block, shot from c), told as (select distinct video, slot from c), tot as (select video, sum(d) as t from c group by video),
g as (select video, slot, count(*) as n, avg(d) / 1000 as a, sum(d) as d from c group by all),
ps as (select video, slot, d / t + (case when slot = 7 then 0.5 else 0 end) as share, n + (case when slot = 3 then 1 else 0 end) + (case when slot % 8 = 1 then 1 else 0 end) as cnt, a + (case when slot = 4 then 1 else 0 end) as avg_sec from g join tot using (video) where slot % 12 <> 5 union all select 2, -1, 0.0, 0, 0.0),
ss as (select video, slot, shot from c union all select video, slot, -slot from told where slot % 8 = 1), per as (select ps.*, (select count(*) from ss where ss.video = ps.video and ss.slot = ps.slot) as n, (select avg(d) / 1000 from c where c.video = ps.video and c.slot = ps.slot) as a from ps),
ro as (select video, unnest(['hook', 'payoff']) as role, unnest([case when video = 1 then 99 else lo end, hi]) as slot, unnest([case when video = 3 then hi * 4 else lo * 4 end, case when video = 4 then 5000 else hi * 4 + 1 end]) as block from (select video, min(slot) as lo, max(slot) as hi from told group by video)),
rs as (select video, 'hook' as role, min(shot) as shot from c group by video union all select video, 'payoff', -5 from told where video = 0 group by video),
rq as (select video, slot as pos, slot from told union all select 0, 77, 77), ch as (select video, slot as pos, slot as from_slot, slot + 5 as to_slot, slot * 4 + (case when slot % 6 = 0 then 1000 else 0 end) as block from told),
en as (select video, pos, unnest(['from', 'to']) as "end", unnest([from_slot, to_slot]) as slot from ch) """
_IN = "(video, {0}) not in (select (video, {0}) from {1})"


@facts_query("profile_rules", _PROFILE + _union(
    _issue("profile", _P + "slot", "slot is missing", "told where " + _IN.format("slot", "ps")), _issue("profile", _P + "slot", "slot is foreign", "ps where " + _IN.format("slot", "told")), _issue("profile", _P + "slot", "share outside", "ps where share < 0 or share > 1"),
    _issue("profile", "video", "shares do not sum to 1", "(select video, sum(share) as s from ps group by video) where abs(s - 1) > 0.000001"), _issue("profile", _P + "slot", "unknown shot", "ss where " + _IN.format("shot", "sb"), act="shot"),
    _issue("profile", _P + "slot", "shot count", "per where n <> cnt", "n", "cnt"), _issue("profile", _P + "slot", "average", "per where abs(a - avg_sec) > 0.01"),
    _issue("profile", _P + "role", "role of unknown slot", "ro where " + _IN.format("slot", "told"), act="slot"), _issue("profile", _P + "role", "role of unknown block", "ro where " + _IN.format("block", "sb"), act="block"),
    _issue("profile", _P + "role", "block outside the slot", "ro where not (" + _IN.format("slot", "told") + ") and not (" + _IN.format("block", "sb") + ") and (video, slot, block) not in (select (video, slot, block) from bl)", act="block"),
    _issue("profile", _P + "role", "role of unknown shot", "rs where " + _IN.format("shot", "sb"), act="shot"), _issue("profile", _P + "role", "shot outside the block", "rs join ro using (video, role) where (video, block, shot) not in (select (video, block, shot) from sb)", act="shot"),
    _issue("profile", _P + "pos", "requirement of unknown slot", "rq where " + _IN.format("slot", "told"), act="slot"), _issue("profile", _P + "pos || '/' || \"end\"", "chain of unknown slot", "en where " + _IN.format("slot", "told"), act="slot"),
    _issue("profile", _P + "pos", "chain of unknown block", "ch where " + _IN.format("block", "sb"), act="block")))
def profile_rules(spark, sf):
    """Regions as videos, nations as slots, quarters of a nation's customers as blocks, customers as shots."""
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("video"), F.col("n_nationkey").cast("long").alias("slot"))
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("slot")).select("video", "slot", (F.col("slot") * 4 + k % 4).alias("block"), k.cast("long").alias("shot"), (k % 97 * 1000 + 500).alias("duration_ms"))
    told, s = c.select("video", "slot").distinct(), F.col("slot")
    one = lambda cond: cond.cast("int")
    g = c.groupBy("video", "slot").agg(F.count("*").alias("n"), (F.avg("duration_ms") / 1000).alias("a"), F.sum("duration_ms").alias("d")).join(c.groupBy("video").agg(F.sum("duration_ms").alias("t")), "video")
    slots = g.where("slot % 12 <> 5").select("video", "slot", (F.col("d") / F.col("t") + one(s == 7) * 0.5).alias("share"), (F.col("n") + one(s == 3) + one(s % 8 == 1)).alias("count"), (F.col("a") + one(s == 4)).alias("avg_sec"))
    region = told.select("video").distinct()
    slots = slots.unionByName(region.where("video = 2").select("video", F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("share"), F.lit(0).cast("long").alias("count"), F.lit(0.0).alias("avg_sec")))
    slot_shots = c.select("video", "slot", "shot").unionByName(told.where("slot % 8 = 1").select("video", "slot", (-s).alias("shot")))
    ends, v, lo, hi = told.groupBy("video").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")), F.col("video"), F.col("lo"), F.col("hi")
    role = lambda name, slot, block: F.struct(F.lit(name).alias("role"), slot.alias("slot"), block.alias("block"))
    roles = ends.select("video", F.explode(F.array(role("hook", F.when(v == 1, 99).otherwise(lo), F.when(v == 3, hi * 4).otherwise(lo * 4)), role("payoff", hi, F.when(v == 4, 5000).otherwise(hi * 4 + 1)))).alias("r")).select("video", "r.*")
    role_shots = c.groupBy("video").agg(F.min("shot").alias("shot")).select("video", F.lit("hook").alias("role"), "shot").unionByName(region.where("video = 0").select("video", F.lit("payoff").alias("role"), F.lit(-5).cast("long").alias("shot")))
    requirements = told.select("video", s.alias("pos"), "slot").unionByName(region.where("video = 0").select("video", F.lit(77).cast("long").alias("pos"), F.lit(77).cast("long").alias("slot")))
    chains = told.select("video", s.alias("pos"), s.alias("from_slot"), (s + 5).alias("to_slot"), (s * 4 + one(s % 6 == 0) * 1000).alias("block"))
    return Q.profile_facts(slots, slot_shots, roles, role_shots, requirements, chains, c.select("video", "slot", "block").distinct(), c.select("video", "block", "shot"), c.select("video", "shot", "duration_ms"))


_LINE = """, f as (select s.video, i, case when i % 59 = 0 then -1 when i % 61 = 0 then time_ms - 99999999 when i % 67 = 0 then time_ms + 0.5::double else time_ms end::double as t, range_start, range_end from ev_series s join ev_ranges using (video) where s.video % 40 <> 7),
d as (select s.video, count(*) + (case when s.video % 14 = 0 then 1 else 0 end) as said, s.video % 15 as bin_ms, count(*) as n, s.video % 2 = 0 as wave from ev_series s group by s.video), c as (select video, count(*) as n from f group by video),
g as (select *, t >= 0 and t = floor(t) as good from f), h as (select *, last_value(case when good then t end ignore nulls) over (partition by video order by i rows between unbounded preceding and 1 preceding) as before from g) """


@facts_query("timeline_rules", sql("ev_series ev_ranges", _LINE + _union(
    _issue("timeline", "video", "no frames", "d where video % 40 = 7"), _issue("timeline", _P + "i", "no whole time", "h where not good", act="floor(t)::bigint"), _issue("timeline", _P + "i", "not monotone", "h where good and t < before", "before::bigint", "t::bigint"),
    _issue("timeline", _P + "i", "outside", "h where good and (t < range_start or t >= range_end)", act="t::bigint"), _issue("timeline", "d.video", "frame count", "d join c using (video) where said <> c.n", "c.n", "said"),
    _issue("timeline", "video", "bin count", "d where wave and said <> n", "n", "said"), _issue("timeline", "video", "bin length", "d where wave and bin_ms < 1", "1", "bin_ms"),
    _issue("timeline", _P + "i", "bin upside down", "(select video, min(i) as i from ev_series where video % 2 = 0 and event_id % 71 = 0 group by video)"))))
def timeline_rules(spark, sf):
    """Every 40th video has no frames; waveforms of even videos are complete."""
    i, v = F.col("i"), F.col("video")
    series, ranges = ev_series(spark, sf), ev_ranges(spark, sf)
    t = F.when(i % 59 == 0, -1).when(i % 61 == 0, F.col("time_ms") - 99_999_999).when(i % 67 == 0, F.col("time_ms") + 0.5).otherwise(F.col("time_ms"))
    points = series.where("video % 40 <> 7").select("video", "i", t.cast("double").alias("t"))
    peaks = series.select("video", "i", (F.col("value") - 50).alias("lo"), F.when(F.col("event_id") % 71 == 0, F.col("value") - 51).otherwise(F.col("value")).alias("hi"))
    said = series.groupBy("video").agg((F.count("*") + (F.max(v) % 14 == 0).cast("int")).alias("said"))
    docs = said.join(ranges, "video").select("video", F.lit("pts-index").alias("mode"), F.col("said").alias("frame_count"), "range_start", "range_end", F.when(v % 2 == 0, "complete").otherwise("none").alias("wave_status"), F.col("said").alias("bin_count"), (v % 15).alias("bin_ms"))
    return Q.timeline_facts(docs, points, peaks)


_RELATIONS = """, x as (select video, seq as l, end_ms, lead(seq) over (partition by video order by seq) as r from ev_shots), e as (select video, l, l || '--' || r as pair, end_ms, row_number() over (partition by video order by l) as k from x where r is not null),
a as (select video, l, pair, end_ms + (case when l % 29 = 0 then 1 else 0 end) as boundary, end_ms, row_number() over (partition by video order by l) as k from e where (video + l) % 37 <> 0),
o as (select coalesce(e.video, a.video) as video, min(coalesce(e.k, a.k)) as k from e full join a on e.video = a.video and e.k = a.k where e.pair is distinct from a.pair group by 1), o2 as (select o.video, e.pair as wanted, a.pair from o left join e using (video, k) left join a using (video, k)),
n as (select video, l, pair, unnest([""" + ", ".join(f"'{m}'" for m in Q.METRICS) + """]) as name, unnest(range(0, 7)) as z from a) """


@facts_query("relation_rules", sql("ev_shots", _RELATIONS + _union(
    _issue("relations", "video", "pairs are not the adjacent shots", "o2", "wanted", "pair"), _issue("relations", _P + "pair", "boundary", "a where boundary <> end_ms", "end_ms", "boundary"),
    _issue("relations", _P + "pair || '/' || name", "metric is missing", "n where (l + z) % 31 = 0"), _issue("relations", _P + "pair || '/' || name", "value without references", "n where (l + z) % 31 <> 0 and l % 22 = 0"))))
def relation_rules(spark, sf):
    from ..operators.joins import adjacent_pairs

    shots = ev_shots(spark, sf).withColumn("shot", F.col("seq").cast("string"))
    l = F.col("left_seq")
    pairs = adjacent_pairs(shots, "seq", ["seq", "end_ms"]).where((F.col("video") + l) % 37 != 0)
    pairs = pairs.select("video", l.alias("pos"), F.concat_ws("--", "left_seq", "right_seq").alias("pair"), l.cast("string").alias("left"), (F.col("left_end_ms") + (l % 29 == 0).cast("int")).alias("boundary_ms"))
    metrics = pairs.select("video", "pos", "pair", F.posexplode(F.array(*map(F.lit, Q.METRICS))).alias("z", "name")).where("(pos + z) % 31 <> 0")
    metrics = metrics.select("video", "pair", "name", F.when(F.col("pos") % 2 == 0, "value").otherwise("unknown").alias("status"), F.when(F.col("pos") % 22 != 0, F.array(F.lit("raw/shots.json#shots[0]"))).otherwise(F.array().cast("array<string>")).alias("refs"))
    return Q.relation_facts(pairs, metrics, shots)


_REFS = """with d as (select doc_id, len(string_split(text, chr(10))) as n from documents), r as (select page_id, page_id % 260 as doc, page_id % 40 as pos, page_id % 23 as k, case page_id % 23 when 0 then '../' when 1 then 'x' else '' end || 'raw/' || (page_id % 260) || '.json#' || case page_id % 23 when 2 then 'lines.x' when 3 then 'name' when 4 then 'lines[' || (page_id % 40) || '].y' else 'lines[' || (page_id % 40) || ']' end as ref from pages),
p as (select r.*, n, 'deep/evidenceRefs/[0]' as path from r left join d on doc = doc_id) """
_PAGE = "'deep/evidenceRefs/[0]'"


@facts_query("evidence_ref_rules", _REFS + ", i as (" + _union(
    "select 'error' as severity, page_id, 'syntax: parent' as message, ref from p where k = 0", "select 'error', page_id, 'file does not exist', ref from p where k = 1", "select 'warning', page_id, 'artifact is missing', ref from p where k > 1 and n is null",
    "select 'error', page_id, case when k = 2 then 'pointer: wrong type' when k = 3 then 'pointer: missing key' when pos >= n then 'pointer: out of bounds' else 'pointer: wrong type' end, ref from p where k > 1 and n is not null and (k in (2, 3, 4) or pos >= n)") +
    """) select severity, page_id::varchar as artifact, 'deep/evidenceRefs/[0]' as path, message, null::varchar as expected, ref as actual from i
    union all select 'error', page_id::varchar, 'deep/evidenceRefs/[1]', 'no text', null, null from pages where page_id % 17 = 0""")
def evidence_ref_rules(spark, sf):
    """References found inside documents, against the paths of the files that exist; all page numbers up to 260 name known artifacts."""
    i = F.col("page_id")
    place = F.concat(F.lit("lines["), i % 40, F.lit("]"))
    ref = F.concat(F.when(i % 23 == 0, "../").when(i % 23 == 1, "x").otherwise(""), F.lit("raw/"), i % 260, F.lit(".json#"), F.when(i % 23 == 2, "lines.x").when(i % 23 == 3, "name").when(i % 23 == 4, F.concat(place, F.lit(".y"))).otherwise(place))
    body = F.concat(F.lit('{"deep": {"evidenceRefs": ["'), ref, F.when(i % 17 == 0, '", 7]}}').otherwise('"]}}'))
    pages = table(spark, sf, "pages").select(i.alias("artifact"), body.alias("doc"))
    name = lambda c: F.concat(F.lit("raw/"), c, F.lit(".json")).alias("file")
    files = table(spark, sf, "documents").select(name(F.col("doc_id")), F.to_json(F.struct(F.split("text", "\n", -1).alias("lines"))).alias("doc"))
    known = table(spark, sf, "pages").select(name(i % 260)).distinct()
    return Q.reference_facts(D.references(pages), known, files, D.inventory(files))


@query("issue_gate", "select artifact, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'error') = 0 as passed from ("
    + " union all ".join(f"select severity, artifact from ({QUERIES[g][1]})" for g in FACTS) + ") group by artifact")
def issue_gate(spark, sf):
    """All groups of rules, judged at once."""
    return Q.gate(judge(*(group(spark, sf) for group in FACTS.values())))
