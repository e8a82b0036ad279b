"""Queries of scans and sinks. Corpora are written from the tables to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import corpus as C
from .bindings import doc_lines, ev_points, ev_ranges, sql, table
from .registry import query

_VIDEO = r"/video_id=([^/]+)/"


def _corpus(spark, sf) -> str:
    """shots documents, one folder a video; videos divisible by 9 are corrupt, those that leave 1 are missing."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("shots"))
    doc = F.when(F.col("video_id") % 9 == 0, '{"shots": [').otherwise(F.to_json(F.struct("shots")))
    folder = C.shared_folder(spark, "corpus")
    C.write_documents(e.where("video_id % 9 <> 1").select("video_id", doc.alias("value")), ["video_id"], folder)
    return folder


_SCHEMA = "shots array<struct<event_id:bigint,event_type:string,value:double>>"


@query("corpus_artifacts", "select user_id as video_id, count(*) as n_shots, min(event_id) as first_id from events where user_id % 9 > 1 group by user_id")
def corpus_artifacts(spark, sf):
    rows = C.read_artifact(spark, _corpus(spark, sf), _SCHEMA, _VIDEO).where("_corrupt_record is null")
    return rows.select(F.col("video_id").cast("long").alias("video_id"), F.size("shots").cast("long").alias("n_shots"), F.col("shots")[0]["event_id"].alias("first_id"))


@query("tolerant_read", "select distinct user_id::varchar as video_id, case when user_id % 9 = 0 then 'error' else 'warning' end as severity, 'shots' as artifact, case when user_id % 9 = 0 then 'corrupt' else 'missing' end as message from events where user_id % 9 <= 1")
def tolerant_read(spark, sf):
    expected = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id")).distinct()
    return C.tolerant(C.read_artifact(spark, _corpus(spark, sf), _SCHEMA, _VIDEO), expected, "shots")[1]


@query("file_inventory", """with v as (select distinct user_id as u from events) select u::varchar as video_id, 'shots' as artifact, case u % 9 when 0 then 'empty' else 'missing' end as issue from v where u % 9 <= 1 union all select u::varchar, 'asr', 'unexpected' from v where u % 9 = 2""")
def file_inventory(spark, sf):
    """Files as they lie in the corpus: of videos that are multiples of 9 an empty one, of those that leave 1 none, of those that leave 2 one more."""
    v = F.col("video_id")
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.array_sort(F.collect_list("event_id")).alias("shots"))
    files = e.where("video_id % 9 <> 1").select("video_id", F.when(v % 9 == 0, "").otherwise(F.to_json(F.struct("shots"))).alias("value"), F.explode(F.when(v % 9 == 2, F.array(F.lit("shots"), F.lit("asr"))).otherwise(F.array(F.lit("shots")))).alias("artifact"))
    folder = C.shared_folder(spark, "corpus")
    C.write_documents(files, ["video_id", "artifact"], folder)
    listing = C.list_files(spark, folder, "part-*", _VIDEO, r"/artifact=([^/]+)/")
    return C.file_issues(e.select(v.cast("string").alias("video_id"), F.lit("shots").alias("artifact")), listing)


@query("explode_facts", sql("doc_lines", " select video, pos::int as pos, length(line)::int as n from doc_lines"))
def explode_facts(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("video"), F.split("text", "\n", -1).alias("lines"))
    return C.explode_facts(docs, "lines", ["video"]).select("video", "pos", F.char_length("item").alias("n"))


@query("model_shots", "select conv_id as video, role, max(turn) as last_turn, arg_max(length(text), turn)::int as last_chars, min(turn) as first_turn from conversations group by all")
def model_shots(spark, sf):
    """Later entries win where a profile is made, the first one where a field is resolved."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("video"), "role", "turn", F.char_length("text").alias("n"))
    last = C.pick_response(c, ["video", "role"], ["turn"]).select("video", "role", F.col("turn").alias("last_turn"), F.col("n").alias("last_chars"))
    return last.join(C.pick_response(c, ["video", "role"], ["turn"], first=True).select("video", "role", F.col("turn").alias("first_turn")), ["video", "role"])


@query("scan_log_samples", sql("doc_lines", """ select video, pos::int as pos, sha256(last_value(case when length(line) < 60 then line end ignore nulls) over (partition by video order by pos)) as header, regexp_extract(line, '([A-Z][a-z]+) ([a-z]+)', 1) as key, nullif(regexp_extract(line, '([A-Z][a-z]+) ([a-z]+)', 2), 'the') as sample from doc_lines"""))
def scan_log_samples(spark, sf):
    """Short lines are headers; each line gives a key and a sample, where 'the' stands for not-a-number."""
    rows = C.log_samples(doc_lines(spark, sf), F.when(F.char_length("line") < 60, F.col("line")), ["video"])
    found = lambda i: F.regexp_extract("line", "([A-Z][a-z]+) ([a-z]+)", i)
    return rows.select("video", "pos", F.sha2("header", 256).alias("header"), found(1).alias("key"), F.nullif(found(2), F.lit("the")).alias("sample"))


@query("pair_start_end_events", sql("ev_points", """, s as (select video, time_ms as start_ms, row_number() over (partition by video order by time_ms) as k from ev_points where kind = 'signup'), e as (select video, time_ms as end_ms, row_number() over (partition by video order by time_ms) as k from ev_points where kind = 'purchase')
select s.video, s.k, start_ms, end_ms from s left join e on s.video = e.video and s.k = e.k where end_ms is null or end_ms > start_ms"""))
def pair_start_end_events(spark, sf):
    side = lambda k: ev_points(spark, sf, k).select("video", F.col("time_ms").alias("t"))
    return C.pair_events(side("signup"), side("purchase"), ["video"])


@query("frame_pts_index", sql("ev_ranges", """, t as (select user_id as video, case when event_id % 10 = 0 then 'N/A' when event_id % 10 = 1 then '-1' else (epoch_us(ts) // 1000 / 1000)::varchar end as s from events)
select distinct t.video, round(try_cast(s as double) * 1000)::bigint as pts_ms from t join ev_ranges r using (video) where try_cast(s as double) >= 0 and round(try_cast(s as double) * 1000) >= range_start and round(try_cast(s as double) * 1000) < range_end"""))
def frame_pts_index(spark, sf):
    from .bindings import ms

    i = F.col("event_id")
    text = F.when(i % 10 == 0, "N/A").when(i % 10 == 1, "-1").otherwise((ms("ts") / 1000).cast("string"))
    return C.frame_index(table(spark, sf, "events").select(F.col("user_id").alias("video"), text.alias("s")), "s", ev_ranges(spark, sf), ["video"])


@query("profile_export", """
with l as (select o_custkey, o_orderpriority as p, count(*) as n from orders group by all), g as (select o_custkey, '[' || string_agg('{"p":"' || p || '","n":' || n || '}', ',' order by p) || ']' as slots, sum(n)::bigint as total from l group by o_custkey)
select o_custkey as video_id, '{"slots":' || slots || ',"total":' || total || '}' as profile from g""")
def profile_export(spark, sf):
    """One nested document a video, written as JSON lines and read again as text."""
    l = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    g = l.groupBy(F.col("o_custkey").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("slots"), F.sum("n").alias("total"))
    folder = C.shared_folder(spark, "profiles")
    g.select("video_id", F.to_json(F.struct("slots", "total")).alias("profile")).write.json(folder)
    return spark.read.schema("video_id bigint, profile string").json(folder)


@query("resolver_registry", sql("ev_ranges", " select video, 'start' as field, range_start as value from ev_ranges union all select video, 'length', range_end - range_start from ev_ranges"))
def resolver_registry(spark, sf):
    """Resolvers are functions from DataFrame to DataFrame, applied in the order they were registered."""
    from ..operators.extend import Registry

    r = Registry()
    r.add("start", lambda df: df.select("video", F.col("range_start").alias("value")))
    r.add("length", lambda df: df.select("video", (F.col("range_end") - F.col("range_start")).alias("value")))
    return r.resolve(ev_ranges(spark, sf))


@query("injectable_scorers", "select conv_id || '/' || turn as key, length(coalesce(text, ''))::double as score, 'batch' as status, 1 as attempts from conversations")
def injectable_scorers(spark, sf):
    """The scorer is a parameter; a deterministic one stands in for a service."""
    from ..operators.scoring import scored

    return scored(table(spark, sf, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn")), "key", "text", lambda texts: [float(len(t)) for t in texts])


@query("evidence_validator_hook", "select page_id, case when starts_with(url, 'https') then 'ok' else 'rejected' end as verdict from pages")
def evidence_validator_hook(spark, sf):
    from ..operators.extend import validate_refs

    return validate_refs(table(spark, sf, "pages"), F.col("url").startswith("https")).select("page_id", "verdict")


@query("media_dim", """with p as (select o_orderkey as k, case o_orderkey % 6 when 0 then null when 1 then 'N/A' when 2 then '-3' else (o_orderkey % 977 + 1)::varchar end as fd, case when o_orderkey % 12 = 2 then null else (o_orderkey % 101 + 1)::varchar end as sd from orders),
d as (select *, case when try_cast(fd as double) > 0 then (k % 977 + 1) * 1000 end as f, case when sd is not null then (k % 101 + 1) * 1000 end as s from p), e as (select *, coalesce(f, s) as dur, case when k % 5 = 1 then 500 when k % 5 = 2 then -1 end as ga, case when k % 5 in (1, 3) then (k % 7) * 50000 + 1000 end as gb from d),
r as (select *, coalesce(ga, 0) as a, coalesce(gb, dur) as b from e), t as (select *, case when dur is null then 'unreliable' when a >= 0 and a < b and b <= dur then 'ok' else 'range' end as status from r)
select k as video_id, dur as duration_ms, case when f is not null then 'format' when s is not null then 'stream' end as duration_source, case when k % 4 = 1 then 1080 else 1920 end as width, case when k % 4 = 1 then 1920 else 1080 end as height, case when k % 5 = 0 then null else round(30000 / 1001.0::double, 6) end as frame_rate,
  (k % 2)::int as audio_tracks, case when k % 2 = 1 then 'unknown/2/48000' else '' end as tracks, status, case when status = 'ok' then a else 0 end as range_start_ms, case when status = 'ok' then b else dur end as range_end_ms from t""")
def media_dim(spark, sf):
    """Probe documents made from orders: an audio stream first where there is one, then the video stream; some ranges are given, some of them outside the media."""
    k = F.col("o_orderkey")
    stream = lambda kind: F.struct(
        F.lit(kind).alias("kind"), F.when(k % 12 != 2, (k % 101 + 1).cast("string")).alias("duration"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.when(k % 4 == 1, -90).alias("rotation"), F.when(k % 5 == 0, "30/0").otherwise("30000/1001").alias("rate"),
        F.lit(None).cast("string").alias("language"), F.lit(2).alias("channels"), F.lit("48000").alias("sample_rate"))
    streams = F.when(k % 2 == 1, F.array(stream("audio"), stream("video"))).otherwise(F.array(stream("video")))
    duration = F.when(k % 6 == 0, None).when(k % 6 == 1, "N/A").when(k % 6 == 2, "-3").otherwise((k % 977 + 1).cast("string"))
    o = table(spark, sf, "orders")
    ranges = o.where("o_orderkey % 5 in (1, 2, 3)").select(k.alias("video_id"), F.when(k % 5 == 1, 500).when(k % 5 == 2, -1).cast("bigint").alias("start_ms"), F.when((k % 5).isin(1, 3), k % 7 * 50_000 + 1000).cast("bigint").alias("end_ms"))
    rows = C.media_dimension(o.select(k.alias("video_id"), duration.alias("duration"), streams.alias("streams")), ranges)
    return rows.withColumn("tracks", F.array_join(F.transform("tracks", lambda t: F.concat_ws("/", t["language"], t["channels"], t["sample_rate"])), ","))


@query("vocabulary_dim", """with s as (select distinct c_mktsegment as seg from customer), v as (select 'segment' as field, seg as token, seg as canonical, false as allow_transitions, '、' as separator from s union all select 'segment', lower(seg), seg, false, '、' from s union all select 'segment', 'the ' || lower(seg), seg, false, '、' from s
  union all select 'status', o_orderstatus, o_orderstatus, true, ' → ' from (select distinct o_orderstatus from orders) union all select 'status', 'state ' || lower(o_orderstatus), o_orderstatus, true, ' → ' from (select distinct o_orderstatus from orders))
select v.*, count(c_custkey) as n from v left join customer on field = 'segment' and c_mktsegment = token group by all""")
def vocabulary_dim(spark, sf):
    """The rules are written as JSON from the tables' own values and read again."""
    value = lambda c, *aliases: F.struct(c.alias("value"), F.array(*aliases).alias("aliases"))
    rule = lambda df, transitions, separator, v: df.agg(F.struct(F.lit(transitions).alias("allowTransitions"), F.lit(separator).alias("separator"), F.array_sort(F.collect_set(v)).alias("values")).alias("rule"))
    seg, st = F.col("c_mktsegment"), F.col("o_orderstatus")
    customer = table(spark, sf, "customer")
    segment = rule(customer, False, "、", value(seg, seg, F.concat(F.lit("The "), seg))).withColumn("field", F.lit("segment"))
    status = rule(table(spark, sf, "orders"), True, " → ", value(st, F.concat(F.lit("State "), st))).withColumn("field", F.lit("status"))
    folder = C.shared_folder(spark, "rules")
    rules = segment.unionByName(status).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("field", "rule"))).alias("fields"))
    rules.select(F.to_json(F.struct("fields")).alias("value")).write.text(folder)
    used = customer.groupBy(seg.alias("token")).agg(F.count("*").alias("n")).withColumn("field", F.lit("segment"))
    return C.read_vocabulary(spark, folder).join(used, ["field", "token"], "left").fillna(0, ["n"])


@query("schema_upgrade_v1_v2", """with d as (select doc_id, doc_id % 2 = 0 and doc_id % 9 <> 0 as old, lang, source, n_chars, doc_id % 3 <> 0 as fn from documents where doc_id % 9 <> 0 or doc_id % 2 <> 3)
select doc_id, 2 as version, lang as viewpoint, source as sound, case when old then n_chars::varchar end as legacy_content, case when old then 'cut' end as legacy_transition, case when old then 'high' end as legacy_confidence,
  case when old then case when fn then 'low' else 'high' end else case when fn then 'low' end end as function_confidence, case when old then 3 else 0 end as n_legacy, case when doc_id % 9 = 0 then 'former' else 'current' end as name from d""")
def schema_upgrade_v1_v2(spark, sf):
    """Documents as shots of a model's reply: even ones have version 1; every ninth is there under the artifact's former name only, and is of version 2."""
    i = F.col("doc_id")
    old = (i % 2 == 0) & (i % 9 != 0)
    m = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(old, 1).otherwise(2).alias("version"), F.when(old, m(perspective=F.col("lang"), content=F.col("n_chars"))).otherwise(m(viewpoint=F.col("lang"))).alias("visual"),
        F.when(old, m(soundEffects=F.col("source"))).otherwise(m(soundEvents=F.col("source"))).alias("audio"), m(x=none).alias("components"), F.when(old, m(transition=F.lit("cut"))).alias("editing"),
        F.when(old, m(editing=F.lit("high"), function=F.when(i % 3 != 0, "low"))).otherwise(m(function=F.when(i % 3 != 0, "low"))).alias("confidence"))
    current, former = d.where("doc_id % 9 <> 0").withColumn("name", F.lit("current")), d.withColumn("name", F.lit("former")).where("doc_id % 9 = 0 or doc_id % 5 = 0")
    out = C.upgrade_shots(C.prefer_current_name(current, former, ["doc_id"]))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return out.select("doc_id", "version", at("visual", "viewpoint").alias("viewpoint"), at("audio", "soundEvents").alias("sound"), at("legacy", "visual.content").alias("legacy_content"), at("legacy", "editing.transition").alias("legacy_transition"), at("legacy", "confidence.editing").alias("legacy_confidence"), at("confidence", "function").alias("function_confidence"), F.size("legacy").alias("n_legacy"), "name")


@query("validated_sink", """select 'orders' as artifact, 'orders' as path, count(*) filter (where o_orderstatus in ('F', 'O')) as n_valid, count(*) filter (where o_orderstatus not in ('F', 'O')) as n_quarantined, 'partial' as status, '1' as schema_version from orders""")
def validated_sink(spark, sf):
    """Writes in two appends; the manifest's last row counts both. Its fingerprint and time are left out here and tested by reading the files back."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    folder, valid = C.shared_folder(spark, "sink"), F.col("o_orderstatus").isin("F", "O")
    C.write_valid(o.where("o_orderkey % 2 = 0"), valid, folder, "orders", "even")
    C.write_valid(o.where("o_orderkey % 2 = 0"), valid, folder, "orders", "even")  # written again
    return C.write_valid(o.where("o_orderkey % 2 = 1"), valid, folder, "orders", "odd").drop("fingerprint", "updated_at")
