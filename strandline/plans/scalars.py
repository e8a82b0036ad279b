"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .bindings import ev_points, ev_ranges, ev_shots, spans, sql, table
from .registry import query


@query("seconds_to_ms", "select event_id, round(value::varchar::decimal(38,9) * 1000)::bigint as t_ms from events")
def seconds_to_ms(spark, sf):
    return table(spark, sf, "events").select("event_id", S.seconds_to_ms("value").alias("t_ms"))


@query("parse_fraction", """
select l_orderkey, l_linenumber, case when l_linenumber = 1 then null else (l_quantity::bigint)::double / (l_linenumber - 1) end as fraction from lineitem""")
def parse_fraction(spark, sf):
    text = F.concat(F.col("l_quantity").cast("bigint"), F.lit("/"), F.col("l_linenumber") - 1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.parse_fraction(text).alias("fraction"))


@query("interval_predicates", sql("spans", """, w as (select *, lead(start_ms) over o as s2, lead(end_ms) over o as e2 from spans window o as (partition by video order by start_ms, end_ms, order_key, line, quantity))
select video, sum((start_ms < e2 and s2 < end_ms)::bigint) as n_overlaps, sum(greatest(0, least(end_ms, e2) - greatest(start_ms, s2))) as shared_ms,
  sum((start_ms <= s2 and e2 <= end_ms and s2 < e2)::bigint) as n_contained from w where s2 is not null group by video"""))
def interval_predicates(spark, sf):
    w = W.partitionBy("video").orderBy("start_ms", "end_ms", "order_key", "line", "quantity")
    rows = spans(spark, sf).withColumn("s2", F.lead("start_ms").over(w)).withColumn("e2", F.lead("end_ms").over(w)).where("s2 is not null")
    s1, e1, s2, e2 = map(F.col, ("start_ms", "end_ms", "s2", "e2"))
    return rows.groupBy("video").agg(
        F.sum(S.overlaps(s1, e1, s2, e2).cast("long")).alias("n_overlaps"), F.sum(S.intersection_ms(s1, e1, s2, e2)).alias("shared_ms"), F.sum(S.contains(s1, e1, s2, e2).cast("long")).alias("n_contained"))


@query("entity_ids", """
with n as (select event_id, row_number() over (partition by user_id order by ts, event_id) as n from events)
select event_id, 'SH' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end as shot_id,
  case when n % 3 = 0 then 'F_SH' || case when n < 10000 then lpad(n::varchar, 4, '0') else n::varchar end || '_MAIN'
    when n between 1 and 99 then 'F_SH' || lpad(n::varchar, 4, '0') || '_K' || lpad(n::varchar, 2, '0') end as evidence_id,
  n < 10000 as legal from n""")
def entity_ids(spark, sf):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select("event_id", n.alias("n")).withColumn("shot_id", S.entity_id("SH", "n"))
    return rows.select("event_id", "shot_id", S.keyframe_id(F.col("shot_id"), F.when(F.col("n") % 3 != 0, F.col("n"))).alias("evidence_id"), S.is_shot_id("shot_id").alias("legal"))


_REF = "case page_id % 6 when 0 then url when 1 then replace(url, '#', '') when 2 then 'raw/' || page_id || '.json#shots[0]' when 3 then '/raw/' || page_id when 4 then '../x' || page_id || '#p' else 'raw/' || page_id || '#' end"


@query("parse_evidence_ref", f"""
with r as (select page_id, {_REF} as ref from pages),
p as (select *, instr(ref, '#') as cut, case when instr(ref, '#') > 0 then left(ref, instr(ref, '#') - 1) else ref end as file from r)
select page_id, file, case when cut > 0 then substr(ref, cut + 1) end as pointer, cut = 0 as is_file,
  case when trim(ref) = '' then 'empty' when file = '' then 'no file' when starts_with(file, '/') or starts_with(file, '~') then 'absolute' when contains(file, chr(92)) then 'backslash'
    when list_contains(string_split(file, '/'), '..') then 'parent' when cut > 0 and substr(ref, cut + 1) = '' then 'no pointer' end as reason from p""")
def parse_evidence_ref(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.expr(_REF).alias("ref"))
    return rows.select("page_id", S.evidence_ref("ref").alias("r")).select("page_id", "r.*")


_CLAIM = "case doc_id % 7 when 0 then ' None ' when 1 then 'N/A' when 2 then '无' when 3 then '' when 4 then null when 5 then 'Unknown' else lang end"
_ABSENT = ", ".join(f"'{w}'" for w in S.ABSENCE_WORDS)


@query("absence_claim", f"select doc_id, lower(trim({_CLAIM})) in ({_ABSENT}) as absent from documents")
def absence_claim(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.is_absence_claim(F.expr(_CLAIM)).alias("absent"))


@query("classify_raw_value", f"""
with r as (select doc_id, lower(trim({_CLAIM})) as v from documents)
select doc_id, case when v is null or v = '' or v = 'unknown' then 'unknown' when v in ({_ABSENT}) then 'absent-claimed' else 'value' end as state from r""")
def classify_raw_value(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.raw_value_state(F.expr(_CLAIM)).alias("state"))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("normalize_enum_single", "select o_orderkey, case when trim(o_orderpriority) in ('1-URGENT', '2-HIGH', '3-MEDIUM') then trim(o_orderpriority) else 'unknown' end as priority from orders")
def normalize_enum_single(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.enum_single("o_orderpriority", _PRIORITIES).alias("priority"))


_ENUM = "array_join(transform(split(lower(text), '[ .]'), x -> x), ',')"


@query("normalize_enum_multi", """
with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(text), '[ .]', ',', 'g'), '[、，,;]'), lambda x: trim(x)), lambda x: x in ('the', 'of', 'der', 'la')) as l from documents)
select doc_id, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_transform(list_distinct(l), lambda x: lpad(list_position(l, x)::varchar, 9, '0') || x))), lambda y: substr(y, 10)), '、'), '') as kept from p""")
def normalize_enum_multi(spark, sf):
    text = F.regexp_replace(F.lower("text"), "[ .]", ",")
    return table(spark, sf, "documents").select("doc_id", S.enum_multi(text, ["the", "of", "der", "la"]).alias("kept"))


_CONF = "case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'medium' when '3-MEDIUM' then 'low' else o_orderpriority end"


@query("confidence_coerce_and_rank", f"""
with r as (select o_custkey, case {_CONF} when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as rank from orders)
select o_custkey, case min(rank) when 0 then 'unknown' when 1 then 'low' when 2 then 'medium' else 'high' end as lowest, max(rank) as best from r group by o_custkey""")
def confidence_coerce_and_rank(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", S.confidence_rank(F.expr(_CONF)).alias("rank"))
    return rows.groupBy("o_custkey").agg(S.confidence_of_rank(F.min("rank")).alias("lowest"), F.max("rank").alias("best"))


@query("loudness_label", "select event_id, case when value < 40 then '静音' when value < 60 then '低' when value < 75 then '中' when value < 88 then '高' else '峰值' end as label from events")
def loudness_label(spark, sf):
    return table(spark, sf, "events").select("event_id", S.loudness_label(F.col("value") - 100).alias("label"))


@query("score_confidence", """
select event_id, case when value >= 12 then 'high' else 'medium' end as cut, case when value / 40 >= 1.8 then 'high' when value / 40 >= 1.25 then 'medium' else 'low' end as motion,
  case when event_id % 2 = 0 then 'unknown' when value / (event_id % 2) >= 1.8 then 'high' when value / (event_id % 2) >= 1.25 then 'medium' else 'low' end as other from events""")
def score_confidence(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.cut_confidence("value").alias("cut"), S.motion_confidence("value", F.lit(40)).alias("motion"), S.motion_confidence("value", F.col("event_id") % 2).alias("other"))


@query("motion_intensity", "select event_id, case when value / 10 < 1 then 'static' when value / 10 < 3 then 'low' when value / 10 < 10 then 'medium' else 'high' end as intensity from events")
def motion_intensity(spark, sf):
    return table(spark, sf, "events").select("event_id", S.motion_intensity(F.col("value") / 10).alias("intensity"))


_LEVELS = "l_orderkey, l_linenumber, -l_quantity - 10 as level, l_quantity * l_linenumber as bass, l_discount * 6 as flatness"


@query("gap_state", f"with r as (select {_LEVELS} from lineitem) select l_orderkey, l_linenumber, case when level >= -18 or bass >= 150 then 'music' when level <= -55 then 'silent' else 'unknown' end as state from r")
def gap_state(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_LEVELS.split(", ")).select("l_orderkey", "l_linenumber", S.gap_state("level", "bass").alias("state"))


@query("texture_state", f"""
with r as (select {_LEVELS} from lineitem)
select l_orderkey, l_linenumber, case when level <= -55 then 'silent' when (bass >= 150 and flatness <= 0.5) or (level >= -18 and bass >= 50 and flatness <= 0.35) then 'music' else 'unknown' end as state from r""")
def texture_state(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*_LEVELS.split(", ")).select("l_orderkey", "l_linenumber", S.texture_state("level", "bass", "flatness").alias("state"))


@query("representative_time", sql("spans", " select video, start_ms, end_ms, least(greatest((start_ms + end_ms) // 2, start_ms), end_ms - 1) as mid_ms from spans where end_ms > start_ms"))
def representative_time(spark, sf):
    return spans(spark, sf).where("end_ms > start_ms").select("video", "start_ms", "end_ms", S.representative_time(F.col("start_ms"), F.col("end_ms")).alias("mid_ms"))


@query("adaptive_bin_width", sql("ev_ranges", " select video, case when ceil((range_end - range_start) / 60000) > 4000 then ceil((range_end - range_start) / 4000)::bigint else 60000 end as width_ms from ev_ranges"))
def adaptive_bin_width(spark, sf):
    return ev_ranges(spark, sf).select("video", S.adaptive_bin(F.col("range_end") - F.col("range_start"), 60_000, 4000).alias("width_ms"))


@query("content_summary", """
with p as (select p_partkey, [trim(p_name), trim(case when p_size % 3 = 0 then 'none' when p_size % 3 = 1 then ' ' else p_brand end), trim(p_type)] as l from part)
select p_partkey, array_to_string(list_filter(l, lambda x: x is not null and x <> '' and lower(x) not in ('unknown', 'none')), '；') as summary from p""")
def content_summary(spark, sf):
    odd = F.when(F.col("p_size") % 3 == 0, "none").when(F.col("p_size") % 3 == 1, " ").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", S.content_summary("p_name", odd, "p_type").alias("summary"))


@query("keyword_presence", "select doc_id, contains(text, 'idiot') or contains(text, 'License') or contains(text, 'password') as hosted from documents")
def keyword_presence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.has_keyword("text", ["idiot", "License", "password"]).alias("hosted"))


@query("transition_label", """
with b as (select event_id, case event_type when 'view' then 'hardCutCandidate' when 'signup' then 'sourceStart' else event_type end as kind from events)
select event_id, case when kind = 'hardCutCandidate' then '硬切' end as value, case kind when 'hardCutCandidate' then 'value' when 'sourceStart' then 'absent' else 'unknown' end as state from b""")
def transition_label(spark, sf):
    kind = F.expr("case event_type when 'view' then 'hardCutCandidate' when 'signup' then 'sourceStart' else event_type end")
    return table(spark, sf, "events").select("event_id", S.transition(kind).alias("t")).select("event_id", "t.*")


@query("fingerprint", """
select doc_id, left(sha256(text), 12) as revision, left(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}'), 16) as print from documents""")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.text_fingerprint("text").alias("revision"), S.fingerprint("source", "lang", "doc_id").alias("print"))


@query("proxy_policy", sql("spans", """
 select video, start_ms, end_ms, case when end_ms - start_ms < 864000000 then 'image' else 'video' end as kind,
  case when end_ms - start_ms < 864000000 then least(greatest((start_ms + end_ms) // 2, start_ms), end_ms - 1) end as image_ms, left(sha256(video::varchar), 4) as cache_key from spans where end_ms > start_ms"""))
def proxy_policy(spark, sf):
    """Short shots are shown by one frame; the limit is 2 000 ms in production, ten days on this binding."""
    short = F.col("end_ms") - F.col("start_ms") < 864_000_000
    rows = spans(spark, sf).where("end_ms > start_ms")
    return rows.select("video", "start_ms", "end_ms", F.when(short, "image").otherwise("video").alias("kind"), F.when(short, S.representative_time(F.col("start_ms"), F.col("end_ms"))).alias("image_ms"), S.text_fingerprint(F.col("video").cast("string"), 4).alias("cache_key"))


_RELATION = "case page_id % 3 when 0 then 'echo → B' || lpad((page_id % 100)::varchar, 4, '0') when 1 then 'see → B0001 and →B0002' else url end"


@query("relation_ref_extract", f"""
with r as (select page_id, {_RELATION} as relation from pages)
select page_id, nullif(regexp_extract(relation, '^\\s*(.+?)\\s*→\\s*(B\\d{{4}})\\s*$', 1), '') as kind, nullif(regexp_extract(relation, '^\\s*(.+?)\\s*→\\s*(B\\d{{4}})\\s*$', 2), '') as target,
  array_to_string(regexp_extract_all(relation, '→\\s*(B\\d{{4}})', 1), ' ') as targets from r""")
def relation_ref_extract(spark, sf):
    relation = F.expr(_RELATION.replace("(page_id % 100)::varchar", "cast(page_id % 100 as string)"))
    rows = table(spark, sf, "pages").select("page_id", relation.alias("r"))
    return rows.select("page_id", S.relation_target("r").alias("t"), F.array_join(S.relation_targets("r"), " ").alias("targets")).select("page_id", "t.kind", "t.target", "targets")


@query("split_types", """
select doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ',', '、'), '、'), lambda x: trim(x)), lambda x: x <> ''), '|') as types,
  len(list_filter(list_transform(string_split(replace(text, ',', '、'), '、'), lambda x: trim(x)), lambda x: x <> ''))::int as n from documents""")
def split_types(spark, sf):
    types = S.split_types(F.regexp_replace("text", ",", "、"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(types, "|").alias("types"), F.size(types).alias("n"))


@query("normalize_vocab", """
with vocab(token, canonical) as (values ('antique', '古风'), ('green', '绿色'), ('绿', '绿色'), ('blue', '蓝色'), ('small', '小'), ('medium', '中'), ('large', '大'), ('economy', '经济'), ('promo', '促销'), ('standard', '标准')),
raw as (select p_partkey, case p_size % 4 when 0 then p_type when 1 then replace(p_type, ' ', '、') when 2 then null else 'unknown' end as v from part),
parts as (select p_partkey, v, unnest(string_split(v, '、')) as part, generate_subscripts(string_split(v, '、'), 1) as pos from raw where v is not null and trim(v) <> '' and lower(trim(v)) <> 'unknown'),
hit as (select p_partkey, pos, canonical from parts left join vocab on lower(trim(part)) = token),
done as (select p_partkey, bool_and(canonical is not null) as fine, string_agg(canonical, '、' order by pos) as canon from hit group by p_partkey)
select p_partkey, case when done.p_partkey is null then 'unknown' when fine then 'value' else 'unmapped' end as state, case when fine then canon end as value
from raw left join done using (p_partkey)""")
def normalize_vocab(spark, sf):
    from ..operators.vocabulary import normalize

    raw = F.expr("case p_size % 4 when 0 then p_type when 1 then replace(p_type, ' ', '、') when 2 then null else 'unknown' end")
    return normalize(table(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", VOCABULARY).select("p_partkey", "state", "value")


#: Token -> canonical value, of one field.
VOCABULARY = {"antique": "古风", "green": "绿色", "绿": "绿色", "blue": "蓝色", "small": "小", "medium": "中", "large": "大", "economy": "经济", "promo": "促销", "standard": "标准"}


@query("resolve_pointer", """with c as (select conv_id, turn, conv_id + turn as k, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)
select conv_id, turn, case k % 8 when 1 then 'out of bounds' when 2 then 'missing key' when 3 then 'wrong type' when 4 then 'wrong type' when 5 then 'wrong type' when 6 then 'bad segment' when 7 then 'no document' end as error from c""")
def resolve_pointer(spark, sf):
    """Pointers into documents of whole conversations: a missing key, a wrong type and a place out of bounds are told apart."""
    from ..operators import documents as D

    c, w = table(spark, sf, "conversations"), W.partitionBy("conv_id").orderBy("turn")
    turn = F.struct(F.col("turn"), F.struct("role", "text").alias("said"))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(F.concat(F.lit("c"), "conv_id").alias("file"), F.to_json(F.struct(F.transform("turns", lambda t: t["said"]).alias("turns"), F.struct(F.col("conv_id").alias("id")).alias("meta"))).alias("doc"))
    k, i = F.col("conv_id") + F.col("turn"), F.row_number().over(w) - 1
    n = F.count("*").over(W.partitionBy("conv_id"))
    pointer = (
        F.when(k % 8 == 1, F.concat(F.lit("turns["), n, F.lit("].role"))).when(k % 8 == 2, "turns[0].tone").when(k % 8 == 3, "meta[0]").when(k % 8 == 4, "turns.role").when(k % 8 == 5, "meta.id.x").when(k % 8 == 6, "turns..role")
        .otherwise(F.concat(F.lit("turns["), i, F.lit("].text")))
    )
    refs = c.select("conv_id", "turn", F.concat(F.when(k % 8 == 7, "x").otherwise("c"), "conv_id").alias("file"), pointer.alias("pointer"))
    return D.resolve_pointers(refs, D.inventory(docs)).select("conv_id", "turn", "error")
