"""The driver's tables as timelines: each binding as a DataFrame and as SQL for the oracle.

Every timeline row has ``video``, the key of all operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rules import unpacked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(c: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over as many tasks as run at once, for work that is much larger than its rows (their number being given, they are not joined again)."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


HOUR = 3_600_000


def ev_seg(spark, sf) -> DataFrame:
    """Transcript segments: an event lasts ``value`` minutes."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("video"), ms("ts").alias("start_ms"), (ms("ts") + F.round(F.col("value") * 60000).cast("bigint")).alias("end_ms"), F.col("event_type").alias("text"), F.col("event_id").alias("pos"), "value")


def ev_series(spark, sf) -> DataFrame:
    """A frame signal: events of a user in time order."""
    e = table(spark, sf, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("video"), F.row_number().over(w).alias("i"), ms("ts").alias("time_ms"), "value", F.col("event_type").alias("kind"), "event_id")


def ev_points(spark, sf, *kinds: str) -> DataFrame:
    e = table(spark, sf, "events")
    e = e.where(F.col("event_type").isin(list(kinds))) if kinds else e
    return e.select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_id").alias("id"), "value", F.col("event_type").alias("kind"))


def ev_ranges(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("video")).agg(F.min(ms("ts")).alias("range_start"), (F.max(ms("ts")) + 1).alias("range_end"))


def ev_shots(spark, sf) -> DataFrame:
    """Contiguous shots of a user's range, cut at ``view`` events. Events are read and shuffled once: the first row of a user carries the ends of the range.

    Events are small and windows by video follow each other in one task, so they are dealt in a given number of parts."""
    t, w = F.col("t"), W.partitionBy("video")
    e = table(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("t"), (F.col("event_type") == "view").alias("cut"))
    e = unpacked(e, "video").select("video", "t", "cut", F.min("t").over(w).alias("low"), (F.max("t").over(w) + 1).alias("high"))
    times = F.array_compact(F.array(F.when(F.col("cut") & (t > F.col("low")) & (t < F.col("high")), t), F.when(t == F.col("low"), t), F.when(t == F.col("low"), F.col("high"))))
    cuts = e.select("video", F.explode(times).alias("start_ms")).distinct()
    order = w.orderBy("start_ms")
    return cuts.select("video", F.row_number().over(order).alias("seq"), "start_ms", F.lead("start_ms").over(order).alias("end_ms")).where("end_ms is not null")


def emb_frames(spark, sf) -> DataFrame:
    """Frames of videos of at most a thousand rows: the label and the thousand that a vector belongs to, so that videos grow in number and not in length."""
    e = table(spark, sf, "embeddings").withColumn("video", F.col("label").cast("long") * 1_000_000 + F.floor(F.col("vec_id") / 1000))
    w = W.partitionBy("video").orderBy("vec_id")
    return e.select("video", F.row_number().over(w).alias("i"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))


def emb_planes(spark, sf) -> DataFrame:
    """Frames as planes of 16 values in 0..1 (quarters of the vector), with neighbour differences as edges and a histogram of four values."""
    part = lambda k: F.transform(F.slice("x", 16 * k + 1, 16), lambda a: F.abs(a) - F.floor(F.abs(a)))
    rows = emb_frames(spark, sf).select("video", "i", part(0).alias("hue"), part(1).alias("saturation"), part(2).alias("value"))
    edges = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: F.abs(F.col("value")[k] - F.col("value")[k - 1]))
    bins = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.size(F.filter("hue", lambda a: F.floor(a * 4) == b)) / 16)
    return rows.withColumn("edges", edges).withColumn("histogram", bins)


def spans(spark, sf) -> DataFrame:
    """Intervals of a customer: between order and ship date, bounded in length."""
    day = 86_400_000
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, far = ms("least(o_orderdate, l_shipdate)"), ms("greatest(o_orderdate, l_shipdate)")
    return j.where("o_orderdate <> l_shipdate").select(
        F.col("o_custkey").alias("video"), start.alias("start_ms"), F.least(far, start + (F.col("l_linenumber") + 1) * (3 * day)).alias("end_ms"),
        F.col("o_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))


def conv(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("video"), F.col("turn").alias("seq"), F.col("role").alias("state"), "text")


def doc_lines(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("video"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


SQL = {
    "ev_seg": "select user_id as video, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + round(value * 60000)::bigint as end_ms, event_type as text, event_id as pos, value from events",
    "ev_series": "select user_id as video, row_number() over (partition by user_id order by ts, event_id) as i, epoch_us(ts) // 1000 as time_ms, value, event_type as kind, event_id from events",
    "ev_points": "select user_id as video, epoch_us(ts) // 1000 as time_ms, event_id as id, value, event_type as kind from events",
    "ev_ranges": "select user_id as video, min(epoch_us(ts) // 1000) as range_start, max(epoch_us(ts) // 1000) + 1 as range_end from events group by user_id",
    "ev_shots": """select video, row_number() over w as seq, t as start_ms, lead(t) over w as end_ms from (
        select distinct video, t from (
          select video, range_start as t from ev_ranges union all select video, range_end from ev_ranges
          union all select p.video, time_ms from ev_points p join ev_ranges r using (video) where kind = 'view' and time_ms > range_start and time_ms < range_end))
      window w as (partition by video order by t) qualify end_ms is not null""",
    "emb_frames": "select label::bigint * 1000000 + vec_id // 1000 as video, row_number() over (partition by label, vec_id // 1000 order by vec_id) as i, vec_id, embedding::double[] as x from embeddings",
    "emb_planes": """select video, i, list_transform(x[1:16], lambda a: abs(a) - floor(abs(a))) as hue, list_transform(x[17:32], lambda a: abs(a) - floor(abs(a))) as saturation,
        list_transform(x[33:48], lambda a: abs(a) - floor(abs(a))) as "value" from emb_frames""",
    "spans": """select o_custkey as video, (epoch_us(least(o_orderdate, l_shipdate)) // 1000) as start_ms,
        least((epoch_us(greatest(o_orderdate, l_shipdate)) // 1000), (epoch_us(least(o_orderdate, l_shipdate)) // 1000) + (l_linenumber + 1) * 259200000) as end_ms,
        o_orderkey as order_key, l_linenumber as line, l_quantity as quantity
      from lineitem join orders on l_orderkey = o_orderkey where o_orderdate <> l_shipdate""",
    "conv": "select conv_id as video, turn as seq, role as state, text from conversations",
    "doc_lines": "select doc_id as video, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents",
}
NEEDS = {"ev_shots": ("ev_points", "ev_ranges"), "emb_planes": ("emb_frames",)}


def sql(bindings: str, body: str) -> str:
    """``body`` with the named bindings as common table expressions before it (body may go on with ', name as (...)')."""
    names: list[str] = []
    for b in bindings.split():
        names += [n for n in (*NEEDS.get(b, ()), b) if n not in names]
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + body
