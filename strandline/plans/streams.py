"""Queries of the streaming modes, over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.corpus import shared_folder
from ..streaming import modes as M
from .bindings import ms, sql, table
from .islands import _RUNS, GAP
from .registry import query
from .signals import _apart, _recursive


def _stream(spark, sf, name):
    """The table as a stream of its files (a glob, since the table may be a file or a folder)."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/{name}.parq*")


@query("stream_speech_runs", sql("ev_seg", _RUNS + " select video, start_ms, end_ms, n from runs"))
def stream_speech_runs(spark, sf):
    e = _stream(spark, sf, "events")
    seg = e.select(F.col("user_id").alias("video"), ms("ts").alias("start_ms"), (ms("ts") + F.round(F.col("value") * 60000).cast("bigint")).alias("end_ms"))
    return M.finish(M.speech_runs(seg, GAP), shared_folder(spark, "runs"))


@query("stream_latest_wins", "select o_custkey as entity, o_orderpriority as field, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as value from orders group by all")
def stream_latest_wins(spark, sf):
    log = _stream(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("field"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    return M.upsert_latest(log, ["entity", "field"], ["d", "k"], "value", shared_folder(spark, "latest")).select("entity", "field", "value")


@query("stream_state_tally", "select user_id as video, epoch_us(ts) // 1000 // 86400000 * 86400000 as window_ms, event_type as kind, count(*) as n from events group by all")
def stream_state_tally(spark, sf):
    points = _stream(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_type").alias("kind"))
    return M.finish(M.windowed_tally(points, "kind", "1 day"), shared_folder(spark, "tally"))


@query("stream_local_peaks", sql("ev_series", """, seen as (select * from ev_series where time_ms < (select max(time_ms) - 3600000 from ev_series)),
n as (select *, coalesce(lag(value) over (partition by video order by i), '-inf'::double) as l, lead(value) over (partition by video order by i) as r from seen)
select video, event_id as id, value from n where r is not null and value > 40 and value >= l and value >= r and (value > l or value > r)"""))
def stream_local_peaks(spark, sf):
    """Frames above the watermark stay pending, and so does the last one of a video below it: its next one has not come."""
    points = _stream(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_id").alias("id"), "value")
    return M.finish_append(M.local_peaks(points, 40, "1 hour"), shared_folder(spark, "peaks")).select("video", "id", "value")


_MARK = "(select max({0}) - 3600000 from {1})"


@query("stream_closed_runs", sql("ev_seg", _RUNS + f" select video, start_ms, end_ms, n from runs where end_ms + {GAP} - 1 <= " + _MARK.format("start_ms", "ev_seg")))
def stream_closed_runs(spark, sf):
    """Runs that no later segment can join: they leave the state when the watermark passes their end and the gap."""
    e = _stream(spark, sf, "events")
    seg = e.select(F.col("user_id").alias("video"), ms("ts").alias("start_ms"), (ms("ts") + F.round(F.col("value") * 60000).cast("bigint")).alias("end_ms"))
    return M.finish_append(M.speech_runs(seg, GAP), shared_folder(spark, "closed-runs"))


@query("stream_closed_windows", "select * from (select user_id as video, epoch_us(ts) // 1000 // 86400000 * 86400000 as window_ms, event_type as kind, count(*) as n from events group by all) where window_ms + 86400000 <= (select max(epoch_us(ts) // 1000) - 3600000 from events)")
def stream_closed_windows(spark, sf):
    """Days that the watermark has passed."""
    points = _stream(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_type").alias("kind"))
    return M.finish_append(M.windowed_tally(points, "kind", "1 day"), shared_folder(spark, "windows"))


STEP = 6 * 3_600_000
_CHAINS = f""", c as (select video, time_ms, event_id as id, value, coalesce(time_ms - lag(time_ms) over (partition by video order by time_ms, event_id) >= {STEP}, true) as opens from ev_series
  where value > 60 and time_ms < {_MARK.format("time_ms", "ev_series where value > 60")}),
d as (select *, sum(opens::int) over (partition by video order by time_ms, id rows unbounded preceding) as chain from c),
closed as (select * from d qualify max(time_ms) over (partition by video, chain) + {STEP} <= {_MARK.format("time_ms", "ev_series where value > 60")})"""


@query("stream_suppression", _recursive(sql("ev_series", _CHAINS + _apart("closed", "value", "time_ms", STEP) + " select video, id, value from left_")))
def stream_suppression(spark, sf):
    """High frames at least six hours apart, in chains that the watermark has closed."""
    points = _stream(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_id").alias("id"), "value").where("value > 60")
    return M.finish_append(M.suppress_close(points, STEP), shared_folder(spark, "suppression")).select("video", "id", "value")


@query("stream_novelty", sql("ev_series", f""", seen as (select * from ev_series where time_ms < {_MARK.format("time_ms", "ev_series")}),
d as (select *, abs(value - lag(value) over w) as d, abs(ln(value + 1) - lag(ln(value + 1)) over w) as e, lead(1, 50) over w as later from seen window w as (partition by video order by i)),
s as (select video, event_id as id, later, d, e, median(d) over w as md, median(e) over w as me from d window w as (partition by video order by i rows between 50 preceding and 50 following))
select video, id, round(0.6 * d / greatest(md, 1.0) + 0.4 * e / greatest(me, 0.05), 6) as novelty from s where later is not null"""))
def stream_novelty(spark, sf):
    """Frames with fifty later ones below the watermark."""
    points = _stream(spark, sf, "events").select(F.col("user_id").alias("video"), ms("ts").alias("time_ms"), F.col("event_id").alias("id"), "value", F.log(F.col("value") + 1).alias("level"))
    found = M.finish_append(M.novelty(points, {"value": (0.6, 1.0), "level": (0.4, 0.05)}), shared_folder(spark, "novelty"))
    return found.select("video", "id", F.round(F.nanvl("novelty", F.lit(None).cast("double")), 6).alias("novelty"))
