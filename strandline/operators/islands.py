"""Gaps-and-islands and interval algebra. Intervals are half-open [start_ms, end_ms); every window is partitioned by the video keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import decide
from .scan import merged, running

KEYS = ("video",)


def _running_end(keys: Sequence[str], order: Sequence) -> Column:
    return F.max("end_ms").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def number_islands(df: DataFrame, opens: Column, order: Sequence, keys: Sequence[str] = KEYS, name: str = "island") -> DataFrame:
    """Running count of rows that open an island."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_opens", opens.cast("long")).withColumn(name, F.sum("_opens").over(w)).drop("_opens")


def merge_intervals(df: DataFrame, max_gap: int = 0, keys: Sequence[str] = KEYS, segment_rows: int | None = None) -> DataFrame:
    """Sorted union: an interval joins when its start is at most ``max_gap`` after the largest end so far; empty ones are dropped. ``segment_rows``: longer videos are scanned by many tasks."""
    order = ("start_ms", "end_ms")
    if segment_rows is not None:
        return merged(df.where("end_ms > start_ms"), lambda before: F.col("start_ms") - before > max_gap, order, keys, segment_rows).drop("island")
    rows = df.where("end_ms > start_ms").withColumn("_before", _running_end(keys, order))
    rows = number_islands(rows, F.col("_before").isNull() | (F.col("start_ms") - F.col("_before") > max_gap), order, keys)
    return rows.groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n")).drop("island")


def speech_runs(df: DataFrame, gap_ms: int, keys: Sequence[str] = KEYS, segment_rows: int | None = None) -> DataFrame:
    """Runs of segments, split where a gap reaches ``gap_ms`` (equality splits); a run ends at its largest end. Rows are numbered from 0 in start order. ``segment_rows``: as in merge_intervals."""
    order = ("start_ms", "end_ms", "pos")
    if segment_rows is not None:
        runs = merged(df, lambda before: F.col("start_ms") - before >= gap_ms, order, keys, segment_rows)
        return runs.select(*keys, (F.col("island") - 1).alias("run"), "start_ms", "end_ms", "n")
    rows = df.withColumn("_before", _running_end(keys, order))
    rows = number_islands(rows, F.col("_before").isNull() | (F.col("start_ms") - F.col("_before") >= gap_ms), order, keys, "run")
    runs = rows.groupBy(*keys, "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    return runs.withColumn("run", F.col("run") - 1)


def clip(df: DataFrame, low: str | Column, high: str | Column) -> DataFrame:
    return df.withColumn("start_ms", F.greatest("start_ms", low)).withColumn("end_ms", F.least("end_ms", high)).where("end_ms > start_ms")


def union_length(df: DataFrame, keys: Sequence[str] = KEYS, segment_rows: int | None = None) -> DataFrame:
    """Length of the union, counting overlaps once: each interval adds what lies beyond the largest end so far. ``segment_rows``: longer videos are scanned by many tasks."""
    rows = running(df.where("end_ms > start_ms"), ("start_ms", "end_ms"), {"_before": ("max", "end_ms")}, keys, inclusive=False, segment_rows=segment_rows)
    new = F.greatest(F.lit(0), F.col("end_ms") - F.greatest("start_ms", F.coalesce("_before", "start_ms")))
    return rows.groupBy(*keys).agg(F.sum(new).alias("union_ms"))


def complement_gaps(df: DataFrame, ranges: DataFrame, min_gap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Uncovered parts of each range of at least ``min_gap``, head and tail included. ranges: keys, range_start, range_end; a range without intervals is one gap."""
    cut = df.select(*keys, "start_ms", "end_ms").join(ranges, list(keys))
    cut = cut.select(*keys, F.greatest("start_ms", "range_start").alias("start_ms"), F.least("end_ms", "range_end").alias("end_ms"), "range_start")
    tail = ranges.select(*keys, F.col("range_end").alias("start_ms"), F.col("range_end").alias("end_ms"), "range_start").withColumn("_tail", F.lit(1))
    rows = cut.withColumn("_tail", F.lit(0)).unionByName(tail)
    before = F.max("end_ms").over(W.partitionBy(*keys).orderBy("_tail", "start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("gap_start", F.greatest(F.coalesce(before, F.col("range_start")), F.col("range_start")))
    return rows.where(F.col("start_ms") - F.col("gap_start") >= min_gap).select(*keys, "gap_start", F.col("start_ms").alias("gap_end"))


def group_hits(df: DataFrame, max_gap: int = 2, index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``grp``: hits whose step from the one before is at most ``max_gap`` share a group."""
    step = F.col(index) - F.lag(index).over(W.partitionBy(*keys).orderBy(index))
    return number_islands(df.withColumn("_step", step), F.col("_step").isNull() | (F.col("_step") > max_gap), (index,), keys, "grp").drop("_step")


def rle(df: DataFrame, state: str, order: Sequence, keys: Sequence[str] = KEYS, name: str = "block") -> DataFrame:
    """Adds the number of the run of equal states (null equals null)."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.col(state).eqNullSafe(F.lag(state).over(w))
    return number_islands(df.withColumn("_changed", changed), F.col("_changed"), order, keys, name).drop("_changed")


def rle_blocks(df: DataFrame, state: str, start: str, end: str, member: str, order: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a run: B0001.., first start, last end, ordered members."""
    rows = rle(df, state, order, keys)
    key = F.struct(*order)
    out = rows.groupBy(*keys, "block").agg(
        F.min_by(start, key).alias("start"), F.max_by(end, key).alias("end"), F.min_by(state, key).alias("state"),
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(member).alias("_member")))), lambda x: x["_member"]).alias("members"))
    return out.withColumn("block_id", F.format_string("B%04d", "block")).drop("block")


def smooth_mask(df: DataFrame, mask: str, merge_gap: int, minimum: int, blocked: Column | None = None, index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """Replaces ``mask``: false runs of at most ``merge_gap`` rows with true on both sides and no blocked row are filled; then true runs under ``minimum`` rows are dropped."""
    w, whole = W.partitionBy(*keys), W.partitionBy(*keys, "_run")
    rows = rle(df.withColumn("_blocked", F.lit(False) if blocked is None else blocked), mask, (index,), keys, "_run")
    inner = (F.col("_run") > 1) & (F.col("_run") < F.max("_run").over(w))
    fill = ~F.col(mask) & inner & (F.count("*").over(whole) <= merge_gap) & ~F.bool_or("_blocked").over(whole)
    rows = rle(rows.withColumn(mask, F.col(mask) | fill).drop("_run", "_blocked"), mask, (index,), keys, "_run")
    return rows.withColumn(mask, F.col(mask) & (F.count("*").over(whole) >= minimum)).drop("_run")


def mask_to_intervals(df: DataFrame, mask: str, center_ms: str, half_ms: int, ranges: DataFrame, index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """True runs as [first center - half, last center + half), clipped to the range."""
    runs = rle(df, mask, (index,), keys, "_run").where(mask).groupBy(*keys, "_run").agg(
        (F.min(center_ms) - half_ms).alias("start_ms"), (F.max(center_ms) + half_ms).alias("end_ms"))
    return clip(runs.drop("_run").join(ranges, list(keys)), "range_start", "range_end").select(*keys, "start_ms", "end_ms")


def cuts_to_partition(cuts: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contiguous shots (seq from 1) that cover each range, cut at the distinct ``cut_ms`` strictly inside it."""
    inner = cuts.join(ranges, list(keys)).where("cut_ms > range_start and cut_ms < range_end").select(*keys, "cut_ms")
    ends = ranges.select(*keys, F.explode(F.array("range_start", "range_end")).alias("cut_ms"))
    w = W.partitionBy(*keys).orderBy("cut_ms")
    rows = inner.unionByName(ends).distinct().select(*keys, F.row_number().over(w).alias("seq"), F.col("cut_ms").alias("start_ms"), F.lead("cut_ms").over(w).alias("end_ms"))
    return rows.where("end_ms is not null")


def shot_table(shots: DataFrame, minimum: int, low: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds duration, the types of both boundaries, and needs_review (short, or ``low`` says the cut before is doubtful)."""
    w = W.partitionBy(*keys).orderBy("seq")
    rows = shots.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).withColumn("_last", F.lead("seq").over(w).isNull())
    rows = rows.withColumn("boundary_in", F.when(F.col("seq") == 1, "sourceStart").otherwise("hardCutCandidate")).withColumn("boundary_out", F.when(F.col("_last"), "sourceEnd").otherwise("hardCutCandidate"))
    return rows.withColumn("needs_review", (F.col("duration_ms") <= minimum) | low).withColumn("shot_id", F.format_string("SH%04d", "seq")).drop("_last")


def contiguity_violations(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Neighbours that overlap or leave a gap; points (start = end) take no part. kind: overlap or gap."""
    order = ("start_ms", "end_ms")
    rows = df.where("end_ms > start_ms").withColumn("before", _running_end(keys, order))
    kind = F.when(F.col("start_ms") < F.col("before"), "overlap").when(F.col("start_ms") > F.col("before"), "gap")
    return rows.withColumn("kind", kind).where("kind is not null")


def fill_rule(longest: int):
    """Rule: the number of the window that each segment falls into; one joins while its end is within ``longest`` of the window's start."""

    def rule(starts: list, ends: list) -> list[int]:
        out, n, opened = [], -1, None
        for s, e in zip(starts, ends):
            if opened is None or e - opened > longest:
                n, opened = n + 1, s
            out.append(n)
        return out

    return rule


def pack_windows(df: DataFrame, longest: int = 30_000, pad: int = 200, keys: Sequence[str] = KEYS) -> DataFrame:
    """Greedy windows: a segment joins while its end is within ``longest`` of the window's start; then padded and clamped to [0, range_end).

    Stretches end where a gap exceeds ``longest``, since a new window always starts there; they are decided one after the other in a stream.
    """
    order = ("start_ms", "end_ms", "pos")
    rows = df.withColumn("_before", _running_end(keys, order))
    rows = number_islands(rows, F.col("_before").isNull() | (F.col("start_ms") - F.col("_before") > longest), order, keys, "chain").drop("_before")
    rows = decide(rows, keys, ["start_ms", "end_ms"], ["start_ms", "end_ms"], fill_rule(longest), "_window", "bigint")
    out = rows.groupBy(*keys, "chain", "_window", "range_end").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return out.select(*keys, F.greatest(F.lit(0), F.col("start_ms") - pad).alias("start_ms"), F.least("range_end", F.col("end_ms") + pad).alias("end_ms"))


def concat_timeline(windows: DataFrame, silence: int = 500, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds where each window starts on a common axis with ``silence`` between windows."""
    w = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    length = F.col("end_ms") - F.col("start_ms")
    before = F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return windows.withColumn("n", F.row_number().over(w)).withColumn("concat_ms", before + silence * (F.col("n") - 1))


def timeline_remap(times: DataFrame, windows: DataFrame, time: str = "concat_time", keys: Sequence[str] = KEYS) -> DataFrame:
    """Times on the common axis back to source time: within the latest window that starts at or before; in the silence, that window's end."""
    both = windows.select(*keys, F.col("concat_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("concat_ms", "start_ms", "end_ms").alias("_w")).unionByName(
        times.withColumn("_t", F.col(time)).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    last = F.last("_w", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("_at", last).where("_kind = 1 and _at is not null")
    source = F.least(F.col("_at.start_ms") + F.col(time) - F.col("_at.concat_ms"), F.col("_at.end_ms"))
    return rows.withColumn("source_ms", source).select(*times.columns, "source_ms")


def fixed_windows(ranges: DataFrame, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """[range_start + k width, the next one or range_end)."""
    rows = ranges.where("range_end > range_start").select(*keys, "range_end", F.explode(F.sequence("range_start", F.col("range_end") - 1, F.lit(width).cast("bigint"))).alias("start_ms"))
    return rows.select(*keys, "start_ms", F.least("range_end", F.col("start_ms") + width).alias("end_ms"))


def normalize_segments(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Adds action (kept, clamped, or a reason to drop: no text, bad order, outside) and the clamped bounds."""
    start, end = F.greatest("start_ms", low), F.least("end_ms", high)
    action = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull() | F.col("text").isNull(), "malformed")
        .when(F.col("start_ms") >= F.col("end_ms"), "bad order")
        .when(start >= end, "outside")
        .when((start != F.col("start_ms")) | (end != F.col("end_ms")), "clamped")
        .otherwise("kept")
    )
    fine = action.isin("kept", "clamped")
    return df.withColumn("action", action).withColumn("clamped_start", F.when(fine, start)).withColumn("clamped_end", F.when(fine, end))


def plan_shifts(shots: DataFrame, cuts: DataFrame, minimum: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cuts to move to their audio time: synchronised with high confidence, really moved, and both neighbours keep ``minimum`` ms against their original bounds."""
    w = W.partitionBy(*keys).orderBy("seq")
    sides = shots.select(*keys, F.col("start_ms").alias("_left"), F.col("end_ms").alias("cut_ms"), F.lead("end_ms").over(w).alias("_right"), F.col("seq").alias("left_seq"))
    sides = sides.where("_right is not null")
    fine = (F.col("classification") == "synchronizedCut") & (F.col("confidence") == "high") & (F.col("audio_ms") != F.col("cut_ms"))
    fine = fine & (F.col("audio_ms") - F.col("_left") >= minimum) & (F.col("_right") - F.col("audio_ms") >= minimum)
    return sides.join(cuts, [*keys, "cut_ms"]).where(fine).select(*keys, "left_seq", "cut_ms", "audio_ms")


def apply_shifts(shots: DataFrame, moves: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Moves shared boundaries, for a video all or none: none if a move's cut is not the current boundary."""
    ends = shots.select(*keys, F.col("seq").alias("left_seq"), F.col("end_ms").alias("_now"))
    guard = moves.join(ends, [*keys, "left_seq"], "left").groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("_now") == F.col("cut_ms"), F.lit(False))).alias("_fine"))
    legal = moves.join(guard, list(keys)).where("_fine").select(*keys, "left_seq", "audio_ms")
    out = shots.join(legal.select(*keys, F.col("left_seq").alias("seq"), F.col("audio_ms").alias("_end")), [*keys, "seq"], "left")
    out = out.join(legal.select(*keys, (F.col("left_seq") + 1).alias("seq"), F.col("audio_ms").alias("_start")), [*keys, "seq"], "left")
    out = out.withColumn("start_ms", F.coalesce("_start", "start_ms")).withColumn("end_ms", F.coalesce("_end", "end_ms"))
    return out.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).drop("_start", "_end")


def fuse_intervals(scan: DataFrame, anchors: DataFrame, complete: Column | bool, tolerance: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scan intervals, merged with the anchors within ``tolerance`` where the transcript is complete (a column of ``anchors``, or a constant)."""
    keep = F.lit(complete) if isinstance(complete, bool) else complete
    return merge_intervals(scan.select(*keys, "start_ms", "end_ms").unionByName(anchors.where(keep).select(*keys, "start_ms", "end_ms")), tolerance, keys)
