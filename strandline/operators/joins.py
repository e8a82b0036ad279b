"""Joins on time: points in intervals, overlaps, as-of and band joins.

No operator uses a non-equi join: overlaps meet in time buckets under an equi-join on (video, bucket), and as-of
joins are windows over the union of both sides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import decide, number_chains
from .scan import running

KEYS = ("video",)
FOREVER = (1 << 62)


def _last(column: str, keys: Sequence[str], order: Sequence, back: bool = True) -> Column:
    w = W.partitionBy(*keys).orderBy(*order)
    if back:
        return F.last(column, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.first(column, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def point_in_shot(points: DataFrame, shots: DataFrame, time: str = "time_ms", tail: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds seq of the shot that holds each point, null outside; with ``tail`` points at or after the last end go to the last shot. Shots must not overlap."""
    side = shots.select(*keys, F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("seq", "end_ms").alias("_s"))
    if tail:
        w = W.partitionBy(*keys).orderBy(F.desc("seq"))
        open_end = F.when(F.row_number().over(w) == 1, F.lit(FOREVER)).otherwise(F.col("end_ms"))
        side = shots.select(*keys, F.col("start_ms").alias("_t"), F.lit(0).alias("_kind"), F.struct("seq", open_end.alias("end_ms")).alias("_s"))
    both = side.unionByName(points.withColumn("_t", F.col(time)).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("_at", _last("_s", keys, ("_t", "_kind"))).where("_kind = 1")
    return rows.select(*points.columns, F.when(F.col("_t") < F.col("_at.end_ms"), F.col("_at.seq")).alias("seq"))


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs with positive overlap. left: s1, e1; right: s2, e2 (null end: open); other columns must differ but for the keys.

    Buckets come in sizes: size k is ``bucket_ms`` times 2**k wide, and an interval's own size is the first that is no shorter than it. Two intervals meet in buckets of the
    larger of their sizes, where each touches two at most; so an interval has two copies for its own size and for each larger one that the other side of its video has,
    however long it is. A pair is kept in the bucket where its overlap starts. Open ends stop at the end of the video's left side.
    """
    size = lambda length: F.greatest(F.lit(0), F.ceil(F.log2(length / bucket_ms))).cast("int")
    a = left.where("e1 > s1").withColumn("_c1", size(F.col("e1") - F.col("s1")))
    of_left = a.groupBy(*keys).agg(F.max("e1").alias("_last"), F.collect_set("_c1").alias("_sizes"))
    b = right.join(of_left, list(keys)).withColumn("_e2", F.coalesce("e2", F.lit(FOREVER))).where("_e2 > s2 and s2 < _last")
    b = b.withColumn("_end", F.least("_e2", "_last")).withColumn("_c2", size(F.col("_end") - F.col("s2")))
    of_right = b.groupBy(*keys).agg(F.collect_set("_c2").alias("_sizes"))

    def placed(rows: DataFrame, own: str, start: str, end: str) -> DataFrame:
        rows = rows.withColumn("_k", F.explode(F.array_union(F.array(own), F.filter("_sizes", lambda k: k > F.col(own))))).drop("_sizes")
        wide = F.lit(bucket_ms) * F.pow(F.lit(2.0), F.col("_k")).cast("bigint")
        return rows.withColumn("_wide", wide).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / F.col("_wide")), F.floor((F.col(end) - 1) / F.col("_wide")))))

    a = placed(a.join(of_right, list(keys)), "_c1", "s1", "e1")
    b = placed(b, "_c2", "s2", "_end").drop("_wide", "_last", "_end")
    both = a.join(b, [*keys, "_k", "_bucket"]).where((F.col("_k") == F.greatest("_c1", "_c2")) & (F.col("s1") < F.col("_e2")) & (F.col("s2") < F.col("e1")))
    both = both.where(F.floor(F.greatest("s1", "s2") / F.col("_wide")) == F.col("_bucket"))
    return both.withColumn("overlap_ms", F.least("e1", "_e2") - F.greatest("s1", "s2")).drop("_bucket", "_e2", "_k", "_wide", "_c1", "_c2")


def attribute(segments: DataFrame, shots: DataFrame, bucket_ms: int, share: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """A segment belongs to each shot that holds it or at least ``share`` of it. segments: s1, e1; shots: s2, e2."""
    both = overlap_join(segments, shots, bucket_ms, keys)
    inside = (F.col("s2") <= F.col("s1")) & (F.col("e1") <= F.col("e2"))
    return both.where(inside | (F.col("overlap_ms") >= share * (F.col("e1") - F.col("s1"))))


def dominant_overlap(shots: DataFrame, runs: DataFrame, bucket_ms: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Run of each shot (s1, e1, seq): largest overlap, earliest on ties; else the latest run that ended by the shot's start; else the first run; -1 without runs. runs: s2, e2, run."""
    w = W.partitionBy(*keys, "seq").orderBy(F.desc("overlap_ms"), "run")
    best = overlap_join(shots, runs, bucket_ms, keys).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "seq", F.col("run").alias("_best"))
    ended = runs.select(*keys, F.col("e2").alias("_t"), F.lit(0).alias("_kind"), F.col("run").alias("_run"))
    both = ended.unionByName(shots.withColumn("_t", F.col("s1")).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    # of the runs that have ended, the one with the largest number
    latest = F.max("_run").over(W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("_ended", latest).where("_kind = 1").join(best, [*keys, "seq"], "left")
    first = runs.groupBy(*keys).agg(F.min("run").alias("_first"))
    return rows.join(first, list(keys), "left").select(*shots.columns, F.coalesce("_best", "_ended", "_first", F.lit(-1)).alias("run"))


def speech_around(boundaries: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS, segment_rows: int | None = None) -> DataFrame:
    """For each boundary b_ms: the last end at or before it, the first start at or after it, whether a segment spans it, and the gap (0 if spanned, null if a side is missing).
    ``segment_rows``: longer videos are scanned by many tasks."""
    ends = segments.select(*keys, F.col("end_ms").alias("_t"), F.lit(0).alias("_kind"), F.col("end_ms").alias("_end"))
    starts = segments.select(*keys, F.col("start_ms").alias("_t"), F.lit(2).alias("_kind"), F.col("start_ms").alias("_start"))
    # started before b and not ended by b: running counts of starts less ends strictly before, ends up to b
    opens = segments.where("end_ms > start_ms").select(*keys, F.col("start_ms").alias("_t"), F.lit(3).alias("_kind"), F.lit(1).alias("_open"))
    closes = segments.where("end_ms > start_ms").select(*keys, F.col("end_ms").alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_open"))
    both = boundaries.withColumn("_t", F.col("b_ms")).withColumn("_kind", F.lit(1))
    for side in (ends, starts, opens, closes):
        both = both.unionByName(side, allowMissingColumns=True)
    folds = {"prev_end": ("last", "_end"), "next_start": ("next", "_start"), "_spanned": ("sum", "_open")}
    rows = running(both, ("_t", "_kind"), folds, keys, segment_rows=segment_rows).withColumn("spans", F.coalesce("_spanned", F.lit(0)) > 0)
    gap = F.when(F.col("spans"), 0).otherwise(F.when(F.col("prev_end").isNotNull() & F.col("next_start").isNotNull(), F.greatest(F.col("next_start") - F.col("prev_end"), F.lit(0))))
    return rows.where("_kind = 1").select(*boundaries.columns, "prev_end", "next_start", "spans", gap.alias("gap_ms"))


def pts_bracket(cuts: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last frame before each cut and first at or after it; cut - 1 and cut where they do not lie inside the shots beside it. cuts: start_ms, cut_ms, end_ms; frames: pts_ms."""
    side = frames.select(*keys, F.col("pts_ms").alias("_t"), F.lit(1).alias("_kind"), F.col("pts_ms").alias("_p"))
    both = cuts.withColumn("_t", F.col("cut_ms")).withColumn("_kind", F.lit(0)).unionByName(side, allowMissingColumns=True)
    order = ("_t", "_kind")
    rows = both.withColumn("_l", _last("_p", keys, order)).withColumn("_r", _last("_p", keys, order, back=False)).where("_kind = 0")
    left = F.when((F.col("_l") >= F.col("start_ms")) & (F.col("_l") < F.col("cut_ms")), F.col("_l")).otherwise(F.col("cut_ms") - 1)
    right = F.when((F.col("_r") >= F.col("cut_ms")) & (F.col("_r") < F.col("end_ms")), F.col("_r")).otherwise(F.col("cut_ms"))
    return rows.select(*cuts.columns, left.alias("left_pts"), right.alias("right_pts"))


def nearest_frames(boundaries: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds before_ms and after_ms to boundaries (boundary_ms): the last frame before and the first at or after each, null where there is none; and indexed: whether the video has frames at all.

    One window over the union of both sides."""
    columns = boundaries.columns
    marks = boundaries.withColumn("_t", F.col("boundary_ms")).withColumn("_p", F.lit(None).cast("bigint"))
    both = marks.unionByName(frames.select(*keys, F.col("pts_ms").alias("_t"), F.col("pts_ms").alias("_p")), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_t", F.col("_p").isNotNull())  # a boundary comes before a frame of the same time
    last = F.last("_p", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("_p", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    rows = both.select("*", last.alias("before_ms"), first.alias("after_ms"), (F.count("_p").over(W.partitionBy(*keys)) > 0).alias("indexed"))
    return rows.where("_p is null").select(*columns, "before_ms", "after_ms", "indexed")


def band_join(left: DataFrame, right: DataFrame, t1: str, t2: str, width: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs with |t1 - t2| <= width: the left side looks into its own bucket and both neighbours."""
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(t1) / width) + d)))
    b = right.withColumn("_bucket", F.floor(F.col(t2) / width))
    return a.join(b, [*keys, "_bucket"]).where(F.abs(F.col(t1) - F.col(t2)) <= width).drop("_bucket")


def band_best(visual: DataFrame, audio: DataFrame, sync: int = 100, window: int = 500, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best audio boundary (score, then order) within the window of each visual one and what it makes of the cut. visual: cut_ms; audio: audio_ms, score, audio_id."""
    w = W.partitionBy(*keys, "cut_ms").orderBy(F.desc("score"), "audio_ms", "audio_id")
    best = band_join(visual.select(*keys, "cut_ms").distinct(), audio, "cut_ms", "audio_ms", window, keys).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    rows = visual.join(best, [*keys, "cut_ms"], "left").withColumn("offset_ms", F.col("audio_ms") - F.col("cut_ms"))
    kind = F.when(F.col("audio_ms").isNull(), "pictureCutAudioContinuous").when(F.abs("offset_ms") <= sync, "synchronizedCut").otherwise("audioBoundaryUndetermined")
    return rows.withColumn("classification", kind)


def band_exists(cuts: DataFrame, audio: DataFrame, tolerance: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether an audio boundary lies within the tolerance of each cut; null where the video has none at all."""
    hit = band_join(cuts.select(*keys, "cut_ms").distinct(), audio.select(*keys, "audio_ms"), "cut_ms", "audio_ms", tolerance, keys).select(*keys, "cut_ms").distinct().withColumn("_hit", F.lit(True))
    any_ = audio.select(*keys).distinct().withColumn("_any", F.lit(True))
    rows = cuts.join(hit, [*keys, "cut_ms"], "left").join(any_, list(keys), "left")
    return rows.withColumn("aligned", F.when(F.col("_any"), F.coalesce("_hit", F.lit(False)))).drop("_hit", "_any")


def nearby_texts(boundaries: DataFrame, segments: DataFrame, radius: int, bucket_ms: int, most: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """First ``most`` non-blank texts of the segments that overlap [b - radius, b + radius)."""
    left = boundaries.select(*keys, "b_ms").distinct().select(*keys, "b_ms", (F.col("b_ms") - radius).alias("s1"), (F.col("b_ms") + radius).alias("e1"))
    right = segments.where(F.trim("text") != "").select(*keys, F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"), "text", "pos")
    w = W.partitionBy(*keys, "b_ms").orderBy("s2", "e2", "pos")
    rows = overlap_join(left, right, bucket_ms, keys).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return rows.groupBy(*keys, "b_ms").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("texts"))


def greedy_match(golden: DataFrame, found: DataFrame, tolerance: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One-to-one matches: golden times ascending, each takes the nearest unused detection within the tolerance, the earlier on ties.

    Decisions reach no further than a chain of times less than the tolerance apart, so only a chain is one group.
    """
    both = golden.select(*keys, F.col("t").cast("long").alias("t"), F.lit(True).alias("golden")).unionByName(found.select(*keys, F.col("t").cast("long").alias("t"), F.lit(False).alias("golden")))
    opens = F.coalesce(F.col("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("t")) > tolerance, F.lit(True))
    both = number_chains(both, opens, "t", keys)
    both = both.withColumn("_mixed", F.size(F.collect_set("golden").over(W.partitionBy(*keys, "chain"))) > 1).where("_mixed").drop("_mixed")
    matched = decide(both, keys, ["t", "golden"], ["t", "golden"], match_rule(tolerance), "found_t", "bigint")
    return matched.where("golden and found_t is not null").select(*keys, F.col("t").alias("golden_t"), "found_t")


def match_rule(tolerance: int):
    """Rule: for each golden time in order the nearest unused detection within the tolerance."""

    def rule(times: list, golden: list) -> list:
        free, out = [t for t, g in zip(times, golden) if not g], []  # times are in order
        for t, g in zip(times, golden):
            at = bisect_left(free, t)
            near = min((abs(free[k] - t), free[k], k) for k in (at - 1, at) if 0 <= k < len(free)) if g and free else None
            out.append(near[1] if near and near[0] <= tolerance else None)
            if out[-1] is not None:
                del free[near[2]]
        return out

    return rule


def adjacent_pairs(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Each row with the next one of its video: left_x and right_x of the columns."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = df.select(*keys, *[F.col(c).alias(f"left_{c}") for c in columns], *[F.lead(c).over(w).alias(f"right_{c}") for c in columns], F.lead(order).over(w).alias("_next"))
    return rows.where("_next is not null").drop("_next")


def whitelist_merge(scaffold: DataFrame, model: DataFrame, allowed: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Scaffold rows with the model's non-null values in the allowed columns only."""
    given = model.select(*keys, *[F.col(c).alias(f"_{c}") for c in allowed])
    rows = scaffold.join(given, list(keys), "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in allowed else c for c in scaffold.columns])


def merge_parts(rows: DataFrame, part: str, wanted: Sequence[str], maps: str, keys: Sequence[str]) -> DataFrame:
    """Keys that have all wanted parts, with the parts' maps of the column ``maps`` merged: one shuffle for any number of parts. rows: keys, part (each once a key), maps."""
    entries = F.flatten(F.collect_list(F.map_entries(maps)))
    merged = rows.where(F.col(part).isin(list(wanted))).groupBy(*keys).agg(F.countDistinct(part).alias("_n"), F.map_from_entries(entries).alias(maps))
    return merged.where(F.col("_n") == len(wanted)).drop("_n")


def boundary_sides(shots: DataFrame, cuts: DataFrame, has_audio: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two rows a shot. cuts: cut_ms, classification; inner sides are ``unavailable`` where has_audio is false."""
    w = W.partitionBy(*keys).orderBy("seq")
    rows = shots.withColumn("_last", F.lead("seq").over(w).isNull())
    inner = F.when(has_audio, F.col("classification")).otherwise("unavailable")
    side = F.explode(F.array(
        F.struct(F.lit("in").alias("side"), F.col("start_ms").alias("cut_ms"), F.when(F.col("seq") == 1, "sourceStart").alias("fixed")),
        F.struct(F.lit("out").alias("side"), F.col("end_ms").alias("cut_ms"), F.when(F.col("_last"), "sourceEnd").alias("fixed"))))
    rows = rows.select(*keys, "seq", side.alias("x")).select(*keys, "seq", "x.*").join(cuts, [*keys, "cut_ms"], "left")
    return rows.select(*keys, "seq", "side", F.col("cut_ms").alias("visual_ms"), F.coalesce("fixed", inner).alias("classification"))
