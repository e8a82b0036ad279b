"""Rollups per shot, block, slot and video. Ratios clamp to 0..1 and have four places, seconds three."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .islands import clip, union_length
from .quantiles import exact_percentiles
from .scan import SEGMENT_ROWS

KEYS = ("video",)


def ratio(part: Column, whole: Column) -> Column:
    """Clamped share with four places; 0 where the whole is not positive."""
    return F.round(F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))).otherwise(0.0), 4)


def seconds(ms: str | Column) -> Column:
    return F.round((F.col(ms) if isinstance(ms, str) else ms) / 1000, 3)


def by_shot(shots: DataFrame, hits: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """median, least, most and n of a value for every shot; null and 0 for shots without rows."""
    g = hits.where(F.col("seq").isNotNull()).groupBy(*keys).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))
    return shots.select(*keys).join(g, list(keys), "left").fillna(0, ["n"])


def distribution(df: DataFrame, value: str, keys: Sequence[str] = KEYS, excluded: Sequence[str] = ("unknown", "unmapped")) -> DataFrame:
    """Share of each known value among the known ones."""
    rows = df.where(F.col(value).isNotNull() & ~F.col(value).isin(list(excluded))).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*keys)), 4))


def duration_stats(df: DataFrame, duration: str, keys: Sequence[str] = KEYS, hot_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mean and median seconds; the tenth and ninetieth percentile from five rows on. A key of more than ``hot_rows`` rows is spread over many tasks."""
    whole = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(duration).alias("_m"))
    ranks = exact_percentiles(df, duration, (0.1, 0.5, 0.9), keys, "_p", hot_rows).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    rows = whole.join(ranks, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], "left")
    many = F.col("n") >= 5
    return rows.select(*keys, "n", seconds("_m").alias("mean_sec"), seconds(F.col("_p")[1]).alias("p50_sec"), F.when(many, seconds(F.col("_p")[0])).alias("p10_sec"), F.when(many, seconds(F.col("_p")[2])).alias("p90_sec"))


def coverage(df: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of each range that the union of its intervals covers; 0 without intervals."""
    inside = clip(df.select(*keys, "start_ms", "end_ms").join(ranges, list(keys)), "range_start", "range_end")
    rows = ranges.join(union_length(inside, keys), list(keys), "left")
    return rows.select(*keys, ratio(F.coalesce("union_ms", F.lit(0)), F.col("range_end") - F.col("range_start")).alias("coverage"))


def extent_coverage(df: DataFrame, head: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of each video's own extent, less ``head`` at its start, that its intervals cover; videos no longer than that are left out. Extent, running end and sum share one shuffle by video."""
    whole = W.partitionBy(*keys)
    rows = df.select(*keys, "start_ms", "end_ms", (F.min("start_ms").over(whole) + head).alias("_a"), F.max("end_ms").over(whole).alias("_b")).where("_b > _a")
    rows = rows.withColumn("_s", F.greatest("start_ms", "_a")).withColumn("_e", F.least("end_ms", "_b"))
    before = F.max(F.when(F.col("_e") > F.col("_s"), F.col("_e"))).over(whole.orderBy("_s", "_e").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("_e") - F.greatest("_s", F.coalesce("_before", "_s")))
    return rows.withColumn("_before", before).groupBy(*keys).agg(F.sum(new).alias("_u"), F.first("_a").alias("_a"), F.first("_b").alias("_b")).select(*keys, ratio(F.col("_u"), F.col("_b") - F.col("_a")).alias("coverage"))


def modal(df: DataFrame, value: str, position: Sequence[str], keys: Sequence[str] = KEYS, excluded: Sequence[str] = ("unknown",)) -> DataFrame:
    """Most frequent known value; the one seen first on ties."""
    rows = df.where(F.col(value).isNotNull() & ~F.col(value).isin(list(excluded))).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("_first"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_first")


def joined_text(df: DataFrame, text: str, order: Sequence[str], keys: Sequence[str] = KEYS, separator: str = " ") -> DataFrame:
    """Trimmed non-blank texts in order."""
    rows = df.where(F.trim(F.col(text)) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.trim(F.col(text)).alias("_text")))).alias("_l"))
    return rows.select(*keys, F.array_join(F.transform("_l", lambda x: x["_text"]), separator).alias("text"))


def status_rollup(df: DataFrame, status: str, keys: Sequence[str] = KEYS, complete: str = "complete") -> DataFrame:
    """complete, partial or failed: all rows complete, some, or none."""
    done = F.col(status) == complete
    rows = df.groupBy(*keys).agg(F.bool_and(done).alias("_all"), F.bool_or(done).alias("_any"))
    return rows.select(*keys, F.when(F.col("_all"), "complete").when(F.col("_any"), "partial").otherwise("failed").alias("status"))


def recall_precision(golden: DataFrame, found: DataFrame, matched: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """hits, missed, false positives, recall and precision (1 for an empty side) per video."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    rows = count(golden, "g").join(count(found, "f"), list(keys), "full").join(count(matched, "hits"), list(keys), "left").fillna(0)
    one = lambda d: F.when(F.col(d) == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col(d))
    return rows.select(*keys, "hits", (F.col("g") - F.col("hits")).alias("missed"), (F.col("f") - F.col("hits")).alias("false_positives"), one("g").alias("recall"), one("f").alias("precision"))


def flags(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def seam_alignment(slots: DataFrame, seams: DataFrame, least: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the share of synchronised seams among the decidable ones reaches ``least``: true without seams, false if none is decidable. seams: keys, classification."""
    known = F.col("classification") != "unavailable"
    g = seams.groupBy(*keys).agg(F.avg(F.when(known, (F.col("classification") == "synchronizedCut").cast("int"))).alias("_share"), F.lit(True).alias("_seams"))
    return slots.join(g, list(keys), "left").select(*keys, F.when(F.col("_seams").isNull(), True).when(F.col("_share").isNull(), False).otherwise(F.col("_share") >= least).alias("aligned"))


def pair_metric_rows(pairs: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """keys, left, right, metric, value (text), status, unit, refs: seven rows an adjacent pair, whatever is missing.

    pairs: left, right (their places from 0 are left_at, right_at), luma, db, move and music of both sides (left_luma, right_luma and so on), aligned (null without audio boundaries), gap_ms and spans (null without speech),
    left_frame and right_frame (files of the two frames at the boundary, null where there is none: they are the evidence of the luma difference, also of one that could not be measured)."""
    c = F.col
    at = lambda doc: F.array(F.concat(F.lit(f"raw/{doc}.json#shots["), c("left_at").cast("string"), F.lit("]")), F.concat(F.lit(f"raw/{doc}.json#shots["), c("right_at").cast("string"), F.lit("]")))
    none = F.array().cast("array<string>")
    side = lambda name: F.concat(F.coalesce(f"left_{name}", F.lit("-")), F.lit(" > "), F.coalesce(f"right_{name}", F.lit("-")))
    some = lambda name: c(f"left_{name}").isNotNull() | c(f"right_{name}").isNotNull()
    delta = lambda name, places: F.format_string(f"%.{places}f", F.round((c(f"right_{name}") - c(f"left_{name}")).cast("double"), places))

    def cell(name: str, there: Column, value: Column, refs: Column, unit: str | None = None, lacking: str = "unknown", lacking_refs: Column = none) -> Column:
        there = F.coalesce(there, F.lit(False))
        return F.struct(F.lit(name).alias("metric"), F.when(there, value.cast("string")).alias("value"), F.when(there, "value").otherwise(lacking).alias("status"), F.lit(unit).alias("unit"), F.when(there, refs).otherwise(lacking_refs).alias("refs"))

    both = lambda name: c(f"left_{name}").isNotNull() & c(f"right_{name}").isNotNull()
    one = lambda ref: F.array(F.lit(ref))
    frames = F.array_compact(F.array("left_frame", "right_frame"))
    cells = F.array(
        cell("lumaDelta", both("luma"), delta("luma", 3), frames, None, "unavailable", frames), cell("audioLevelDeltaDb", both("db"), delta("db", 2), at("audio-energy"), "dB"),
        cell("cameraMotionChange", some("move"), side("move"), at("camera-motion")), cell("audioCutAligned", c("aligned").isNotNull(), c("aligned"), one("raw/audio-cuts.json#boundaries")),
        cell("speechGapMs", c("gap_ms").isNotNull(), c("gap_ms"), one("raw/asr.json#segments"), "ms"), cell("speechSpansBoundary", c("spans").isNotNull(), c("spans"), one("raw/asr.json#segments")),
        cell("musicContinuity", some("music"), side("music"), at("music-flags")))
    return pairs.select(*keys, "left", "right", F.explode(cells).alias("m")).select(*keys, "left", "right", "m.*")


def golden_gate(scores: DataFrame, limits: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Adds passed: recall and precision against each video's own least_recall and least_precision; a video without limits passes."""
    rows = scores.join(limits, list(keys), "left")
    fine = (F.col("recall") >= F.coalesce("least_recall", F.lit(0.0))) & (F.col("precision") >= F.coalesce("least_precision", F.lit(0.0)))
    return rows.withColumn("passed", fine)


def pair_view(metrics: DataFrame, boundaries: DataFrame, semantics: DataFrame, frames: DataFrame, frame_ms: int, names: Sequence[str], keys: Sequence[str] = ("video",)) -> DataFrame:
    """Long metrics as one row a pair, with how many lack a value, the pair's semantics (unknown where none) and the frames beside its boundary.

    boundaries: keys, left, boundary_ms; semantics: keys, left, semantics; frames: keys, pts_ms. A video without a frame index has its frames at the average rate: one ``frame_ms`` before the boundary and at it."""
    from .joins import nearest_frames

    on = [*keys, "left"]
    lacking = metrics.groupBy(*on, "right").agg(F.count_if(F.col("status") != "value").alias("n_lacking"))
    wide = metrics.groupBy(*on, "right").pivot("metric", list(names)).agg(F.first("value"))
    near = nearest_frames(boundaries, frames, keys)
    rows = wide.join(lacking, [*on, "right"]).join(semantics, on, "left").join(near, on)
    rows = rows.withColumn("semantics", F.coalesce("semantics", F.lit("unknown"))).withColumn("status", F.when(F.col("n_lacking") == 0, "complete").otherwise("partial"))
    rows = rows.withColumn("frame_source", F.when(F.col("indexed"), "pts").otherwise("average-rate"))
    return rows.withColumn("left_frame_ms", F.coalesce("before_ms", F.col("boundary_ms") - frame_ms)).withColumn("right_frame_ms", F.coalesce("after_ms", "boundary_ms")).drop("indexed", "before_ms", "after_ms")


def review_kpis(shots: DataFrame, motion: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """One row of counts a video. shots: needs_review, duration_ms, music (state), flagged, status (of the model); motion: one row a candidate."""
    rows = shots.groupBy(*keys).agg(
        F.count("*").alias("n_shots"), F.count_if("needs_review").alias("n_review"), F.sum("duration_ms").alias("total_ms"), F.count_if(F.col("music") == "music").alias("n_music"), F.count_if(F.col("music") == "unknown").alias("n_unknown"), F.count_if("flagged").alias("n_flagged"),
        F.when(F.bool_and(F.col("status") == "complete"), "complete").when(F.bool_or(F.col("status") == "complete"), "partial").otherwise("failed").alias("status"))
    return rows.join(motion.groupBy(*keys).agg(F.count("*").alias("n_motion")), list(keys), "left").fillna(0, ["n_motion"])
