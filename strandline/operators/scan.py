"""Prefix scans over one long timeline on many tasks.

A window over a video is one task, however long the video. Here a video of more than ``segment_rows`` rows is cut into segments of equal time, each segment is scanned by itself, and
takes up what all segments before it hand on: the largest end, the sum, the last value. These carries come from one aggregate a segment (combined before the shuffle) and a
window over segments, not rows. Shorter videos are one segment, as with a plain window.

Time must be the first column of the order (equal times stay in one segment). Rows with null keys or times belong to the first segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ("video",)
#: Rows of a video that one task may scan.
SEGMENT_ROWS = 1_000_000


def segmented(df: DataFrame, time: str, keys: Sequence[str] = KEYS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds _seg, which never falls with time."""
    long = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(time).alias("_low"), F.max(time).alias("_high")).where(F.col("_n") > segment_rows)
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") / segment_rows))
    rows = df.join(long.select(*keys, "_low", width.alias("_width")), list(keys), "left")
    return rows.withColumn("_seg", F.coalesce(F.floor((F.col(time) - F.col("_low")) / F.col("_width")), F.lit(0))).drop("_low", "_width")


def running(df: DataFrame, order: Sequence[str], folds: Mapping[str, tuple[str, str | Column]], keys: Sequence[str] = KEYS, inclusive: bool = True, segment_rows: int | None = None) -> DataFrame:
    """Adds running values by ``keys`` in ``order`` (names, ascending). folds: name -> (kind, value); kinds: max, sum, last and next (the nearest value that is not null, backward or forward).

    Without ``inclusive`` a row's own value is left out. Without ``segment_rows`` a video is one window."""
    near = -1 if not inclusive else 0
    values = {name: F.col(c) if isinstance(c, str) else c for name, (_, c) in folds.items()}

    def over(w, back) -> dict[str, Column]:
        frames = {"next": w.rowsBetween(-near, W.unboundedFollowing)}
        how = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.first(c, ignorenulls=True)}
        return {name: how[kind](back(name)).over(frames.get(kind, w.rowsBetween(W.unboundedPreceding, near))) for name, (kind, _) in folds.items()}

    if segment_rows is None:
        return df.withColumns(over(W.partitionBy(*keys).orderBy(*order), values.get))
    rows = segmented(df, order[0], keys, segment_rows)
    at = lambda name: F.when(values[name].isNotNull(), F.struct(*order, values[name].alias("_v")))
    whole = {"max": lambda n: F.max(values[n]), "sum": lambda n: F.sum(values[n]), "last": lambda n: F.max(at(n))["_v"], "next": lambda n: F.min(at(n))["_v"]}
    totals = rows.groupBy(*keys, "_seg").agg(*(whole[kind](name).alias(f"_of_{name}") for name, (kind, _) in folds.items()))
    w = W.partitionBy(*keys).orderBy("_seg")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    handed = {"max": lambda c: F.max(c).over(before), "sum": lambda c: F.sum(c).over(before), "last": lambda c: F.last(c, ignorenulls=True).over(before), "next": lambda c: F.first(c, ignorenulls=True).over(after)}
    carries = totals.select(*keys, "_seg", *(handed[kind](f"_of_{name}").alias(f"_to_{name}") for name, (kind, _) in folds.items()))
    own = over(W.partitionBy(*keys, "_seg").orderBy(*order), values.get)
    joined = rows.join(carries, [*keys, "_seg"], "left").withColumns(own)
    meet = {
        "max": lambda n: F.greatest(n, f"_to_{n}"), "last": lambda n: F.coalesce(n, f"_to_{n}"), "next": lambda n: F.coalesce(n, f"_to_{n}"),
        "sum": lambda n: F.when(F.col(n).isNull(), F.col(f"_to_{n}")).otherwise(F.col(n) + F.coalesce(f"_to_{n}", F.lit(0))),
    }
    return joined.select(*df.columns, *(meet[kind](name).alias(name) for name, (kind, _) in folds.items()))


def merged(df: DataFrame, opens, order: Sequence[str], keys: Sequence[str] = KEYS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Islands of intervals (start_ms, end_ms): start_ms, end_ms, n and island (from 1 in each video). ``opens``: whether a row opens an island, of the largest end before it (null: none).

    Islands inside a segment are done where they lie; the first and last of each segment meet those of the segments beside it, two rows a segment."""
    rows = segmented(df, order[0], keys, segment_rows)
    by_segment, place = W.partitionBy(*keys).orderBy("_seg"), [*keys, "_seg"]
    ends = rows.groupBy(*place).agg(F.max("end_ms").alias("_end")).withColumn("_handed", F.max("_end").over(by_segment.rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    w = W.partitionBy(*place).orderBy(*order)
    local = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.join(ends, place, "left").withColumn("_before", F.greatest(local, F.col("_handed")))
    rows = rows.withColumn("_k", F.sum(F.coalesce(opens(F.col("_before")), F.lit(True)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy(*place, "_k").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    parts = parts.withColumn("_opened", F.max("_k").over(W.partitionBy(*place)))
    # islands that earlier segments opened
    opened = parts.groupBy(*place).agg(F.max("_opened").alias("_o")).withColumn("_earlier", F.coalesce(F.sum("_o").over(by_segment.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_o")
    parts = parts.join(opened, place, "left").withColumn("island", F.coalesce("_earlier", F.lit(0)) + F.col("_k"))
    edge = (F.col("_k") == 0) | (F.col("_k") == F.col("_opened"))
    inner = parts.where(~edge).select(*keys, "island", "start_ms", "end_ms", "n")
    torn = parts.where(edge).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n"))
    return inner.unionByName(torn)
