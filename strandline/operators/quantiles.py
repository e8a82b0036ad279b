"""Exact percentiles of keys that may hold a large share of all rows.

The built-in percentile keeps every distinct value of a key in one task. Here keys of more than ``hot_rows`` rows take another way, selection by narrowing bins: counts of bins of equal ratio,
combined before the shuffle, tell which bin holds each rank that is asked for; that bin, from its least to its largest value, is cut into equal bins, and so on until a bin is one value.
A double has 2**48.5 values in a bin of the first level at most, and three times 2**17 bins tell them apart. So four passes give the exact value, and a task sees at most some 2**17 counts a bin.
(A sketch would bracket a rank in one pass, but sketches are drawn at random: a task that is run again after a lost executor could tell another bracket.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import SEGMENT_ROWS

#: Bins for each doubling of a value at the first level, and equal bins at each of the three levels below.
RATIO_BINS, EQUAL_BINS = 16, 1 << 17


def _meet(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Join by keys where null equals null."""
    named = side.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [rows[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]
    return rows.join(named, on if also is None else [*on, also], how).drop(*(f"_of_{k}" for k in keys))


def _ratio_bin(v: Column) -> Column:
    """A whole number that never falls as v grows; infinities and NaN have bins of their own, outside all others."""
    size = F.floor(F.log2(F.abs(v)) * RATIO_BINS) + 1100 * RATIO_BINS
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 1 << 20).when(v == float("inf"), 1 << 19).when(v == float("-inf"), -(1 << 19)).otherwise(finite).cast("int")


def _of_hot(rows: DataFrame, shares: Sequence[float], keys: Sequence[str], name: str) -> DataFrame:
    """keys, ``name`` for rows (keys, _v: no nulls)."""
    counts = (F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = lambda p: F.lit(float(p)) * (F.col("_n") - 1)
    held = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))
    bins = rows.groupBy(*keys, _ratio_bin(F.col("_v")).alias("_d")).agg(*counts)
    w = W.partitionBy(*keys)
    bins = bins.withColumns({"_n": F.sum("_c").over(w), "_upto": F.sum("_c").over(w.orderBy("_d"))})
    bins = bins.withColumn("_ranks", F.array_distinct(F.array(*(f(at(p)) for p in shares for f in (F.floor, F.ceil)))))
    for level in range(4):
        bins = bins.withColumn("_ranks", held).where(F.size("_ranks") > 0)
        if level == 3:
            break
        bins = bins.select(*keys, "_n", "_ranks", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), (F.col("_upto") - F.col("_c")).alias("_skip"))
        inside = _meet(rows, bins, keys, also=(F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b")))
        cell = F.when(F.col("_a") < F.col("_b"), F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (EQUAL_BINS - 1))).otherwise(0)
        place = [*keys, "_n", "_a", "_b", "_skip", "_ranks"]
        bins = inside.groupBy(*place, cell.cast("int").alias("_d")).agg(*counts)
        bins = bins.withColumn("_upto", F.col("_skip") + F.sum("_c").over(W.partitionBy(*place).orderBy("_d")))
    found = bins.select(*keys, "_n", "_lo", F.explode("_ranks").alias("_r")).groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_m"))  # two entries a share at most

    def between(p: float) -> Column:
        pos = at(p)
        a, b = F.col("_m")[F.floor(pos)], F.col("_m")[F.ceil(pos)]
        return F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)

    return found.select(*keys, F.array(*map(between, shares)).alias(name))


def exact_percentiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str], name: str = "percentiles", hot_rows: int = SEGMENT_ROWS) -> DataFrame:
    """keys, ``name``: the percentiles of a numeric column at ``shares``, with linear interpolation, in the order given; null for a key without values.

    A task holds the values of one key up to ``hot_rows`` of them. One count of the keys, at once, says whether any has more; if none has, the four passes are left out. Nulls are left out; NaN is larger than all numbers; a null key is a key; a table without rows gives none."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    plain = lambda part: part.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(name))
    some = rows.where("_v is not null")
    hot = some.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n")
    if hot.isEmpty():
        return plain(rows)
    return plain(_meet(rows, hot, keys, "left_anti")).unionByName(_of_hot(_meet(some, hot, keys), shares, keys, name))
