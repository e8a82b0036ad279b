"""Segmented scans and sliding medians: equal to plain windows, on one long video over many tasks too."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import islands as I
from strandline.operators import joins as J
from strandline.operators import signal as G
from strandline.operators.scan import running, segmented


def intervals(spark, n=3000):
    rnd, rows = random.Random(5), []
    for i in range(n):  # one long video, with a few very long intervals, some short videos, a video without a name
        video = 1 if i % 10 else rnd.choice([2, 3, None])
        start = rnd.randrange(0, 400_000, 50)
        rows.append((video, start, start + rnd.choice([0, 20, 60, 200, 200, 30_000 if i % 500 == 0 else 90]), i))
    return spark.createDataFrame(rows, "video long, start_ms long, end_ms long, pos long").repartition(6)


def sets(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("segment_rows", [1, 25, 100_000])
def test_islands_of_segments(spark, segment_rows):
    df = intervals(spark)
    assert sets(I.merge_intervals(df, 30)) == sets(I.merge_intervals(df, 30, segment_rows=segment_rows))
    assert sets(I.union_length(df)) == sets(I.union_length(df, segment_rows=segment_rows))
    a, b = I.speech_runs(df, 40), I.speech_runs(df, 40, segment_rows=segment_rows).select("video", "run", "start_ms", "end_ms", "n")
    assert sets(a.select(*b.columns)) == sets(b)
    assert I.merge_intervals(df.limit(0), segment_rows=segment_rows).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_of_segments(spark, inclusive):
    df = intervals(spark).withColumn("odd", F.when(F.col("pos") % 7 == 0, F.col("pos")))
    folds = {"far": ("max", "end_ms"), "n": ("sum", F.lit(1)), "back": ("last", "odd"), "ahead": ("next", "odd")}
    plain, cut = (running(df, ("start_ms", "end_ms", "pos"), folds, inclusive=inclusive, segment_rows=k) for k in (None, 20))
    assert sets(plain) == sets(cut)


def test_asof_of_segments(spark):
    df = intervals(spark)
    bounds = df.select("video", F.col("start_ms").alias("b_ms")).distinct()
    assert sets(J.speech_around(bounds, df.drop("pos"))) == sets(J.speech_around(bounds, df.drop("pos"), segment_rows=30))


def test_a_long_video_lies_in_many_segments(spark):
    sizes = [r.n for r in segmented(intervals(spark), "start_ms", segment_rows=100).where("video = 1").groupBy("_seg").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 25 and max(sizes) < 400
    # the plan windows by segment, never a whole video's rows
    plan = running(intervals(spark), ("start_ms",), {"far": ("max", "end_ms")}, segment_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_seg#" in w.split("windowspec")[0] or "[video#" in w for w in windows) == 2


@pytest.mark.parametrize("segment_rows", [None, 60])
def test_sliding_medians(spark, segment_rows):
    rnd = random.Random(3)
    signal = {1: [rnd.choice([0.0, 1.0, rnd.random() * 9]) for _ in range(700)], 2: [5.0], 3: [None, 1.0, None, 3.0, 2.0]}
    rows = [(v, i + 1, x) for v, xs in signal.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "video long, i long, value double").repartition(3)
    got = {(r.video, r.i): r.novelty for r in G.novelty(df, {"value": (2.0, 0.5)}, half=9, piece_rows=40, segment_rows=segment_rows).collect()}
    assert len(got) == len(rows)
    for v, xs in signal.items():
        change = [None if not i or xs[i] is None or xs[i - 1] is None else abs(xs[i] - xs[i - 1]) for i in range(len(xs))]
        for i, c in enumerate(change):
            near = [x for x in change[max(0, i - 9) : i + 10] if x is not None]
            expected = None if c is None else 2.0 * c / max(0.5, statistics.median(near))
            assert got[v, i + 1] == (None if expected is None else pytest.approx(expected)), (v, i)
