"""Streams read in several batches, with a restart between them and a restart without new data, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import islands as I
from strandline.operators import signal as G
from strandline.streaming import modes as M

EVENTS = "video long, time_ms long, id long, value double, kind string"


class Feed:
    """A folder of files that a stream reads one at a time."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.files = spark, str(path), schema, 0

    def add(self, rows):
        self.files += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def events(seed, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(4), rnd.randrange(0, 40_000_000), seed * 1000 + i, float(rnd.randrange(100)), rnd.choice("abc")) for i in range(n)]


@pytest.fixture
def feed(spark, tmp_path):
    out = Feed(spark, tmp_path / "in", EVENTS)
    out.add(events(1, 80))
    out.add(events(2, 80))
    return out


def check(feed, run, want):
    """Two files; a restart with a third; a restart with nothing new."""
    assert rows_of(run()) == rows_of(want())
    feed.add(events(3, 60))
    assert rows_of(run()) == rows_of(want())
    assert rows_of(run()) == rows_of(want())


def test_tally(feed, tmp_path):
    day = 86_400_000
    want = lambda: feed.batch().groupBy("video", (F.floor(F.col("time_ms") / day) * day).alias("window_ms"), "kind").agg(F.count("*").alias("n"))
    check(feed, lambda: M.finish(M.windowed_tally(feed.stream(), "kind", "1 day"), str(tmp_path / "out")), want)


def test_runs(feed, tmp_path):
    segments = lambda df: df.select("video", F.col("id").alias("pos"), F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 60_000).alias("end_ms"))
    want = lambda: I.speech_runs(segments(feed.batch()), 900_000).select("video", "start_ms", "end_ms", "n")
    check(feed, lambda: M.finish(M.speech_runs(segments(feed.stream()), 900_000, "20 hours"), str(tmp_path / "out")), want)


def test_latest_wins(feed, tmp_path):
    def want():
        last = feed.batch().groupBy("video", "kind").agg(F.max(F.struct("time_ms", "id", "value")).alias("l"))
        return last.select("video", "kind", "l.*")

    check(feed, lambda: M.upsert_latest(feed.stream(), ["video", "kind"], ["time_ms", "id"], "value", str(tmp_path / "out")), want)


def test_latest_wins_keeps_what_a_later_run_does_not_mention(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    run = lambda: rows_of(M.upsert_latest(feed.stream(), ["kind"], ["time_ms"], "value", str(tmp_path / "out")))
    feed.add([(1, 5, 1, 1.0, "a"), (1, 6, 2, 2.0, "b")])
    assert run() == [("a", 5, 1.0), ("b", 6, 2.0)]
    feed.add([(1, 9, 3, 3.0, "a"), (1, 2, 4, 9.0, "b")])
    assert run() == [("a", 9, 3.0), ("b", 6, 2.0)]
    assert run() == [("a", 9, 3.0), ("b", 6, 2.0)]


def test_peaks_of_late_frames(feed, tmp_path):
    """Files overlap in time, so frames of the second come before some of the first; the watermark waits long enough."""

    def want():
        df = feed.batch()
        seen = df.where(F.col("time_ms") < df.agg(F.max("time_ms") - 50_000_000).scalar()) if late else df.limit(0)
        peaks = G.local_peaks(seen.withColumn("i", F.struct("time_ms", "id")), 40)
        last = seen.groupBy("video").agg(F.max(F.struct("time_ms", "id")).alias("last"))
        return peaks.join(last, "video").where(F.col("i") < F.col("last")).select("video", "time_ms", "id", "value")

    late = False
    run = lambda: M.finish_append(M.local_peaks(feed.stream(), 40, "50000 seconds"), str(tmp_path / "out"))
    assert rows_of(run()) == rows_of(want())  # nothing has passed the watermark
    feed.add([(v, 90_000_000, 5000 + v, 0.0, "a") for v in range(4)])
    late = True
    assert rows_of(run()) == rows_of(want())
    assert rows_of(run()) == rows_of(want())


def test_chains_close_at_the_watermark(feed, tmp_path):
    """Several batches, a late file, a restart: what closed chains keep is what the batch operator keeps of them."""
    step, seconds = 900_000, 2000

    def want():
        df = feed.batch()
        mark = df.agg(F.max("time_ms")).first()[0] - seconds * 1000
        rows = sorted((r.video, r.time_ms, r.id, r.value) for r in df.collect() if r.time_ms < mark)
        out = []
        for v in range(4):
            own, chains = [r for r in rows if r[0] == v], []
            for r in own:
                if chains and r[1] - chains[-1][-1][1] < step:
                    chains[-1].append(r)
                else:
                    chains.append([r])
            for chain in (c for c in chains if c[-1][1] + step <= mark):
                kept = []
                for r in sorted(chain, key=lambda r: (-r[3], r[1])):
                    if all(abs(r[1] - k[1]) >= step for k in kept):
                        kept.append(r)
                out += kept
        return sorted(out)

    progress = []
    run = lambda: rows_of(M.finish_append(M.suppress_close(feed.stream(), step, f"{seconds} seconds"), str(tmp_path / "out"), progress))
    ordered = Feed(feed.spark, tmp_path / "ordered", EVENTS)
    feed = ordered
    rows = sorted(events(7, 300), key=lambda r: r[1])
    late = [r for r in rows[:200] if rows[199][1] - seconds * 1000 < r[1]][::2]  # their file comes after later ones, within the delay
    feed.add(rows[:140])
    feed.add([r for r in rows[140:200] if r not in late])
    feed.add([r for r in late if r in rows[140:200]])
    got = run()
    assert got == want() and late
    feed.add(rows[200:])
    more = run()
    assert set(got) <= set(more) and more == want()
    assert run() == more
    assert max(p["rows"] for p in progress) <= 4  # a row a video


def test_novelty_of_a_stream_equals_the_batch(spark, tmp_path):
    feed, half = Feed(spark, tmp_path / "in", EVENTS), 6
    rows = sorted(events(5, 400), key=lambda r: (r[1], r[2]))
    run = lambda: rows_of(M.finish_append(M.novelty(feed.stream(), {"value": (2.0, 0.5)}, half, "3000 seconds"), str(tmp_path / "out")))

    def want():
        mark = feed.batch().agg(F.max("time_ms")).first()[0] - 3_000_000
        seen = [r for r in rows[: feed.given] if r[1] < mark]
        order = [(r[0], r[1], r[2], i, r[3]) for v in range(4) for i, r in enumerate([r for r in seen if r[0] == v])]
        whole = G.novelty(spark.createDataFrame(order, "video long, time_ms long, id long, i long, value double"), {"value": (2.0, 0.5)}, half)
        last = {v: sum(r[0] == v for r in seen) - half for v in range(4)}
        return sorted((r.video, r.time_ms, r.id, r.novelty) for r in whole.collect() if r.i < last[r.video])

    def same(a, b):
        assert [x[:3] for x in a] == [x[:3] for x in b]
        assert all((x[3] != x[3] or x[3] is None) == (y[3] is None) and (y[3] is None or x[3] == pytest.approx(y[3])) for x, y in zip(a, b))

    for a, b in ((0, 150), (150, 220), (220, 400)):
        feed.add(rows[a:b])
        feed.given = b
        if b != 150:
            same(run(), want())
    same(run(), want())


def test_closed_runs_and_windows_leave_the_state(spark, tmp_path):
    feed, day = Feed(spark, tmp_path / "in", EVENTS), 86_400_000
    rows = sorted([(v, t * 3_600_000 + v, 1000 * v + t, 1.0, "a") for v in range(3) for t in range(0, 24 * 12, 5)], key=lambda r: r[1])
    segments = lambda: feed.stream().select("video", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 60_000).alias("end_ms"))
    runs, windows = [], []
    for k in range(4):
        feed.add(rows[k * 44 : (k + 1) * 44])
        got = rows_of(M.finish_append(M.speech_runs(segments(), 3_600_000), str(tmp_path / "runs"), runs))
        tally = rows_of(M.finish_append(M.windowed_tally(feed.stream(), "kind", "1 day"), str(tmp_path / "tally"), windows))
    mark = rows[-1][1] - 3_600_000
    batch = I.speech_runs(feed.batch().select("video", F.col("id").alias("pos"), F.col("time_ms").alias("start_ms"), (F.col("time_ms") + 60_000).alias("end_ms")), 3_600_000)
    assert got == sorted((r.video, r.start_ms, r.end_ms, r.n) for r in batch.collect() if r.end_ms + 3_600_000 - 1 <= mark)
    want = feed.batch().groupBy("video", (F.floor(F.col("time_ms") / day) * day).alias("window_ms"), "kind").agg(F.count("*").alias("n"))
    assert tally == [r for r in rows_of(want) if r[1] + day <= mark]
    for told in (runs, windows):  # the state holds what is open, not all that came
        assert sum(p["removed"] for p in told) > 20 and told[-1]["rows"] <= 9 and max(p["rows"] for p in told) < 60


def test_runs_are_merged_and_repeats_change_nothing(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("_l", T.LongType())])
    latest = lambda rows: rows.groupBy("k").agg(F.max("_l").alias("_l"))
    spark.createDataFrame([(-1, "[]")], "epoch bigint, runs string").coalesce(1).write.parquet(f"{tmp_path}/pointers/at=-1")
    runs = M.Runs(spark, str(tmp_path), schema, latest)
    for epoch in range(11):
        batch = spark.createDataFrame([(epoch % 3, epoch), (100 + epoch, epoch)], schema)
        for _ in range(2):  # every epoch is run twice
            runs.add(batch, epoch)
        assert len(runs._live()) <= 2 * (M.FAN - 1)
    assert rows_of(runs.read()) == sorted([(0, 9), (1, 10), (2, 8)] + [(100 + e, e) for e in range(11)])
