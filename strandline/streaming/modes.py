"""Streaming forms of batch operators. Each gives the batch operator's result over what the watermark has passed, or over all once the stream has been read.

Operators that emit at the watermark keep in their state what later rows can still change, and no more: open sessions and windows, chains that are not closed, the reach of a window.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.signal import keep_apart

#: Runs of one size that are merged into a larger one.
FAN = 4


def speech_runs(segments: DataFrame, gap_ms: int, delay: str = "1 hour", keys: Sequence[str] = ("video",)) -> DataFrame:
    """Session windows with a gap of each segment's own length and gap_ms - 1: windows that touch merge, while runs split at equality. segments: start_ms, end_ms."""
    length = F.concat((F.col("end_ms") - F.col("start_ms") + gap_ms - 1).cast("string"), F.lit(" milliseconds"))
    rows = segments.withColumn("_t", F.timestamp_millis("start_ms")).withWatermark("_t", delay)
    runs = rows.groupBy(*keys, F.session_window("_t", length)).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))
    return runs.drop("session_window")


def windowed_tally(points: DataFrame, state: str, width: str, delay: str = "1 hour", keys: Sequence[str] = ("video",)) -> DataFrame:
    """Counts of each state in tumbling windows. points: time_ms."""
    rows = points.withColumn("_t", F.timestamp_millis("time_ms")).withWatermark("_t", delay)
    g = rows.groupBy(*keys, F.window("_t", width), state).agg(F.count("*").alias("n"))
    return g.select(*keys, F.unix_millis("window.start").alias("window_ms"), state, "n")


def _ordered(parts: Iterator[pd.DataFrame], held: Sequence[list], columns: Sequence[str]) -> list[np.ndarray]:
    """Held rows and arrivals, in order of (time_ms, id). Arrays, not frames: a video has few rows, and a frame costs more than they do."""
    arrived = [p for p in parts if len(p)]
    rows = [np.concatenate([np.asarray(h), *(p[c].to_numpy() for p in arrived)]) if arrived and len(h) else np.concatenate([p[c].to_numpy() for p in arrived]) if arrived else np.asarray(h) for c, h in zip(columns, held)]
    order = np.lexsort((rows[1], rows[0]))
    return [r[order] for r in rows]


def local_peaks(points: DataFrame, threshold: float, delay: str = "1 hour", key: str = "video") -> DataFrame:
    """Peaks above the threshold among the frames that the watermark has passed, in order of (time_ms, id) whatever the order of arrival.

    The state of a video is the last decided frames and those still above the watermark, so at most ``delay`` of frames. Frames that come later than
    that are dropped. points: key, time_ms, id, value."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, *held = state.get if state.exists else (float("-inf"), [], [], [])
        t, i, v = _ordered(parts, held, ("time_ms", "id", "value"))
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(t, mark, "left"))
        n = max(ready - 1, 0)  # the last frame that is ready waits for its next one
        left, now, right = np.append(before, v[:n])[:n], v[:n], v[1 : n + 1]
        hit = np.flatnonzero((now > threshold) & (now >= left) & (now >= right) & ((now > left) | (now > right)))
        before = float(v[n - 1]) if n else before
        state.update((before, t[n:].tolist(), i[n:].tolist(), v[n:].tolist()))
        if len(t) > ready:
            state.setTimeoutTimestamp(max(mark + 1, int(t[ready])))
        if len(hit):
            yield pd.DataFrame({key: [group[0]] * len(hit), "time_ms": t[hit], "id": i[hit], "value": v[hit]})

    rows = points.select(key, "time_ms", "id", "value", F.timestamp_millis("time_ms").alias("_t")).withWatermark("_t", delay)
    kind = points.schema[key].dataType.simpleString()
    held = "before double, times array<bigint>, ids array<bigint>, values array<double>"
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, time_ms bigint, id bigint, value double", held, "append", GroupStateTimeout.EventTimeTimeout)


def _held(points: DataFrame, key: str, step, output: str, held: str, delay: str, *columns: str) -> DataFrame:
    """Runs a function of (group, arrivals, state) over points with a watermark."""
    rows = points.select(key, "time_ms", *columns, F.timestamp_millis("time_ms").alias("_t")).withWatermark("_t", delay)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {points.schema[key].dataType.simpleString()}, {output}", held, "append", GroupStateTimeout.EventTimeTimeout)


def suppress_close(points: DataFrame, step_ms: int, delay: str = "1 hour", key: str = "video") -> DataFrame:
    """Points kept by descending value that are at least ``step_ms`` from all kept ones, earlier first on ties.

    Points nearer than that form chains; a chain is decided and leaves the state when the watermark is ``step_ms`` beyond its last point. points: key, time_ms, id, value."""
    rule, columns = keep_apart(step_ms), ("time_ms", "id", "value")

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, i, v = _ordered(parts, state.get if state.exists else ([], [], []), columns)
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(t, mark, "left"))
        starts = np.flatnonzero(np.diff(t[:ready], prepend=-np.inf) >= step_ms) if ready else np.zeros(0, int)
        closed = ready if not ready or t[ready - 1] + step_ms <= mark else int(starts[-1])
        kept = [False] * closed
        for a, b in zip(starts, [*starts[1:], ready]):
            if b <= closed:
                kept[a:b] = rule(t[a:b].tolist(), v[a:b].tolist())
        if closed < len(t):
            state.update((t[closed:].tolist(), i[closed:].tolist(), v[closed:].tolist()))
            waits = [int(t[ready])] if ready < len(t) else []
            waits += [int(t[ready - 1]) + step_ms - 1] if closed < ready else []
            state.setTimeoutTimestamp(max(mark + (closed == ready), min(waits)))
        elif state.exists:
            state.remove()
        hit = np.flatnonzero(kept)
        if len(hit):
            yield pd.DataFrame({key: [group[0]] * len(hit), "time_ms": t[hit], "id": i[hit], "value": v[hit]})

    return _held(points, key, step, "time_ms bigint, id bigint, value double", "times array<bigint>, ids array<bigint>, values array<double>", delay, "id", "value")


def novelty(points: DataFrame, features: Mapping[str, tuple[float, float]], half: int = 50, delay: str = "1 hour", key: str = "video") -> DataFrame:
    """Novelty of each frame against the one before, as the batch operator has it, for frames with ``half`` later ones below the watermark. The state of a video is a ring
    of the frames that the window of the next one reaches, and those above the watermark. points: key, time_ms, id and the features (doubles, not null)."""
    names = list(features)
    columns = ("time_ms", "id", *names)

    def medians(change: np.ndarray, first: int, last: int) -> np.ndarray:
        """Of the frames first..last, each over ``half`` frames on both sides; a sorted ring moves along."""
        ring: list[float] = []
        out = np.zeros(last - first)
        low = high = max(0, first - half)
        for at in range(first, last):
            while high < min(len(change), at + half + 1):
                if change[high] == change[high]:
                    insort(ring, change[high])
                high += 1
            while low < at - half:
                if change[low] == change[low]:
                    del ring[bisect_left(ring, change[low])]
                low += 1
            k = len(ring)
            out[at - first] = float("nan") if not k else ring[k // 2] if k % 2 else (ring[k // 2 - 1] + ring[k // 2]) / 2
        return out

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, times, ids, flat = state.get if state.exists else (0, [], [], [])
        values = np.array(flat, np.float64).reshape(len(names), -1)
        t, i, *x = _ordered(parts, [times, ids, *values.tolist()], columns)
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(t, mark, "left"))
        last = max(done, ready - half)  # frames before this one have their whole window
        score = np.zeros(last - done)
        for name, own in zip(names, x):
            weight, least = features[name]
            change = np.abs(np.diff(own[:ready].astype(np.float64), prepend=np.nan))
            score += weight * change[done:last] / np.fmax(medians(change, done, last), least)
        begin = max(0, last - half - 1)  # a frame more, since changes look back
        state.update((last - begin, t[begin:].tolist(), i[begin:].tolist(), np.array([own[begin:] for own in x], np.float64).ravel().tolist()))
        if ready < len(t):
            state.setTimeoutTimestamp(max(mark + 1, int(t[ready])))
        if last > done:
            yield pd.DataFrame({key: [group[0]] * (last - done), "time_ms": t[done:last], "id": i[done:last], "novelty": score})

    points = points.select(key, "time_ms", "id", *(F.col(n).cast("double").alias(n) for n in names))
    return _held(points, key, step, "time_ms bigint, id bigint, novelty double", "done int, times array<bigint>, ids array<bigint>, flat array<double>", delay, "id", *names)


def _keep_epochs(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs the stream to the end of what is there; each micro-batch is one folder epoch=N, written again if it is run again. Rows of all epochs."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/epochs/epoch=-1")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epochs/epoch={epoch}")

    _run(stream.writeStream.outputMode(mode).foreachBatch(keep), folder)
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{folder}/epochs")


def _run(writer, folder: str) -> list[dict]:
    """Reads a stream to its end; what the state held after each batch (rows, and rows that left it)."""
    q = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return [{"rows": sum(o["numRowsTotal"] for o in p["stateOperators"]), "removed": sum(o.get("numRowsRemoved", 0) for o in p["stateOperators"])} for p in q.recentProgress]


def finish(stream: DataFrame, folder: str) -> DataFrame:
    """The complete result of the last epoch, also after a restart with or without new data. The state holds everything; use finish_append where rows are final at the watermark."""
    rows = _keep_epochs(stream, folder, "complete")
    return rows.where(F.col("epoch") == rows.agg(F.max("epoch")).scalar()).drop("epoch")


def finish_append(stream: DataFrame, folder: str, progress: list[dict] | None = None) -> DataFrame:
    """Reads the stream to its end, rows appended to Parquet files in the folder when the watermark makes them final. ``progress`` gets the size of the state after each batch."""
    told = _run(stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows"), folder)
    if progress is not None:
        progress += told
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


class Runs:
    """A table of keyed rows as runs: every epoch adds one, ``FAN`` runs of one size are merged into one of the next (the latest row of each key stays), and a pointer for
    each epoch names the runs that are live after it. An epoch that is run again starts from the pointer before it and writes the same names, so repeating it changes nothing;
    readers see whole epochs, and read at most FAN runs of each size, whatever the number of epochs."""

    def __init__(self, spark, folder: str, schema: T.StructType, merge) -> None:
        self.spark, self.folder, self.schema, self.merge = spark, folder, schema, merge

    def _live(self, before: int | None = None) -> list[list]:
        """[name, size] of the live runs, after the last epoch or the last one before ``before``."""
        told = self.spark.read.schema("epoch bigint, runs string").parquet(f"{self.folder}/pointers")
        last = (told if before is None else told.where(F.col("epoch") < before)).agg(F.max_by("runs", "epoch")).scalar()
        got = self.spark.range(1).select(last.alias("r")).first().r  # one row
        return json.loads(got) if got else []

    def _read(self, runs: list[list]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/runs/{name}" for name, _ in runs)) if runs else empty

    def add(self, batch: DataFrame, epoch: int) -> None:
        live = self._live(epoch)
        batch.write.mode("overwrite").parquet(f"{self.folder}/runs/{epoch}-0")
        live.append([f"{epoch}-0", 0])
        size = 0
        while len(same := [r for r in live if r[1] == size]) >= FAN:
            name = f"{epoch}-{size + 1}"
            self.merge(self._read(same)).write.mode("overwrite").parquet(f"{self.folder}/runs/{name}")
            live = [[name, size + 1], *(r for r in live if r[1] != size)]
            size += 1
        told = self.spark.createDataFrame([(epoch, json.dumps(live))], "epoch bigint, runs string")
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/pointers/at={epoch}")

    def read(self) -> DataFrame:
        return self.merge(self._read(self._live()))


def upsert_latest(changes: DataFrame, entity: Sequence[str], seq: Sequence[str], value: str, folder: str) -> DataFrame:
    """Latest change of each entity by its sequence, whatever the order of arrival. Each micro-batch writes the latest of the entities that it mentions as a run of its own; runs are merged
    as they grow in number, so the stream has no state and reading does not grow with the number of batches."""
    spark = changes.sparkSession
    latest = lambda rows: rows.groupBy(*entity).agg(F.max("_l").alias("_l"))
    rows = changes.select(*entity, F.struct(*seq, value).alias("_l"))
    runs = Runs(spark, folder, rows.schema, latest)
    spark.createDataFrame([(-1, "[]")], "epoch bigint, runs string").coalesce(1).write.mode("ignore").parquet(f"{folder}/pointers/at=-1")
    _run(rows.writeStream.foreachBatch(lambda batch, epoch: runs.add(latest(batch), epoch)), folder)
    return runs.read().select(*entity, *[F.col(f"_l.{c}").alias(c) for c in (*seq, value)])
