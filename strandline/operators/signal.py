"""Signal and change-point operators over frame series. Array kernels are higher-order functions; greedy selections run on short chains."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import motion_confidence, motion_intensity
from .chains import decide, number_chains
from .scan import running

KEYS = ("video",)
SILENCE_DB = -99.0


def _w(keys: Sequence[str], index: str):
    return W.partitionBy(*keys).orderBy(index)


def total(x: Column) -> Column:
    """Sum of an array, in order."""
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def mean_abs_diff(x: Column, y: Column) -> Column:
    return mean(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def pair_metrics(df: DataFrame, edge_weight: float = 0.25, index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """For each frame and the one before: content, edge and brightness delta, change (and its negative, the score), similarity of edges and of histograms.

    df: hue, saturation, value and edges (planes of 0..1 as arrays), histogram (shares that sum to 1). Hue is a circle: its distance is at most a half.
    """
    planes = ("hue", "saturation", "value", "edges", "histogram")
    rows = df.select(*keys, index, *planes, *[F.lag(c).over(_w(keys, index)).alias(f"_{c}") for c in planes]).where("_hue is not null")
    turn = mean(F.zip_with("hue", "_hue", lambda a, b: F.least(F.abs(a - b), 1 - F.abs(a - b)))) * 2
    content = 255 * (turn + mean_abs_diff(F.col("saturation"), F.col("_saturation")) + mean_abs_diff(F.col("value"), F.col("_value"))) / 3
    rows = rows.withColumn("content", content).withColumn("edge", 255 * mean_abs_diff(F.col("edges"), F.col("_edges")))
    change = F.col("content") + edge_weight * F.col("edge")
    return rows.select(
        *keys, index, "content", "edge", change.alias("change"), (-change).alias("score"), F.greatest(F.lit(0.0), 1 - F.col("edge") / 255).alias("edge_similarity"),
        total(F.zip_with("histogram", "_histogram", lambda a, b: F.least(a, b))).alias("histogram_similarity"), F.abs(mean(F.col("value")) - mean(F.col("_value"))).alias("brightness_delta"))


def global_ssim(x: Column, y: Column) -> Column:
    """Structural similarity with the whole plane as one window, clamped to -1..1; 1 where the denominator is not positive."""
    n = F.size(x)
    mx, my = total(x) / n, total(y) / n
    vx, vy, cov = dot(x, x) / n - mx * mx, dot(y, y) / n - my * my, dot(x, y) / n - mx * my
    c1, c2 = 0.01**2, 0.03**2
    below = (mx * mx + my * my + c1) * (vx + vy + c2)
    return F.when(below <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), ((2 * mx * my + c1) * (2 * cov + c2)) / below)))


def adaptive_ratio(df: DataFrame, value: str = "value", index: str = "i", keys: Sequence[str] = KEYS, window: int = 3) -> DataFrame:
    """Adds ratio: value over the mean of its neighbours (at least 1), itself left out; null for the first and the last pair."""
    w = _w(keys, index)
    sums, counts = F.lit(0.0), F.lit(0)
    for a, b in ((-window, -1), (1, window)):
        sums = sums + F.coalesce(F.sum(value).over(w.rowsBetween(a, b)), F.lit(0.0))
        counts = counts + F.count(value).over(w.rowsBetween(a, b))
    inner = F.lag(index).over(w).isNotNull() & F.lead(index).over(w).isNotNull()
    return df.withColumn("ratio", F.when(inner, F.col(value) / F.greatest(sums / counts, F.lit(1.0))))


def cut_candidates(df: DataFrame, hard: float, least: float, ratio: float, ssim: Column | None = None, most_similar: float = 0.94, value: str = "value") -> DataFrame:
    """Rows with a ratio that are hard cuts or adaptive outliers; outliers that look alike are marked suppressed."""
    outlier = (F.col(value) >= least) & (F.col("ratio") >= ratio)
    reason = F.when(F.col(value) >= hard, "rawNegativeScore").when(outlier, "adaptiveOutlier")
    rows = df.where("ratio is not null").withColumn("reason", reason).where("reason is not null")
    rows = rows.withColumn("confidence", F.when(F.col("reason") == "rawNegativeScore", "high").when(F.col("ratio") >= ratio * 1.5, "medium").otherwise("low"))
    alike = F.lit(False) if ssim is None else F.coalesce((F.col("reason") == "adaptiveOutlier") & (ssim > most_similar), F.lit(False))
    return rows.withColumn("suppressed", F.when(alike, "ssimSimilarityRejected"))


def _chains(df: DataFrame, step: float, position: str, keys: Sequence[str]) -> DataFrame:
    """Adds chain and its length: neighbours closer than ``step`` are in one chain; decisions do not reach from one chain to another."""
    opens = F.coalesce(F.col(position) - F.lag(position).over(_w(keys, position)) >= step, F.lit(True))
    return number_chains(df, opens, position, keys).withColumn("_size", F.count("*").over(W.partitionBy(*keys, "chain")))


def keep_apart(step: float):
    """Rule: by descending score, earlier first on ties, keep what is at least ``step`` from all kept."""

    def rule(positions: list, scores: list) -> list[bool]:
        kept: list = []  # sorted: only the two neighbours of a position can be too close
        out = [False] * len(positions)
        for i in sorted(range(len(positions)), key=lambda i: (-scores[i], positions[i])):
            at = bisect_left(kept, positions[i])
            if all(abs(positions[i] - k) >= step for k in kept[max(0, at - 1) : at + 1]):
                kept.insert(at, positions[i])
                out[i] = True
        return out

    return rule


def suppress_close(df: DataFrame, score: str, step: float, position: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """Keeps rows by descending score that are at least ``step`` from all kept ones; earlier first on ties. Chains of one row never reach Python."""
    rows = _chains(df, step, position, keys)
    longer = decide(rows.where("_size > 1").drop("_size"), keys, [position], [position, score], keep_apart(step), "_keep", "boolean")
    return rows.where("_size = 1").drop("_size").unionByName(longer.where("_keep").drop("_keep")).drop("chain")


def merge_rule(minimum: int, rapid: int):
    """Rule: by descending value, a candidate nearer than ``minimum`` to a kept one (``rapid`` if both are high) goes into the first kept one in its way."""

    def rule(positions: list, values: list, confidences: list) -> list:
        kept: list = []  # (position, order of keeping, confidence), sorted: kept ones lie apart, so few are within reach
        out: list = [None] * len(positions)
        for n, i in enumerate(sorted(range(len(positions)), key=lambda i: (-values[i], positions[i]))):
            reach = max(minimum, rapid)
            near = kept[bisect_left(kept, (positions[i] - reach,)) : bisect_left(kept, (positions[i] + reach,))]
            way = [(k, p) for p, k, c in near if abs(positions[i] - p) < (rapid if c == confidences[i] == "high" else minimum)]
            if way:
                out[i] = min(way)[1]
            else:
                insort(kept, (positions[i], n, confidences[i]))
        return out

    return rule


def merge_short(df: DataFrame, minimum: int, rapid: int, value: str = "value", index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds merged_into, null for kept candidates."""
    rows = _chains(df, max(minimum, rapid), index, keys)
    longer = decide(rows.where("_size > 1").drop("_size"), keys, [index], [index, value, "confidence"], merge_rule(minimum, rapid), "merged_into", "bigint")
    return rows.where("_size = 1").drop("_size").withColumn("merged_into", F.lit(None).cast("bigint")).unionByName(longer).drop("chain")


def frame_features(x: Column) -> Column:
    """struct(rms_db, zcr, roughness, crest) of a frame's samples; silence has -99 dB and zeros elsewhere."""
    n = F.size(x)
    rms = F.sqrt(dot(x, x) / n)
    signs = F.transform(x, lambda a: F.when(a >= 0, 1).otherwise(0))
    crossings = F.aggregate(F.zip_with(F.slice(signs, 2, n - 1), F.slice(signs, 1, n - 1), lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    quarter = F.floor(n / 4).cast("int")
    subs = F.transform(F.array(*map(F.lit, range(4))), lambda k: F.sqrt(dot(F.slice(x, k * quarter + 1, quarter), F.slice(x, k * quarter + 1, quarter)) / quarter))
    m = mean(subs)
    rough = F.when(m > 0, F.sqrt(mean(F.transform(subs, lambda s: (s - m) * (s - m)))) / m).otherwise(0.0)
    return F.struct(
        F.when(rms > 0, F.greatest(F.lit(SILENCE_DB), 20 * F.log10(rms))).otherwise(SILENCE_DB).alias("rms_db"), (crossings / (n - 1)).alias("zcr"),
        rough.alias("roughness"), F.when(rms > 0, F.array_max(F.transform(x, lambda a: F.abs(a))) / rms).otherwise(0.0).alias("crest"))


def autocorrelation(x: Column, lag: int) -> Column:
    a, b = F.slice(x, 1, F.size(x) - lag), F.slice(x, lag + 1, F.size(x) - lag)
    power = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(power > 0, dot(a, b) / power).otherwise(0.0)


#: Rows of one piece of a signal in a sliding computation; pieces overlap by the reach of the window.
PIECE_ROWS = 4096


def _sliding_medians(columns: Sequence[str], half: int):
    """Medians of each column over ``half`` rows on both sides, nulls left out, by a sorted ring: one insertion and one removal a row."""

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_pos")
        for name in columns:
            values, ring, out = piece[name].to_pylist(), [], []
            for at in range(-half, len(values)):
                if at + half < len(values) and values[at + half] is not None:
                    insort(ring, values[at + half])
                if at > half and values[at - half - 1] is not None:
                    del ring[bisect_left(ring, values[at - half - 1])]
                if at >= 0:
                    k = len(ring)
                    out.append(None if not k else ring[k // 2] if k % 2 else (ring[k // 2 - 1] + ring[k // 2]) / 2)
            piece = piece.set_column(piece.schema.get_field_index(f"{name}_median"), f"{name}_median", pa.array(out, pa.float64()))
        return piece

    return run


def novelty(df: DataFrame, features: dict[str, tuple[float, float]], half: int = 50, index: str = "i", keys: Sequence[str] = KEYS, piece_rows: int = PIECE_ROWS, segment_rows: int | None = None) -> DataFrame:
    """Adds novelty of each frame against the one before. features: name -> (weight, least scale); a change counts in units of the local median change.

    A signal is cut into pieces that overlap by the window's reach, so that a long video is spread over tasks and a piece is bounded."""
    changes = [f"_{n}" for n in features]
    rows = running(df, (index,), {"_pos": ("sum", F.lit(1))}, keys, segment_rows=segment_rows)
    piece = lambda at: F.floor(at / piece_rows).cast("int")
    own = F.col("_pos") - 1
    rows = rows.withColumn("_piece", F.explode(F.sequence(piece(F.greatest(own - half - 1, F.lit(0))), piece(own + half + 1))))
    before = W.partitionBy(*keys, "_piece").orderBy("_pos")
    rows = rows.withColumns({c: F.abs(F.col(c[1:]).cast("double") - F.lag(c[1:]).over(before)) for c in changes}).withColumns({f"{c}_median": F.lit(None).cast("double") for c in changes})
    rows = rows.groupBy(*keys, "_piece").applyInArrow(_sliding_medians(changes, half), rows.schema).where(piece(own) == F.col("_piece"))
    score = F.lit(0.0)
    for name, (weight, least) in features.items():
        score = score + weight * F.col(f"_{name}") / F.greatest(F.col(f"_{name}_median"), F.lit(least))
    return rows.select(*df.columns, score.alias("novelty"))


def local_peaks(df: DataFrame, threshold: float, value: str = "value", index: str = "i", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows above the threshold that are no lower than both neighbours and higher than one; there is nothing beyond the ends."""
    w = _w(keys, index)
    low = F.lit(float("-inf"))
    rows = df.withColumn("_l", F.coalesce(F.lag(value).over(w), low)).withColumn("_r", F.coalesce(F.lead(value).over(w), low))
    v = F.col(value)
    return rows.where((v > threshold) & (v >= F.col("_l")) & (v >= F.col("_r")) & ((v > F.col("_l")) | (v > F.col("_r")))).drop("_l", "_r")


def texture_events(df: DataFrame, threshold: float, separation: int, flatness: str = "flatness", time: str = "time_ms", keys: Sequence[str] = KEYS) -> DataFrame:
    """Steps of flatness of at least the threshold, the largest kept within each separation; kind rise or fall."""
    rows = df.withColumn("delta", F.col(flatness) - F.lag(flatness).over(_w(keys, "i"))).where(F.abs("delta") >= threshold)
    rows = rows.withColumn("_size_of", F.abs("delta"))
    return suppress_close(rows, "_size_of", separation, time, keys).withColumn("kind", F.when(F.col("delta") > 0, "textureRise").otherwise("textureFall")).drop("_size_of")


def rms_windows(df: DataFrame, size: int, value: str, index: str = "i", keys: Sequence[str] = KEYS, full: float = 32768.0) -> DataFrame:
    """Level of whole windows of ``size`` samples (index from 1); a part window at the end is dropped."""
    rows = df.groupBy(*keys, F.floor((F.col(index) - 1) / size).alias("win")).agg(F.count("*").alias("_n"), F.avg(F.col(value) * F.col(value)).alias("_p")).where(F.col("_n") == size)
    return rows.select(*keys, "win", F.when(F.col("_p") > 0, 20 * F.log10(F.sqrt("_p") / full)).otherwise(SILENCE_DB).alias("db"))


def waveform(df: DataFrame, ranges: DataFrame, width: int, value: str, full: float, time: str = "time_ms", keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest and largest value of each bin over the range, as a share of ``full`` clamped to -1..1, three places; 0, 0 for empty bins."""
    bins = ranges.select(*keys, "range_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("range_end") - 1 - F.col("range_start")) / width))).alias("bin"))
    hits = df.join(ranges, list(keys)).groupBy(*keys, F.floor((F.col(time) - F.col("range_start")) / width).alias("bin")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    norm = lambda c: F.coalesce(F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c) / full)), 3), F.lit(0.0))
    return bins.join(hits, [*keys, "bin"], "left").select(*keys, "bin", norm("lo").alias("lo"), norm("hi").alias("hi"))


THRESHOLDS = {"p20": ("motion", 0.2), "p50": ("motion", 0.5), "p80": ("motion", 0.8), "cut90": ("cut", 0.9), "move90": ("move", 0.9), "zoom90": ("zoom", 0.9), "shake90": ("shake", 0.9), "bright92": ("bright", 0.92)}


def _places(x: Column, n: int) -> Column:
    """Rounds the scaled double, as SQL engines do; F.round goes by the shortest decimal of the double, which tells another side where a value lies within an ulp of a half."""
    return F.round(x * 10.0**n) / 10.0**n


def _share_of(values: str, q: float) -> Column:
    """Percentile of a sorted array: low (1 - d) + high d, where the first product is not rounded before the sum (a fused multiply-add, as the SQL's engine has it)."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high, d = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int")), at - F.floor(at)
    step = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  # names a value, so that it is computed once

    def split(x: Column) -> tuple[Column, Column]:
        upper = x * 134217729.0 - (x * 134217729.0 - x)
        return upper, x - upper

    def fused(x: Column) -> Column:
        (ah, al), (bh, bl), p, c = split(x["a"]), split(x["b"]), x["a"] * x["b"], x["c"]
        lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
        t = p + c
        return t + (((p - (t - (t - p))) + (c - (t - p))) + lost)

    return step(F.struct(low.alias("a"), (1 - d).alias("b"), (high * d).alias("c")), fused)


def adaptive_thresholds(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percentiles of a video's motion, cut, move, zoom, shake and bright, four places."""
    used = dict.fromkeys(c for c, _ in THRESHOLDS.values())
    rows = df.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in used])
    return rows.select(*keys, *[_places(_share_of(f"_{c}", q), 4).alias(name) for name, (c, q) in THRESHOLDS.items()])


def _hit_groups(rows: DataFrame, kinds: dict[str, tuple[Column, int]], keys: Sequence[str]) -> DataFrame:
    """Each row once for each kind whose condition it meets, with grp: steps of at most the kind's gap stay in a group. One shuffle for all kinds."""
    hit = F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, (cond, _) in kinds.items()])))
    gap = F.create_map(*[F.lit(x) for k, (_, g) in kinds.items() for x in (k, g)])
    w = W.partitionBy(*keys, "kind").orderBy("i")
    rows = rows.withColumn("kind", hit)
    opens = F.coalesce(F.col("i") - F.lag("i").over(w) > F.try_element_at(gap, F.col("kind")), F.lit(True))
    return rows.withColumn("_opens", opens.cast("int")).withColumn("grp", F.sum("_opens").over(w)).drop("_opens")


def speed_ramps(df: DataFrame, limits: DataFrame, region: int, impact_floor: float, frame_ms: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Low, high and impact regions with duration, confidence and the frames that show them. df: i, time_ms, motion, repeat, cut, bright; limits: adaptive thresholds; a region ends ``frame_ms`` after its last frame."""
    c = F.col
    kinds = {
        "low_motion_or_freeze": ((c("motion") <= c("p20")) & (c("repeat") > 0.78), 2),
        "high_motion_region": (c("motion") >= c("p80"), 2),
        "impact_cut": (((c("cut") >= c("cut90")) | (F.abs("bright") > impact_floor)) & (c("motion") >= c("p50")), 1),
    }
    g = _hit_groups(df.join(limits, list(keys)), kinds, keys).groupBy(*keys, "kind", "grp").agg(
        F.min("time_ms").alias("start_ms"), (F.max("time_ms") + frame_ms).alias("end_ms"), F.count("*").alias("n"), F.avg("motion").alias("mean"), F.max("cut").alias("top"),
        F.min_by("i", F.struct(-c("cut"), "i")).alias("peak"), F.min("i").alias("first"), F.max("i").alias("last"), F.first("p20").alias("p20"), F.first("p80").alias("p80"), F.first("cut90").alias("cut90"))
    impact, low = c("kind") == "impact_cut", c("kind") == "low_motion_or_freeze"
    value = F.when(impact, c("top")).when(low & (c("mean") > 0), c("p20") / c("mean")).otherwise(c("mean"))
    sure = motion_confidence(value, F.when(impact, c("cut90")).when(low, 1.0).otherwise(c("p80")))
    return g.where(impact | (c("n") >= region)).select(
        "kind", *keys, "start_ms", "end_ms", (c("end_ms") - c("start_ms")).alias("duration_ms"), "n", _places(c("mean"), 4).alias("avg_motion"), F.when(impact, c("peak")).alias("peak_i"),
        sure.alias("confidence"), F.when(impact, F.array("peak")).otherwise(F.array("first", "last")).alias("refs"))


KEYFRAMES = {"position": ("move", "move90", 2.0), "scale": ("zoom", "zoom90", 0.025), "shake": ("shake", "shake90", 2.5), "exposure": ("bright", "bright92", 0.12)}


def keyframe_candidates(df: DataFrame, limits: DataFrame, floors: dict[str, float] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peaks of each property at or above its floor and its video's limit, outside cuts (exposure excepted). One row a group of hits (groups of neighbours; exposure without gaps)."""
    kinds, value = {}, F.lit(None).cast("double")
    for name, (c, limit, floor) in KEYFRAMES.items():
        hit = F.col(c) >= F.greatest(F.col(limit), F.lit((floors or {}).get(name, floor)))
        kinds[name] = (hit if name == "exposure" else hit & (F.col("cut") < F.col("cut90")), 1 if name == "exposure" else 2)
        value = F.when(F.col("kind") == name, F.col(c)).otherwise(value)
    rows = _hit_groups(df.join(limits, list(keys)), kinds, keys).withColumn("peak", value.cast("double"))
    g = rows.groupBy(*keys, "kind", "grp").agg(F.min_by(F.struct("i", "time_ms", "peak"), F.struct(-F.col("peak"), "i")).alias("p"), F.count("*").alias("n"))
    return g.select(F.col("kind").alias("property"), *keys, "p.i", "p.time_ms", "p.peak", "n")


#: Fixed values of the camera classifier: least samples and pairs, noise floor, least shift, dominance, consistency, zoom scale and share, jump factor and shift.
CAMERA = {"samples": 3, "pairs": 2, "sure": 4, "noise": 0.25, "shift": 2.0, "dominance": 1.5, "consistent": 0.7, "zoom": 1.001, "steady": 0.7, "factor": 5.0, "jump": 8.0}
NEUTRAL = {"pan_left": "horizontal_frame_shift", "pan_right": "horizontal_frame_shift", "tilt_up": "vertical_frame_shift", "tilt_down": "vertical_frame_shift", "zoom_in": "frame_scale_change", "zoom_out": "frame_scale_change", "handheld": "irregular_frame_jitter", "discontinuity": "geometric_discontinuity"}


def classify_motion(df: DataFrame, keys: Sequence[str] = KEYS, limits: dict[str, float] | None = None) -> DataFrame:
    """Camera movement of each shot from its frames (dx, dy, scale against the frame before; ok is false for the first one and where matching failed).

    Medians first, then shares against them; a jump outranks directions, directions outrank zoom, and weak or unsteady motion
    is static, handheld or unknown. Content that moves right means a camera that pans left.
    """
    t = CAMERA | (limits or {})
    good = df.where("ok").withColumn("px", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    medians = good.groupBy(*keys).agg(F.count("*").alias("pairs"), F.median("dx").alias("mx"), F.median("dy").alias("my"), F.median("px").alias("score"), F.median("scale").alias("ms"))
    share = lambda c: F.avg(c.cast("int"))
    along = lambda d, m: (F.col(m) != 0) & (F.col(d) * F.signum(m) >= t["noise"])
    ratios = good.join(medians, list(keys)).groupBy(*keys).agg(
        F.bool_or((F.col("px") > t["factor"] * F.col("score")) & (F.col("px") >= t["jump"])).alias("jumps"), share(along("dx", "mx")).alias("cx"), share(along("dy", "my")).alias("cy"),
        share(F.col("scale") > t["zoom"]).alias("zi"), share(F.col("scale") < 1 / t["zoom"]).alias("zo"))
    rows = df.groupBy(*keys).agg(F.count("*").alias("n")).join(medians, list(keys), "left").join(ratios, list(keys), "left").fillna(0, ["pairs", "score", "cx", "cy", "zi", "zo"])
    c, one = F.col, F.lit(None).cast("string")
    leads = lambda a, b, share_: (F.abs(a) >= t["shift"]) & (F.abs(a) > t["dominance"] * F.abs(b)) & (c(share_) > t["consistent"])
    found = F.array_compact(F.array(
        F.when(leads("mx", "my", "cx"), F.when(c("mx") > 0, "pan_left").otherwise("pan_right")).otherwise(one), F.when(leads("my", "mx", "cy"), F.when(c("my") > 0, "tilt_up").otherwise("tilt_down")).otherwise(one),
        F.when((c("zi") >= t["steady"]) & (c("ms") > 1), "zoom_in").when((c("zo") >= t["steady"]) & (c("ms") < 1), "zoom_out").otherwise(one)))
    few, jumps, sure = (c("n") < t["samples"]) | (c("pairs") < t["pairs"]), F.coalesce("jumps", F.lit(False)), c("pairs") >= t["sure"]
    weak, loose = c("score") < 1, (c("cx") < t["consistent"]) & (c("cy") < t["consistent"])
    rows = rows.withColumn("found", found)
    some = F.size("found") > 0
    rows = rows.withColumn("movement", F.when(few, "unknown").when(jumps, "discontinuity").when(some, F.get("found", F.lit(0))).when(weak, "static").when(loose, "handheld").otherwise("unknown"))
    confidence = F.when(few, "unknown").when(jumps, "low").when(some, F.when(sure, "medium").otherwise("low")).when(weak, F.when(sure, "high").otherwise("medium")).otherwise("low")
    names = F.create_map(*[F.lit(x) for kv in NEUTRAL.items() for x in kv])
    rows = rows.withColumn("candidates", F.when(~few & ~jumps & some, F.col("found")).otherwise(F.array("movement")))
    rows = rows.withColumn("neutral", F.array_distinct(F.array_compact(F.transform("candidates", lambda x: F.try_element_at(names, x)))))
    return rows.withColumn("intensity", F.when(few, "unknown").otherwise(motion_intensity("score"))).withColumn("confidence", confidence).withColumn("needs_review", confidence != "high").drop("found")
