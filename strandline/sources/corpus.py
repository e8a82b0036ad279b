"""Reading and writing corpora of per-video artifacts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of each artifact and its file below a video's folder.
ARTIFACTS = {a: f"raw/{a}.json" for a in "media shots asr audio-cuts audio-energy quality music-flags camera-motion motion-effects unified-media review-timeline shot-relations story-blocks corrections".split()} | {"style-profile": "style-profile.json"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; a local one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """Where tasks find the folder by plain file calls, if Spark's file system for it is a mounted one (Spark is asked, since a path need not name its file system)."""
    spark.range(1).select(F.lit("").alias("value")).write.mode("overwrite").text(f"{folder}-place")
    at = urlsplit(spark.read.text(f"{folder}-place").select("_metadata.file_path").first().file_path)
    return unquote(at.path).rsplit("/", 1)[0].removesuffix("-place") if at.scheme == "file" else None


def write_documents(rows: DataFrame, keys: Sequence[str], folder: str) -> None:
    """One text file a row, below <folder>/key=value/... as Spark's writer names it. rows: keys (not null, one row each), value.

    On a mounted file system the tasks write the files themselves, dealt over all cores: Spark's writer sets the permissions of each folder, file and checksum there by a process of its own, and the
    driver moves every file. A file gets its name once it is whole, and the same name if its task is run again. On any other file system Spark writes them."""
    spark = rows.sparkSession
    to = _mounted(spark, folder)
    if to is None:
        rows.write.partitionBy(*keys).text(folder)
        return
    escaped = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for *key, value in zip(*(part[k] for k in keys), part["value"]):
                at = "/".join([to, *(f"{k}={escaped.sub(lambda m: f'%{ord(m[0]):02X}', str(v))}" for k, v in zip(keys, key))])
                os.makedirs(at, exist_ok=True)
                staged = f"{at}/.{uuid.uuid4().hex}"
                with open(staged, "w", encoding="utf-8", newline="") as out:
                    out.write(f"{value or ''}\n")
                os.replace(staged, f"{at}/part-0.txt")
            yield pd.DataFrame({"n": [len(part)]})

    os.makedirs(to, exist_ok=True)
    rows = rows.select(*keys, "value").repartition(spark.sparkContext.defaultParallelism, *keys)
    rows.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()  # one row


def read_artifact(spark: SparkSession, path: str, schema: str, video: str = r"/([^/]+)/raw/[^/]+$") -> DataFrame:
    """video_id and the typed columns of one artifact; a document that does not parse keeps its text in _corrupt_record. ``video``: what part of the file's path names it."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    doc = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = rows.select(F.regexp_extract("_metadata.file_path", video, 1).alias("video_id"), doc.alias("doc"))
    return rows.select("video_id", *[F.col(f"doc.{n}").alias(n) for n in [*names, "_corrupt_record"]])


def list_files(spark: SparkSession, path: str, glob: str = "*.json", video: str = r"/([^/]+)/raw/[^/]+$", artifact: str = r"/([^/]+)\.json$", videos: Sequence[str] | None = None) -> DataFrame:
    """video_id, artifact, file (its path below ``path``), n_bytes, modified_at of every file below a corpus folder, by Spark's own listing; no file is opened, since the content column is not asked for.
    Spark leaves files without a byte out of its scans, so they count as missing.

    ``glob`` picks files by name and ``videos`` the folders that are listed at all; a condition on n_bytes or modified_at reaches the scan. ``video``, ``artifact``: what part of the path names them."""
    folders = [path] if videos is None else [f"{path}/{v}" for v in videos]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folders)
    # the scheme and host that a file system puts before a path are not part of the name
    below = F.element_at(F.split("path", f"\\Q{path.split('://')[-1].split(':')[-1].rstrip('/')}\\E/", 2), -1)
    return rows.select(F.regexp_extract("path", video, 1).alias("video_id"), F.regexp_extract("path", artifact, 1).alias("artifact"), below.alias("file"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"))


def file_issues(expected: DataFrame, listing: DataFrame, least_bytes: int = 2) -> DataFrame:
    """video_id, artifact, issue: missing, empty (fewer than ``least_bytes``, which no document has) or unexpected. expected: video_id, artifact (repeats count once); listing: from ``list_files``.

    A document in several files is as large as all of them."""
    there = listing.groupBy("video_id", "artifact").agg(F.sum("n_bytes").alias("_n"))
    wanted = expected.select("video_id", "artifact").distinct().withColumn("_wanted", F.lit(True))
    issue = F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") < least_bytes, "empty")
    return wanted.join(there, ["video_id", "artifact"], "full").select("video_id", "artifact", issue.alias("issue")).where("issue is not null")


def tolerant(read: DataFrame, expected: DataFrame, artifact: str) -> tuple[DataFrame, DataFrame]:
    """Good documents, and an issue for each expected video that is missing (warning) or corrupt (error)."""
    good = read.where("_corrupt_record is null").drop("_corrupt_record")
    # documents are opened once: what was read and what was expected meet by video
    told = read.select("video_id", F.lit(1).alias("_read"), F.col("_corrupt_record").isNotNull().cast("int").alias("_bad"), F.lit(0).alias("_wanted"))
    told = told.unionByName(expected.select("video_id", F.lit(0).alias("_read"), F.lit(0).alias("_bad"), F.lit(1).alias("_wanted")))
    told = told.groupBy("video_id").agg(*(F.sum(c).alias(c) for c in ("_read", "_bad", "_wanted")))
    issue = lambda n, severity, message: F.transform(F.array_repeat(F.lit(0), n.cast("int")), lambda _: F.struct(F.lit(severity).alias("severity"), F.lit(artifact).alias("artifact"), "video_id", F.lit(message).alias("message")))
    missing = F.when((F.col("_read") == 0) | F.col("video_id").isNull(), F.col("_wanted")).otherwise(0)
    return good, told.select(F.inline(F.concat(issue(F.col("_bad"), "error", "corrupt"), issue(missing, "warning", "missing"))))


def explode_facts(docs: DataFrame, array: str, keys: list[str]) -> DataFrame:
    """One row for each well-formed element of an array column, with its place: references name elements by place."""
    return docs.select(*keys, F.posexplode(array).alias("pos", "item")).where("item is not null")


def pick_response(docs: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """The last (or first) entry of each key in document order."""
    sort = [F.col(c).asc() if first else F.col(c).desc() for c in order]
    return docs.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*sort))).where("_k = 1").drop("_k")


def log_samples(lines: DataFrame, header: Column, keys: list[str], order: str = "pos") -> DataFrame:
    """Adds the last header at or before each line of its file."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(w))


def pair_events(starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """k-th start with k-th end; without one the event is open; an end not after its start drops the pair. Each side: keys, t."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy("t"))
    both = starts.select(*keys, F.col("t").alias("start_ms"), n.alias("k")).join(ends.select(*keys, F.col("t").alias("end_ms"), n.alias("k")), [*keys, "k"], "left")
    return both.where("end_ms is null or end_ms > start_ms")


def frame_index(df: DataFrame, seconds: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct frame times in ms within the range; text that is no number, and negative times, go. Rounds half to even."""
    t = F.bround(F.col(seconds).try_cast("double") * 1000, 0).cast("bigint")
    rows = df.withColumn("pts_ms", t).where("pts_ms >= 0").join(ranges, keys).where("pts_ms >= range_start and pts_ms < range_end")
    return rows.select(*keys, "pts_ms").distinct()


def media_dimension(probe: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """One row a video from probe documents: first video stream, duration of the format or else of that stream (text that is no positive number does not count; neither known: status unreliable),
    sides swapped for a quarter turn, frame rate, audio tracks, and the analysed range: the given one if it lies inside the media, else (status range) or without one the whole.

    probe: video_id, duration, streams (array of kind, duration, width, height, rotation, rate, language, channels, sample_rate); ranges: video_id, start_ms, end_ms, either null."""
    from ..functions.scalars import parse_fraction, seconds_to_ms

    v = F.get(F.filter("streams", lambda s: s["kind"] == "video"), F.lit(0))
    turned = F.pmod(F.coalesce(v["rotation"], F.lit(0)), F.lit(360)).isin(90, 270)
    known = lambda c: F.when(c.try_cast("double") > 0, seconds_to_ms(c))
    of_format, of_stream = known(F.col("duration")), known(v["duration"])
    tracks = F.transform(F.filter("streams", lambda s: s["kind"] == "audio"), lambda s: F.struct(F.coalesce(s["language"], F.lit("unknown")).alias("language"), F.coalesce(s["channels"], F.lit(1)).alias("channels"), F.coalesce(s["sample_rate"].try_cast("double").cast("int"), F.lit(1)).alias("sample_rate")))
    rows = probe.select(
        "video_id", F.coalesce(of_format, of_stream).alias("duration_ms"), F.when(of_format.isNotNull(), "format").when(of_stream.isNotNull(), "stream").alias("duration_source"), F.when(turned, v["height"]).otherwise(v["width"]).alias("width"),
        F.when(turned, v["width"]).otherwise(v["height"]).alias("height"), F.round(parse_fraction(v["rate"]), 6).alias("frame_rate"), tracks.alias("tracks"), F.size(tracks).alias("audio_tracks"))
    given = ranges if ranges is not None else probe.select("video_id", F.lit(None).cast("bigint").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"))
    rows = rows.join(given, "video_id", "left").withColumn("_a", F.coalesce("start_ms", F.lit(0).cast("bigint"))).withColumn("_b", F.coalesce("end_ms", "duration_ms"))
    inside = (F.col("_a") >= 0) & (F.col("_a") < F.col("_b")) & (F.col("_b") <= F.col("duration_ms"))
    status = F.when(F.col("duration_ms").isNull(), "unreliable").when(~inside, "range").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("range_start_ms", F.when(F.col("status") == "ok", F.col("_a")).otherwise(F.lit(0).cast("bigint"))).withColumn("range_end_ms", F.when(F.col("status") == "ok", F.col("_b")).otherwise(F.col("duration_ms")))
    return rows.drop("_a", "_b", "start_ms", "end_ms")


RULES_SCHEMA = "fields map<string, struct<allowTransitions: boolean, separator: string, values: array<struct<value: string, aliases: array<string>>>>>"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """field, token, canonical, allow_transitions, separator from JSON rules: exact values as they are, aliases in lower case; an exact value wins over an alias of the same text, and an earlier value over a later one."""
    rows = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path).select(F.explode("fields").alias("field", "rule"))
    rows = rows.select("field", F.coalesce("rule.allowTransitions", F.lit(False)).alias("allow_transitions"), F.col("rule.separator").alias("separator"), F.posexplode("rule.values").alias("pos", "v"))
    exact = F.struct(F.col("v.value").alias("token"), F.lit(0).alias("rank"))
    others = F.transform(F.coalesce("v.aliases", F.array().cast("array<string>")), lambda x: F.struct(F.lower(x).alias("token"), F.lit(1).alias("rank")))
    rows = rows.select("field", "allow_transitions", "separator", "pos", F.col("v.value").alias("canonical"), F.explode(F.concat(F.array(exact), others)).alias("t"))
    first = rows.groupBy("field", F.col("t.token").alias("token")).agg(F.min_by(F.struct("canonical", "allow_transitions", "separator"), F.struct("t.rank", "pos")).alias("x"))
    return first.select("field", "token", "x.*")


#: Renamed fields of a model's shot, by part, and fields that version 2 has no more (fixed values).
SHOT_RENAMES = {
    "visual": {"perspective": "viewpoint", "lensFeel": "perceivedLensFeel", "lightingType": "lightingSource", "colorTemperature": "perceivedColorTemperature", "texture": "imageTexture"},
    "audio": {"soundEffects": "soundEvents"}, "components": {"compositingEvents": "nonTextOverlayEvents"},
}
SHOT_REMOVED = {"visual": ["content", "subjectCoverage", "movementIntensity"], "audio": ["speech"], "editing": ["transition", "continuity"], "confidence": ["editing", "overall"]}


def upgrade_shots(df: DataFrame, renames: Mapping[str, Mapping[str, str]] = SHOT_RENAMES, removed: Mapping[str, list[str]] = SHOT_REMOVED, version: str = "version") -> DataFrame:
    """Version 1 rows to version 2; version 2 rows pass, other versions raise.

    Parts (visual, audio, components, editing, confidence) are maps of text. Fields are renamed inside their part, removed ones go to the map ``legacy`` under part.field, confidence.function takes the place
    of confidence.editing where it is missing, and the part editing is gone."""
    legal = F.assert_true(F.col(version).isin(1, 2), "unknown schema version")
    rows = df.where(legal.isNull())
    old, none = F.col(version) == 1, F.create_map().cast("map<string,string>")
    only = lambda part, names, keep: F.map_filter(F.coalesce(part, none), lambda k, v: k.isin(list(names)) == F.lit(keep))
    prefixed = lambda m, part: F.transform_keys(m, lambda k, v: F.concat(F.lit(f"{part}."), k))
    named = lambda m, name: F.transform_keys(m, lambda k, v: F.coalesce(F.try_element_at(name, k), k))
    rows = rows.withColumn("legacy", F.when(old, F.map_concat(*[prefixed(only(part, names, True), part) for part, names in removed.items()])).otherwise(none))
    for part in dict.fromkeys([*renames, *removed]):
        if part == "editing":
            continue
        new = named(only(part, removed.get(part, []), False), F.create_map(*[F.lit(x) for kv in renames.get(part, {"": ""}).items() for x in kv]))
        if part == "confidence":
            moves = ~F.map_contains_key(part, F.lit("function")) & F.map_contains_key(part, F.lit("editing"))
            new = F.when(moves, F.map_concat(new, F.create_map(F.lit("function"), F.try_element_at(part, F.lit("editing"))))).otherwise(new)
        rows = rows.withColumn(part, F.when(old, new).otherwise(F.col(part)))
    return rows.drop("editing").withColumn(version, F.lit(2))


def prefer_current_name(current: DataFrame, former: DataFrame, keys: list[str]) -> DataFrame:
    """Documents under the current name of an artifact, and those under its former name of videos that have no other."""
    return current.unionByName(former.join(current.select(*keys), keys, "left_anti"))


_MARKS = ("mark_a", "mark_b")


def write_valid(df: DataFrame, valid: Column, folder: str, artifact: str, batch: str, schema_version: str = "1") -> DataFrame:
    """Appends a batch: valid rows to <folder>/<artifact>, the others to <folder>/quarantine/<artifact>; gives the artifact's state (see ``manifest``).

    Files are staged under the batch's name, and one row of <folder>/manifest commits them; readers see committed batches only. So a batch that is written again changes nothing, and one that stops
    before its commit leaves nothing. The row carries counts and the sum of 128-bit hashes of the valid rows: a multiset's fingerprint, which batches add up to without reading the sink again."""
    ok, spark = F.coalesce(valid, F.lit(False)), df.sparkSession
    good, bad = f"{folder}/{artifact}/batch={batch}", f"{folder}/quarantine/{artifact}/batch={batch}"
    df.where(ok).write.mode("overwrite").parquet(good)
    df.where(~ok).write.mode("overwrite").parquet(bad)
    hashed = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.conv(F.substring(hashed, at, 16), 16, 10).cast("decimal(20,0)")
    rows = spark.read.schema(df.schema).parquet(good).select(*(part(at).alias(name) for at, name in zip((1, 17), _MARKS)))
    sums = rows.agg(F.count("*").alias("n_valid"), *(F.coalesce(F.sum(name), F.lit(0)).cast("decimal(38,0)").alias(name) for name in _MARKS))
    sums = sums.withColumn("n_quarantined", spark.read.schema(df.schema).parquet(bad).agg(F.count("*")).scalar())
    sums.select("*", F.lit(schema_version).alias("schema_version"), F.current_timestamp().alias("updated_at")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/artifact={artifact}/batch={batch}")
    return manifest(spark, folder).where(F.col("artifact") == artifact)


_COMMITS = "n_valid bigint, mark_a decimal(38,0), mark_b decimal(38,0), n_quarantined bigint, schema_version string, updated_at timestamp, artifact string, batch string"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every artifact over its committed batches: artifact, path, fingerprint of the valid rows (whatever their order and batches), counts, status, last version and time."""
    rows = spark.read.schema(_COMMITS).parquet(f"{folder}/manifest").groupBy("artifact").agg(
        *(F.sum(c).alias(c) for c in (*_MARKS, "n_valid", "n_quarantined")), F.max_by("schema_version", "updated_at").alias("schema_version"), F.max("updated_at").alias("updated_at"))
    status = F.when(F.col("n_quarantined") == 0, "complete").when(F.col("n_valid") > 0, "partial").otherwise("failed")
    fingerprint = F.substring(F.sha2(F.concat_ws("/", "n_valid", *_MARKS), 256), 1, 32)
    return rows.select("artifact", F.col("artifact").alias("path"), fingerprint.alias("fingerprint"), "n_valid", "n_quarantined", status.alias("status"), "schema_version", "updated_at")


def read_valid(spark: SparkSession, folder: str, artifact: str, schema: T.StructType, quarantined: bool = False) -> DataFrame:
    """The rows of the committed batches of an artifact."""
    batches = [r.batch for r in spark.read.schema(_COMMITS).parquet(f"{folder}/manifest").where(F.col("artifact") == artifact).select("batch").distinct().collect()]  # a name a batch
    base = f"{folder}/{'quarantine/' if quarantined else ''}{artifact}"
    return spark.read.schema(schema).parquet(*(f"{base}/batch={b}" for b in batches)) if batches else spark.createDataFrame([], schema)
