"""Observations in long form, correction logs and their overlay, and incremental refresh."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import confidence as confidence_of
from ..functions.scalars import evidence_ref, is_absence_claim, raw_value_state

#: Sources that may say that something is absent.
DETECTORS = ["ffprobe", "ffmpeg", "audioDetector", "appleVision"]
STATES = ["value", "absent", "absent-claimed", "unknown", "unmapped"]


#: Fields that a model fills, and the part of its reply that carries a confidence for each (fixed values).
MODEL_FIELDS = (
    "visual.subjects visual.actions visual.setting visual.props visual.framing visual.cameraAngle visual.composition visual.viewpoint visual.brightness visual.contrast visual.lightingSource "
    "visual.perceivedColorTemperature visual.saturation visual.depthOfField visual.imageTexture visual.dominantColor visual.perceivedLensFeel function.sourceMedium function.subjectEmotion function.shotTone "
    "audio.bgmStyle audio.soundEvents components.nonTextOverlayEvents"
).split()
#: Fields that detectors and rules fill.
DETECTED_FIELDS = "audio.speech audio.bgmPresence audio.energy quality.flags visual.cameraMovement visual.movementIntensity visual.contentSummary editing.transition".split()
COLUMNS = ("field", "value", "state", "confidence", "refs", "source", "verified", "original")


def observation(df: DataFrame, keys: Sequence[str], field: str | Column, value: Column, state: Column, confidence: Column, refs: Column, source: str | Column, original: Column | None = None) -> DataFrame:
    """One row of the long table for each row of ``df``; a value stands only in the state value."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return df.select(
        *keys, lit(field).alias("field"), F.when(state == "value", value.cast("string")).alias("value"), state.alias("state"), confidence.alias("confidence"), refs.alias("refs"), lit(source).alias("source"),
        F.lit(False).alias("verified"), (none if original is None else original.cast("string")).alias("original"))


def model_observations(df: DataFrame, keys: Sequence[str], vocabularies: dict[str, dict[str, str]] | None = None, fields: Sequence[str] = MODEL_FIELDS, source: str = "unifiedModel") -> DataFrame:
    """The model's fields of every shot in long form.

    df: status, base_ref (where the reply stands, null if there is none), raw (map of field to text; a field that the reply lacks is no key), sure (map of part to confidence). Only
    succeeded shots speak; claims of absence come before the vocabulary; a field with a vocabulary (exact values first, then lower-case tokens) is known or unmapped; the others are free text."""
    rows = df.select(*keys, "status", "base_ref", "raw", "sure", F.explode(F.array(*map(F.lit, fields))).alias("_f"))
    named = {f"{f}|{t}": c for f, v in (vocabularies or {}).items() for t, c in v.items()}
    known = F.create_map(*[F.lit(x) for kv in (named or {"": ""}).items() for x in kv])
    raw = F.try_element_at("raw", F.col("_f"))
    key = lambda t: F.try_element_at(known, F.concat_ws("|", "_f", t))
    hit = F.coalesce(key(F.trim(raw)), key(F.lower(F.trim(raw))))
    here = F.coalesce(F.col("status") == "succeeded", F.lit(False)) & F.col("base_ref").isNotNull()
    has = here & F.map_contains_key("raw", F.col("_f"))
    bound = F.col("_f").isin(list(vocabularies or {}))
    has = F.coalesce(has, F.lit(False))
    state = F.when(~has | (raw_value_state(raw) == "unknown"), "unknown").when(is_absence_claim(raw), "absent-claimed").when(~bound | hit.isNotNull(), "value").otherwise("unmapped")
    refs = F.when(~here, F.array().cast("array<string>")).when(~has, F.array("base_ref")).otherwise(F.array(F.concat_ws(".", "base_ref", "_f")))
    sure = F.when(has, confidence_of(F.try_element_at("sure", F.substring_index("_f", ".", 1)))).otherwise("unknown")
    value = F.when(bound, hit).otherwise(F.trim(raw))
    return observation(rows, keys, F.col("_f"), value, state, sure, refs, source, F.when(has & (state != "value"), raw))


def all_observations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merged_reasons(*reasons: str | Column) -> Column:
    """Arrays of review reasons as one, in order, each once; null arrays are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(r if isinstance(r, Column) else F.col(r), F.array().cast("array<string>")) for r in reasons]))


def completion(found: DataFrame, keys: Sequence[str], required: Sequence[str], verified_states: Sequence[str] = ("unmapped", "absent-claimed"), allow_unknown: bool = True, check_refs: bool = True) -> DataFrame:
    """keys, unmet (what stands in the way, sorted), satisfied: for every shot that has observations.

    Required fields are there and settled (value or absent; unknown where that is allowed), states that need it are verified, unknown is allowed or nowhere, references are well formed."""
    state, field = F.col("state"), F.col("field")
    shots = found.select(*keys).distinct()
    # a small file may hold many observations, so its size does not say that they can be broadcast
    asked = found.where(field.isin(list(required))).select(*keys, "field", "state").hint("merge")
    need = shots.withColumn("field", F.explode(F.array(*map(F.lit, required)))).join(asked, [*keys, "field"], "left")
    open_ = ~state.isin("value", "absent") & ~((state == "unknown") & F.lit(allow_unknown))
    first = need.where(state.isNull() | open_).select(*keys, F.concat("field", F.when(state.isNull(), ": missing").otherwise(F.concat(F.lit(": unsettled "), state))).alias("u"))
    bad = F.exists("refs", lambda r: evidence_ref(r)["reason"].isNotNull())
    other = F.array_compact(F.array(
        F.when(state.isin(list(verified_states)) & ~F.col("verified"), F.concat(field, F.lit(": unverified "), state)), F.when((state == "unknown") & F.lit(not allow_unknown), F.concat(field, F.lit(": unknown"))),
        F.when(F.lit(check_refs) & (state != "unknown") & bad, F.concat(field, F.lit(": bad reference")))))
    unmet = first.unionByName(found.select(*keys, F.explode(other).alias("u"))).groupBy(*keys).agg(F.array_sort(F.collect_list("u")).alias("unmet"))
    return shots.join(unmet, list(keys), "left").select(*keys, F.coalesce("unmet", F.array().cast("array<string>")).alias("unmet"), F.col("unmet").isNull().alias("satisfied"))


def confirmable(docs: DataFrame, complete: DataFrame, errors: DataFrame, key: str = "doc") -> DataFrame:
    """key, verdict: ok, or what stands in the way first. docs: key, outdated; complete: key, satisfied; errors: key of every strict error."""
    bad = errors.select(key).distinct().withColumn("_bad", F.lit(True))
    rows = docs.join(complete.select(key, "satisfied"), key, "left").join(bad, key, "left")
    return rows.select(key, F.when(F.col("outdated"), "outdated").when(~F.coalesce("satisfied", F.lit(False)), "incomplete").when(F.col("_bad"), "errors").otherwise("ok").alias("verdict"))


def split_changes(log: DataFrame, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """Changes of boundaries, and all others: the former move final bounds and leave the detected ones as they are."""
    return log.where(F.coalesce(boundary, F.lit(False))), log.where(~F.coalesce(boundary, F.lit(False)))


def lineage(df: DataFrame, graph: dict[str, tuple[Sequence[str], str, str]], size: int = 16) -> DataFrame:
    """Adds a fingerprint for each artifact of the graph, in order: name -> (upstream artifacts or columns, configuration, version)."""
    for name, (above, config, version) in graph.items():
        df = df.withColumn(name, chained_fingerprint({**{c: F.col(c) for c in above}, "config": F.lit(config), "version": F.lit(version)}, size=size))
    return df


def step_status(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status. df: status (complete, degraded, skipped, partial, failed), required: a failed required step fails all; what was skipped or degraded on purpose counts as complete."""
    failed = F.bool_or((F.col("status") == "failed") & F.col("required"))
    done = F.bool_and(F.col("status").isin("complete", "degraded", "skipped"))
    return df.groupBy(*keys).agg(F.when(failed, "failed").when(done, "complete").otherwise("partial").alias("status"))


def state_violations(df: DataFrame) -> DataFrame:
    """Rows that break the state rules, with the rule. df: value, state, confidence, refs (array), source, original."""
    value, state = F.col("value"), F.col("state")
    rule = (
        F.when(~state.isin(STATES), "unknown state")
        .when((state == "value") & value.isNull(), "value without value")
        .when(state.isin("absent", "absent-claimed", "unknown") & value.isNotNull(), "value in empty state")
        .when((state == "unmapped") & F.col("original").isNull(), "unmapped without original")
        .when((state != "unknown") & (F.size("refs") == 0), "no evidence")
        .when((state == "absent") & ~F.col("source").isin(DETECTORS), "absent by a model")
    )
    return df.withColumn("rule", rule).where("rule is not null")


def prefer(detector: DataFrame, model: DataFrame, compatible: dict[str, list[str]], keys: Sequence[str]) -> DataFrame:
    """Detector over model: value, source and a review reason where both speak and do not agree. Each side: keys, value."""
    both = detector.select(*keys, F.col("value").alias("_d")).join(model.select(*keys, F.col("value").alias("_m")), list(keys), "full")
    pairs = F.array(*[F.lit(f"{a}|{b}") for a, bs in compatible.items() for b in [a, *bs]]) if compatible else F.array().cast("array<string>")
    conflict = F.col("_d").isNotNull() & F.col("_m").isNotNull() & (F.col("_d") != F.col("_m")) & ~F.array_contains(pairs, F.concat_ws("|", "_d", "_m"))
    source = F.when(F.col("_d").isNotNull(), "detector").when(F.col("_m").isNotNull(), "model")
    return both.select(*keys, F.coalesce("_d", "_m").alias("value"), F.coalesce(source, F.lit("none")).alias("source"), F.when(conflict, "detector and model differ").alias("review"))


def latest(log: DataFrame, entity: Sequence[str], seq: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Last change of each entity by sequence; partial maxima before the shuffle keep a hot entity to one row a task."""
    last = F.max(F.struct(*seq, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_l")
    return log.groupBy(*entity).agg(last).select(*entity, *[F.col(f"_l._{c}").alias(c) for c in columns])


def overlay(base: DataFrame, log: DataFrame, entity: Sequence[str], seq: Sequence[str], value: str, new_value: str) -> tuple[DataFrame, DataFrame]:
    """Base rows with the last change of their entity (original keeps the prior value), and changes that match no row."""
    change = latest(log, entity, seq, [new_value]).withColumn("_hit", F.lit(True))
    rows = base.join(change, list(entity), "left").withColumn("original", F.when(F.col("_hit"), F.col(value)))
    rows = rows.withColumn(value, F.coalesce(new_value, value)).withColumn("changed", F.coalesce("_hit", F.lit(False))).drop("_hit", new_value)
    return rows, change.drop("_hit").join(base, list(entity), "left_anti")


def document_status(outdated: Column, confirmed: Column, corrected: Column) -> Column:
    return F.when(outdated, "outdated").when(confirmed, "confirmed").when(corrected, "underReview").otherwise("draft")


def stale(expected: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected work that cannot be reused, and why. expected: keys, fingerprint; manifest: keys, fingerprint, status, valid."""
    m = manifest.select(*keys, F.col("fingerprint").alias("_f"), F.col("status").alias("_s"), F.col("valid").alias("_v"), F.lit(True).alias("_row"))
    reason = F.when(F.col("_row").isNull(), "missing").when(~F.col("_v"), "invalid").when(F.col("_f") != F.col("fingerprint"), "changed").when(F.col("_s") != "complete", "incomplete")
    return expected.join(m, list(keys), "left").withColumn("reason", reason).where("reason is not null").drop("_f", "_s", "_v", "_row")


def chained_fingerprint(parts: Mapping[str, Column], size: int = 16) -> Column:
    """Fingerprint of an artifact from its named parts (upstream fingerprints, configuration, version): the hash of their JSON in order of names, so that a part that is null, one that
    is missing and one that holds a separator are all told apart."""
    named = F.struct(*(parts[name].alias(name) for name in sorted(parts)))
    return F.substring(F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256), 1, size)


def numbered_batches(df: DataFrame, order: Sequence[str], size: int, keys: Sequence[str]) -> DataFrame:
    """Adds batch: consecutive rows of a video in groups of ``size``, from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1) / size))
