"""The fields that detectors, transcripts and rules fill, from their own results: eight observations a shot, beside the model's (see ``observe.model_observations``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence as confidence_of
from ..functions.scalars import confidence_of_rank, confidence_rank

#: What a content summary is made of, in order, and the model's field that the detector of camera movement precedes (fixed values).
SUMMARY_FIELDS = ("visual.subjects", "visual.actions", "visual.setting", "visual.props")
CAMERA_FIELD = "visual.cameraMovement"
#: Detected movement and the model's words that agree with it; movements that are not listed are not compared (fixed values).
AGREEING = {
    "static": ["固定"], "zoom_in": ["推"], "zoom_out": ["拉"], "pan_left": ["摇", "移"], "pan_right": ["摇", "移"], "tilt_up": ["摇", "升降"], "tilt_down": ["摇", "升降"], "handheld": ["手持"],
}
_TOLD = "struct<value:string,state:string,confidence:string,refs:array<string>,source:string,original:string,review:string>"


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _told(state: str, source: str, confidence: str | Column, refs: Column, value: Column | None = None, original: Column | None = None, review: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if value is None else value).alias("value"), F.lit(state).alias("state"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), refs.alias("refs"),
        F.lit(source).alias("source"), (none if original is None else original).alias("original"), (none if review is None else review).alias("review")).cast(_TOLD)


def disagrees(movement: Column, state: Column, value: Column) -> Column:
    """Whether the model contradicts a detected movement: it says that there is none while something moves, or one of its words (joined by an arrow or an enumeration comma) does not agree."""
    words = F.filter(F.transform(F.split(value, "→|、"), _clean), lambda w: w != "")
    agreeing = F.create_map(*[x for k, v in AGREEING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fine = F.try_element_at(agreeing, movement)
    odd = F.when(state == "absent-claimed", movement != "static").when(state == "value", F.exists(words, lambda w: ~F.array_contains(fine, w)))
    return fine.isNotNull() & F.coalesce(odd, F.lit(False))


def detected_observations(shots: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, field, value, state, confidence, refs, source, verified, original and review (why a person should look, null mostly): eight rows a shot, whatever was not run.

    shots: one struct an artifact, null where the detector did not run or has no entry for the shot; place is the entry's position. speech (segments: array of place, text, in order), music (place, state,
    confidence), energy (place, label), quality (place, flags, confidence), motion (place, camera, intensity, confidence), boundary (place, type, confidence). model: the model's observations in long form;
    its camera movement and summary fields are used.

    Silence of a transcript is unknown, never absent. A silent shot and the source's start are absent. An empty list of flags is a value. The detector of movement goes before the model, and both
    stand as evidence where they disagree. A summary joins what the model saw, with the least of its confidences."""
    c = F.col
    said = F.struct("value", "state", "confidence", "refs", "original")
    heard = model.where(c("field").isin(CAMERA_FIELD, *SUMMARY_FIELDS)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", said))).alias("_model"))
    rows = shots.join(heard, list(keys), "left")
    none = F.array().cast("array<string>")
    silent = _told("unknown", "fallback", "unknown", none)
    at = lambda doc, part: F.array(F.concat(F.lit(f"raw/{doc}.json#shots["), c(f"{part}.place").cast("string"), F.lit("]")))
    sure = lambda part: confidence_of(c(f"{part}.confidence"))
    certain = lambda part: F.when(sure(part) == "unknown", "high").otherwise(sure(part))
    ran = lambda part: c(part).isNotNull()

    segments = c("speech.segments")
    spoken = F.transform(segments, lambda s: F.concat(F.lit("raw/asr.json#transcript.segments["), s["place"].cast("string"), F.lit("]")))
    speech = (
        F.when(~ran("speech"), silent).when(F.coalesce(F.size(segments), F.lit(0)) <= 0, _told("unknown", "asr", "unknown", F.array(F.lit("raw/asr.json#transcript.segments"))))
        .otherwise(_told("value", "asr", "high", spoken, F.array_join(F.transform(segments, lambda s: _clean(s["text"])), " ")))
    )
    ref, state = at("music-flags", "music"), c("music.state")
    music = (
        F.when(~ran("music"), silent).when(state == "music", _told("value", "audioDetector", sure("music"), ref, F.lit("有"))).when(state == "silent", _told("absent", "audioDetector", certain("music"), ref))
        .otherwise(_told("unknown", "audioDetector", sure("music"), ref, original=state))
    )
    label = _clean(c("energy.label"))
    energy = F.when(F.coalesce(label, F.lit("")) != "", _told("value", "ffmpeg", "high", at("audio-energy", "energy"), label)).otherwise(silent)
    ref, flags = at("quality-flags", "quality"), c("quality.flags")
    quality = (
        F.when(~ran("quality"), silent).when((sure("quality") == "unknown") | flags.isNull(), _told("unknown", "ffmpeg", sure("quality"), ref))
        .otherwise(_told("value", "ffmpeg", sure("quality"), ref, F.array_join(flags, ",")))
    )
    ref, move, intensity = at("camera-motion", "motion"), _clean(c("motion.camera")), _clean(c("motion.intensity"))
    seen = F.try_element_at("_model", F.lit(CAMERA_FIELD))
    odd = disagrees(move, seen["state"], seen["value"])
    why = F.concat(F.lit(f"{CAMERA_FIELD}: detector {{"), move, F.lit("}, model {"), F.coalesce(seen["original"], seen["value"], F.lit("")), F.lit("}"))
    camera = (
        F.when(~F.coalesce(move, F.lit("")).isin("", "unknown"), _told("value", "appleVision", sure("motion"), F.when(odd, F.concat(ref, seen["refs"])).otherwise(ref), move, review=F.when(odd, why)))
        .when(seen["state"] != "unknown", F.struct(seen["value"].alias("value"), seen["state"].alias("state"), seen["confidence"].alias("confidence"), seen["refs"].alias("refs"), F.lit("unifiedModel").alias("source"), seen["original"].alias("original"), F.lit(None).cast("string").alias("review")).cast(_TOLD))
        .when(ran("motion"), _told("unknown", "appleVision", sure("motion"), ref)).otherwise(silent)
    )
    moving = (
        F.when(~ran("motion"), silent).when(F.coalesce(intensity, F.lit("")).isin("", "unknown"), _told("unknown", "appleVision", sure("motion"), ref, original=c("motion.intensity")))
        .otherwise(_told("value", "appleVision", sure("motion"), ref, intensity))
    )
    views = F.filter(F.transform(F.array(*map(F.lit, SUMMARY_FIELDS)), lambda f: F.try_element_at(c("_model"), f)), lambda v: F.coalesce((v["state"] == "value") & (_clean(v["value"]) != ""), F.lit(False)))
    rank = confidence_of_rank(F.array_min(F.transform(views, lambda v: confidence_rank(v["confidence"]))))
    summary = F.when(F.size(views) > 0, _told("value", "aggregate", rank, F.flatten(F.transform(views, lambda v: v["refs"])), F.array_join(F.transform(views, lambda v: _clean(v["value"])), "；"))).otherwise(silent)
    ref, kind = F.transform(at("shots", "boundary"), lambda r: F.concat(r, F.lit(".boundaryIn"))), c("boundary.type")
    transition = (
        F.when(~ran("boundary"), silent).when(kind == "hardCutCandidate", _told("value", "ffmpeg", sure("boundary"), ref, F.lit("硬切"))).when(kind == "sourceStart", _told("absent", "ffmpeg", certain("boundary"), ref))
        .otherwise(_told("unknown", "ffmpeg", sure("boundary"), ref, original=kind))
    )
    fields = {"audio.speech": speech, "audio.bgmPresence": music, "audio.energy": energy, "quality.flags": quality, CAMERA_FIELD: camera, "visual.movementIntensity": moving, "visual.contentSummary": summary, "editing.transition": transition}
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(name).alias("field"), told.alias("t")) for name, told in fields.items()))).alias("o"))
    return each.select(*keys, "o.field", "o.t.value", "o.t.state", "o.t.confidence", "o.t.refs", "o.t.source", F.lit(False).alias("verified"), "o.t.original", "o.t.review")
