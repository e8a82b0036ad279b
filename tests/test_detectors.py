"""The detectors' observations, shot by shot."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import observe as O
from strandline.operators.detectors import AGREEING, detected_observations, disagrees

SCHEMA = """k long, speech struct<segments:array<struct<place:int,text:string>>>, music struct<place:int,state:string,confidence:string>, energy struct<place:int,label:string>,
quality struct<place:int,flags:array<string>,confidence:string>, motion struct<place:int,camera:string,intensity:string,confidence:string>, boundary struct<place:int,type:string,confidence:string>"""
MODEL = "k long, status string, base_ref string, raw map<string,string>, sure map<string,string>"


def observed(spark, shots, replies):
    fields = ["visual.cameraMovement", *O.MODEL_FIELDS]
    model = O.model_observations(spark.createDataFrame(replies, MODEL), ["k"], {}, fields)
    out = detected_observations(spark.createDataFrame(shots, SCHEMA), model, ["k"])
    return {(r.k, r.field): r for r in out.collect()}, out


def test_nothing_ran(spark):
    got, out = observed(spark, [(1, None, None, None, None, None, None)], [])
    assert len(got) == 8 == len(O.DETECTED_FIELDS) and {f for _, f in got} == set(O.DETECTED_FIELDS)
    assert all((r.value, r.state, r.confidence, r.refs, r.source, r.review) == (None, "unknown", "unknown", [], "fallback", None) for r in got.values())
    assert set(O.COLUMNS) | {"k", "review"} == set(out.columns)
    assert observed(spark, [], [])[0] == {}


def test_each_detector(spark):
    shots = [
        (1, ([(3, " hello "), (4, "world\n")],), (2, "music", "medium"), (2, " 中 "), (2, [], "high"), (2, "pan_left", "low", "high"), (2, "hardCutCandidate", "medium")),
        (2, ([],), (0, "silent", "odd"), (0, " "), (0, ["a", "b"], "low"), (0, "static", "unknown", None), (0, "sourceStart", None)),
        (3, (None,), (1, "unknown", None), (1, None), (1, ["a"], "unknown"), (1, " ", None, "low"), (1, "fade", "low")),
        (4, None, (1, None, "high"), None, (1, None, "high"), (1, "roll", "high", "high"), (1, None, None)),
    ]
    replies = [
        (1, "succeeded", "m[0]", {"visual.cameraMovement": "摇 → 推", "visual.subjects": " cat ", "visual.setting": "none", "visual.props": "box"}, {"visual": "medium"}),
        (2, "succeeded", "m[1]", {"visual.cameraMovement": "none"}, {"visual": "high"}), (3, "succeeded", "m[2]", {"visual.cameraMovement": "推"}, {"visual": "high"}), (4, "failed", "m[3]", {"visual.cameraMovement": "推"}, {}),
    ]
    got, out = observed(spark, shots, replies)
    cell = lambda k, f: (r := got[k, f]) and (r.value, r.state, r.confidence, r.refs, r.source, r.original)
    asr, music = "raw/asr.json#transcript.segments", "raw/music-flags.json#shots"
    assert cell(1, "audio.speech") == ("hello world", "value", "high", [f"{asr}[3]", f"{asr}[4]"], "asr", None)
    assert cell(2, "audio.speech") == cell(3, "audio.speech") == (None, "unknown", "unknown", [asr], "asr", None)
    assert cell(1, "audio.bgmPresence") == ("有", "value", "medium", [f"{music}[2]"], "audioDetector", None)
    assert cell(2, "audio.bgmPresence") == (None, "absent", "high", [f"{music}[0]"], "audioDetector", None)
    assert cell(3, "audio.bgmPresence") == (None, "unknown", "unknown", [f"{music}[1]"], "audioDetector", "unknown")
    assert cell(1, "audio.energy") == ("中", "value", "high", ["raw/audio-energy.json#shots[2]"], "ffmpeg", None) and got[2, "audio.energy"].source == got[3, "audio.energy"].source == "fallback"
    assert [cell(k, "quality.flags")[:3] for k in (1, 2, 3, 4)] == [("", "value", "high"), ("a,b", "value", "low"), (None, "unknown", "unknown"), (None, "unknown", "high")]
    motion, field = "raw/camera-motion.json#shots", "visual.cameraMovement"
    assert cell(1, field) == ("pan_left", "value", "high", [f"{motion}[2]", f"m[0].{field}"], "appleVision", None) and "摇 → 推" in got[1, field].review
    assert cell(2, field) == ("static", "value", "unknown", [f"{motion}[0]"], "appleVision", None) and got[2, field].review is None
    assert cell(3, field) == ("推", "value", "high", [f"m[2].{field}"], "unifiedModel", None)
    assert cell(4, field)[0] == "roll" and got[4, field].review is None
    assert [cell(k, "visual.movementIntensity")[::5] for k in (1, 2, 3)] == [("low", None), (None, "unknown"), (None, None)]
    assert cell(1, "visual.contentSummary") == ("cat；box", "value", "medium", ["m[0].visual.subjects", "m[0].visual.props"], "aggregate", None) and got[2, "visual.contentSummary"].source == "fallback"
    assert [cell(k, "editing.transition")[:3] + (cell(k, "editing.transition")[5],) for k in (1, 2, 3, 4)] == [("硬切", "value", "medium", None), (None, "absent", "high", None), (None, "unknown", "low", "fade"), (None, "unknown", "unknown", None)]
    assert O.state_violations(out).count() == 0


@pytest.mark.parametrize(("movement", "state", "value", "odd"), [("static", "absent-claimed", None, False), ("pan_left", "absent-claimed", None, True), ("tilt_up", "value", "摇、升降", False), ("tilt_up", "value", "摇 → 推", True), ("roll", "value", "推", False), ("zoom_in", "unknown", None, False), ("zoom_in", "value", " 、", False), ("zoom_in", "unmapped", None, False)])
def test_disagreement(spark, movement, state, value, odd):
    row = spark.createDataFrame([(movement, state, value)], "m string, s string, v string").select(disagrees(F.col("m"), F.col("s"), F.col("v")).alias("odd")).first()
    assert row.odd is odd and "roll" not in AGREEING
