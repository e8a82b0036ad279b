"""From the text of replies to accepted rows: types are not coerced, and what is wrong is told."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import replies as R


@pytest.mark.parametrize(
    ("shot", "verdict"),
    [({"look": "a"}, "ok"), ({"look": 7}, "schema"), ({"look": True}, "schema"), ({"look": {"x": "a"}}, "schema"), ({"look": None}, "schema"), ({}, "schema"), ({"look": "a", "shotID": 0}, "schema"), ({"look": "a", "shotID": "S9"}, "ids"), ({"look": "", "more": 5}, "ok")],
)
def test_group_reply_takes_text_for_text_only(spark, shot, verdict):
    reply = json.dumps({"shots": [{"shotID": "S0"} | shot]})
    row = R.group_reply(spark.createDataFrame([(reply, ["S0"])], "reply string, ids array<string>"), "reply", "ids", ["look"]).first()
    assert row.verdict == verdict and (row.shots is not None) == (verdict == "ok")


def test_group_replies_that_are_no_replies(spark):
    rows = [(t, ["S0"]) for t in (None, "", "x", "[]", "5", '{"shots": {}}', '{"shots": [1]}', '{"shots": null}')] + [('{"shots": []}', [])]
    got = [r.verdict for r in R.group_reply(spark.createDataFrame(rows, "reply string, ids array<string>"), "reply", "ids", ["look"]).collect()]
    assert got == ["not json"] * 3 + ["schema"] * 5 + ["ok"]


def test_pair_semantics_with_confidence_and_issues(spark):
    good = {"relation": "cut", "editMotivations": ["a", 5, "zz", "b"], "relationSummary": " s "}
    rows = [(0, json.dumps(good)), (1, json.dumps({"relation": " cut", "editMotivations": ["zz"], "relationSummary": 7})), (2, json.dumps({"relation": 1, "editMotivations": "a"})), (3, "{"), (4, "[]")]
    got = R.pair_semantics(spark.createDataFrame(rows, "k long, reply string"), "reply", {"relation": ["cut", "fade"]}, ["a", "b"], F.concat(F.lit("raw/p.json#relations["), "k", F.lit("]"))).orderBy("k").collect()
    assert [(r.relation_state, r.relation_value, r.relation_confidence) for r in got] == [("value", "cut", "medium")] + [("unknown", None, "unknown")] * 4
    assert [(r.motivations_state, r.motivations_value, r.motivations_confidence) for r in got] == [("value", ["a", "b"], "low"), ("absent-claimed", None, "low")] + [("unknown", None, "unknown")] * 3
    assert [(r.summary_value, r.summary_confidence) for r in got] == [("s", "low")] + [(None, "unknown")] * 4
    assert [r.issues for r in got] == [["motivations"], ["relation", "motivations", "summary"], ["relation", "motivations", "summary"], None, None]
    assert got[3].refs == ["raw/p.json#relations[3].semantic.raw"] and [r.parsed for r in got] == [True] * 3 + [False] * 2


def test_story_replies(spark):
    def block(name, **more):
        return {"storyBlockID": name} | more

    slot = {"slotID": "S001", "slotType": "hook, odd", "blockIDs": ["B0", "B1", "B0"], "slotRationale": " r "}
    two = [block("B0"), block("B1")]
    cases = {
        "ok": ({"blocks": [block("B0", shotIDs=["1", "2"], startMs=0, endMs=10.0, primaryRole=" hook ", informationRole="fact、zz, view，fact", blockTitle=" t "), block("B1", primaryRole=5, coreContent=7)], "slots": [slot]}, []),
        "numbers for text": ({"blocks": [block("B0", shotIDs=[1, 2]), block("B1")], "slots": [slot]}, ["shots moved"]),
        "text for numbers": ({"blocks": [block("B0", startMs="0"), block("B1")], "slots": [slot]}, ["bounds moved"]),
        "null shots": ({"blocks": [block("B0", shotIDs=None), block("B1")], "slots": [slot]}, ["shots moved"]),
        "no slots": ({"blocks": two}, ["block without slot"]),
        "slots no list": ({"blocks": two, "slots": {}}, ["slots are no list"]),
        "odd entries": ({"blocks": [*two, 5], "slots": [slot]}, ["block is no object"]),
        "odd slot": ({"blocks": two, "slots": [slot, "x"]}, ["slot is no object"]),
        "ids": ({"blocks": [block(0), block("B1")], "slots": [slot]}, ["block ids"]),
        "array": ([], ["no object"]),
        "slot ids": ({"blocks": two, "slots": [slot | {"blockIDs": None}, slot | {"slotID": "S002", "slotType": "zz"}]}, ["slot type", "slot without blocks"]),
    }
    names = list(cases)
    replies = spark.createDataFrame([(i, json.dumps(cases[n][0])) for i, n in enumerate(names)], "video long, reply string")
    scaffold = spark.createDataFrame([(i, b, s, x, y) for i in range(len(names)) for b, s, x, y in (("B0", ["1", "2"], 0, 10), ("B1", ["3"], 10, 20))], "video long, block string, shots array<string>, start_ms long, end_ms long")
    rules, blocks, slots = R.story_reply(replies, "reply", scaffold, {"primaryRole": ["hook"]}, {"informationRole": ["fact", "view"]}, ["coreContent"], ["hook"])
    told = {}
    for r in rules.collect():
        told.setdefault(names[r.video], []).append(r.rule)
    assert {n: sorted(told.get(n, [])) for n in names} == {n: c[1] for n, c in cases.items()}
    kept = sorted((r.video, r.block, r.shots, r.start_ms, r.title, r.primaryRole, r.informationRole, r.coreContent) for r in blocks.collect())
    assert kept == [(0, "B0", ["1", "2"], 0, "t", "hook", "fact、view", ""), (0, "B1", ["3"], 10, None, "unknown", "unknown", "7")]
    assert [(r.video, r.slot, r.types, r.blocks, r.rationale) for r in slots.collect()] == [(0, "S001", "hook", ["B0", "B1"], "r")]
