"""Hand-derived rows for the semantics that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import aggregate as A
from strandline.operators import islands as I
from strandline.operators import joins as J
from strandline.operators import observe as O
from strandline.operators import quality as Q
from strandline.operators import signal as G
from strandline.operators.vocabulary import normalize
from strandline.plans import oracle_sql, queries
from strandline.sources import corpus as C


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def segments(spark, *rows):
    return spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(rows)], "video long, pos long, start_ms long, end_ms long")


def test_three_gap_rules(spark):
    df = segments(spark, (0, 100), (200, 300))
    assert I.merge_intervals(df, 100).count() == 1  # joins at equality
    assert I.speech_runs(df, 100).count() == 2  # splits at equality
    assert I.merge_intervals(segments(spark, (0, 100), (100, 150)), 0).count() == 1
    assert I.union_length(df).first().union_ms == 200


def test_run_ends_at_largest_end(spark):
    run = I.speech_runs(segments(spark, (0, 900), (10, 20), (500, 600)), 100).first()
    assert (run.start_ms, run.end_ms, run.n) == (0, 900, 3)


def test_smooth_mask_fills_then_drops(spark):
    mask = [0, 1, 0, 1, 0, 0, 1, 0]
    df = spark.createDataFrame([(1, i, bool(m)) for i, m in enumerate(mask)], "video long, i long, m boolean")
    got = [r.m for r in I.smooth_mask(df, "m", 1, 3).orderBy("i").collect()]
    assert got == [False, True, True, True, False, False, False, False]
    blocked = [r.m for r in I.smooth_mask(df, "m", 1, 3, F.col("i") == 2).orderBy("i").collect()]
    assert not any(blocked)


def test_first_and_last_pair_have_no_ratio(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([9.0, 1.0, 100.0, 1.0, 9.0])], "video long, i long, value double")
    ratio = [r.ratio for r in G.adaptive_ratio(df).orderBy("i").collect()]
    assert ratio[0] is None and ratio[-1] is None and ratio[2] == 100 / 5


def test_peaks_exclude_plateaus_of_three(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([9.0, 1.0, 5.0, 5.0, 1.0, 7.0, 7.0, 7.0, 1.0, 8.0])], "video long, i long, value double")
    assert [r.i for r in G.local_peaks(df, 2).orderBy("i").collect()] == [0, 2, 3, 5, 7, 9]


def test_rounding(spark):
    got = one(spark, a=S.seconds_to_ms(F.lit("0.0125")), b=S.seconds_to_ms(F.lit("1.0005")), c=S.seconds_to_ms_half_even(F.lit(0.0125)), d=S.seconds_to_ms(F.lit("x")))
    assert got == {"a": 13, "b": 1001, "c": 12, "d": None}


def test_containment(spark):
    c = lambda s, e, t, u=None: S.contains(F.lit(s), F.lit(e), F.lit(t), None if u is None else F.lit(u))
    assert one(spark, a=c(0, 10, 10), b=c(0, 10, 0), c=c(5, 5, 5), d=c(5, 5, 6), e=c(0, 10, 2, 10)) == {"a": False, "b": True, "c": True, "d": False, "e": True}


def test_references(spark):
    ref = lambda x: S.evidence_ref(F.lit(x))["reason"]
    got = one(spark, a=ref("raw/x.json#a[0]"), b=ref("raw/x.json"), c=ref("/x"), d=ref("a/../b"), e=ref("x#"), f=ref(""), g=ref("#p"), h=ref("a\\b"))
    assert got == {"a": None, "b": None, "c": "absolute", "d": "parent", "e": "no pointer", "f": "empty", "g": "no file", "h": "backslash"}


def test_ids(spark):
    assert one(spark, a=S.entity_id("SH", F.lit(7)), b=S.entity_id("SH", F.lit(12345)), c=S.keyframe_id(F.lit("SH0001"), F.lit(100)), d=S.keyframe_id(F.lit("SH0001"), F.lit(3))) == {"a": "SH0007", "b": "SH12345", "c": None, "d": "F_SH0001_K03"}


def test_one_unknown_part_unmaps_the_whole(spark):
    df = spark.createDataFrame([("a、b",), ("a、x",), ("A",), (None,)], "raw string")
    assert [(r.state, r.value) for r in normalize(df, "raw", {"a": "甲", "b": "乙"}).collect()] == [("value", "甲、乙"), ("unmapped", None), ("value", "甲"), ("unknown", None)]


def test_mode_takes_first_seen(spark):
    df = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (1, "a", 3), (1, "z", 4), (1, "unknown", 0)], "video long, v string, pos long")
    assert A.modal(df, "v", ["pos"]).first().v == "z"


def test_speech_rules_differ(spark):
    seg = spark.createDataFrame([(1, 0, 0, 100)], "video long, pos long, s1 long, e1 long")
    shots = spark.createDataFrame([(1, 1, 0, 60), (1, 2, 60, 200)], "video long, seq long, s2 long, e2 long")
    assert [r.seq for r in J.attribute(seg, shots, 50).orderBy("seq").collect()] == [1]
    assert J.overlap_join(seg, shots, 50).count() == 2


def test_tail_points(spark):
    shots = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20)], "video long, seq long, start_ms long, end_ms long")
    points = spark.createDataFrame([(1, -5), (1, 0), (1, 10), (1, 20), (1, 99)], "video long, time_ms long")
    place = lambda tail: [r.seq for r in J.point_in_shot(points, shots, tail=tail).orderBy("time_ms").collect()]
    assert place(False) == [None, 1, 2, None, None] and place(True) == [None, 1, 2, 2, 2]


def test_dominant_fallbacks(spark):
    shots = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 50, 60), (2, 1, 0, 5)], "video long, seq long, s1 long, e1 long")
    runs = spark.createDataFrame([(1, 0, 20, 30), (1, 1, 35, 45)], "video long, run long, s2 long, e2 long")
    assert {(r.video, r.seq): r.run for r in J.dominant_overlap(shots, runs, 8).collect()} == {(1, 1): 0, (1, 2): 1, (2, 1): -1}


def test_boundary_shift_against_original_bounds(spark):
    shots = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 100, 200), (1, 3, 200, 300)], "video long, seq long, start_ms long, end_ms long")
    cuts = spark.createDataFrame([(1, 100, 140, "synchronizedCut", "high"), (1, 200, 160, "synchronizedCut", "high")], "video long, cut_ms long, audio_ms long, classification string, confidence string")
    moves = I.plan_shifts(shots, cuts, 50)
    assert moves.count() == 2  # together they leave a shot of 20 ms
    assert [(r.start_ms, r.end_ms) for r in I.apply_shifts(shots, moves).orderBy("seq").collect()] == [(0, 140), (140, 160), (160, 300)]


def test_overlay_takes_sequence_not_time(spark):
    base = spark.createDataFrame([("a", "x", "old"), ("b", "x", "old")], "e string, f string, v string")
    log = spark.createDataFrame([("a", "x", 1, "n1"), ("a", "x", 2, "n2"), ("z", "x", 1, "n")], "e string, f string, seq long, n string")
    rows, lost = O.overlay(base, log, ["e", "f"], ["seq"], "v", "n")
    assert {r.e: (r.v, r.original) for r in rows.collect()} == {"a": ("n2", "old"), "b": ("old", None)}
    assert [r.e for r in lost.collect()] == ["z"]


def test_one_broken_shot_gives_one_issue(spark):
    ranges = spark.createDataFrame([(1, 0, 30)], "video long, range_start long, range_end long")
    good = [(1, 1, 0, 10, 10), (1, 2, 10, 20, 10), (1, 3, 20, 30, 10)]
    names = "video long, seq long, start_ms long, end_ms long, duration_ms long"
    check = lambda rows: [r.message for r in Q.shot_rules(spark.createDataFrame(rows, names), ranges, F.lit(False)).collect()]
    assert check(good) == []
    assert check([good[0], (1, 2, 10, 20, 11), good[2]]) == ["duration"]
    assert check([*good[:2], (1, 3, 20, 29, 9)]) == ["range end not covered"]
    assert check([good[0], good[1], (1, 4, 20, 30, 10)]) == ["sequence"]
    assert check([good[0], (1, 2, 12, 20, 8), good[2]]) == ["not adjacent"]


def test_migration_rejects_other_versions(spark):
    m = "map<string,string>"
    schema = f"version int, visual {m}, audio {m}, components {m}, editing {m}, confidence {m}"
    df = spark.createDataFrame([(1, {"texture": "grain", "content": "x", "own": "y"}, {"speech": "s"}, {}, {"transition": "cut"}, {"editing": "high", "visual": "low"})], schema)
    row = C.upgrade_shots(df).first()
    assert (row.version, row.visual, row.audio) == (2, {"imageTexture": "grain", "own": "y"}, {}) and row.confidence == {"visual": "low", "function": "high"}
    assert row.legacy == {"visual.content": "x", "audio.speech": "s", "editing.transition": "cut", "confidence.editing": "high"}
    with pytest.raises(Exception, match="unknown schema version"):
        C.upgrade_shots(df.withColumn("version", F.lit(3))).collect()


def test_sql_names_registered_queries():
    assert set(oracle_sql()) <= set(queries())
