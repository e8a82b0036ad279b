"""Operators without SQL, or whose SQL could repeat a misreading, on rows derived by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import aggregate as A
from strandline.operators import documents as D
from strandline.operators import observe as O
from strandline.operators import quality as Q
from strandline.operators import replies as R
from strandline.operators import scoring
from strandline.operators import signal as G
from strandline.sources import corpus as C


def test_hue_is_a_circle(spark):
    rows = [(1, 1, [0.95], [0.5], [0.2], [0.0], [1.0, 0.0]), (1, 2, [0.05], [0.5], [0.6], [0.5], [0.25, 0.75])]
    df = spark.createDataFrame(rows, "video long, i long, hue array<double>, saturation array<double>, value array<double>, edges array<double>, histogram array<double>")
    r = G.pair_metrics(df, 0.5).first()
    assert r.content == pytest.approx(255 * (0.1 * 2 + 0 + 0.4) / 3) and r.edge == pytest.approx(127.5) and r.change == pytest.approx(r.content + 63.75) and r.score == -r.change
    assert r.edge_similarity == pytest.approx(0.5) and r.histogram_similarity == pytest.approx(0.25) and r.brightness_delta == pytest.approx(0.4)


def test_similarity_can_be_negative(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, 1.0], [1.0, 0.0, 1.0, 0.0], [0.3] * 4)], "x array<double>, y array<double>, z array<double>")
    r = df.select(G.global_ssim(F.col("x"), F.col("x")).alias("same"), G.global_ssim(F.col("x"), F.col("y")).alias("turned"), G.global_ssim(F.col("z"), F.col("z")).alias("flat")).first()
    assert r.same == pytest.approx(1) and r.turned < -0.9 and r.flat == pytest.approx(1)


def test_texture_events_equal_a_plain_loop(spark):
    rnd = random.Random(8)
    rows = [(v, i, i * rnd.choice([100, 101]), rnd.randint(0, 20) / 20) for v in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "video long, i long, time_ms long, flatness double")
    got = sorted((r.video, r.i, r.kind) for r in G.texture_events(df, 0.3, 450).collect())
    want = []
    for v in range(3):
        own = [r for r in rows if r[0] == v]
        steps = [(b[1], b[2], b[3] - a[3]) for a, b in zip(own, own[1:]) if abs(b[3] - a[3]) >= 0.3]
        kept = []
        for i, t, d in sorted(steps, key=lambda s: (-abs(s[2]), s[1])):
            if all(abs(t - u) >= 450 for _, u, _ in kept):
                kept.append((i, t, d))
        want += [(v, i, "textureRise" if d > 0 else "textureFall") for i, _, d in kept]
    assert got == sorted(want)


def test_regions_know_their_frames(spark):
    rows = [(1, i, i * 40, m, r, c, b) for i, (m, r, c, b) in enumerate([(0.1, 0.9, 0, 0), (0.1, 0.9, 0, 0), (5, 0, 9, 0), (5, 0, 1, -0.5), (1, 0, 0, 0), (9, 0, 0, 0), (9, 0, 0, 0), (9, 0, 0, 0)])]
    df = spark.createDataFrame([tuple(map(float, r[3:])) and (r[0], r[1], r[2], *map(float, r[3:])) for r in rows], "video long, i long, time_ms long, motion double, repeat double, cut double, bright double")
    limits = spark.createDataFrame([(1, 0.5, 2.0, 6.0, 8.0)], "video long, p20 double, p50 double, p80 double, cut90 double")
    got = {r.kind: r for r in G.speed_ramps(df, limits, 2, 0.18, 40).collect()}
    assert (got["low_motion_or_freeze"].refs, got["low_motion_or_freeze"].duration_ms, got["low_motion_or_freeze"].confidence) == ([0, 1], 80, "high")
    assert (got["impact_cut"].refs, got["impact_cut"].n, got["impact_cut"].confidence) == ([2], 2, "low") and (got["high_motion_region"].refs, got["high_motion_region"].confidence) == ([5, 7], "medium")


def test_golden_gate(spark):
    scores = spark.createDataFrame([(1, 0.8, 0.6), (2, 0.8, 0.5), (3, 0.1, 0.1)], "video long, recall double, precision double")
    limits = spark.createDataFrame([(1, 0.8, 0.6), (2, 0.8, 0.6)], "video long, least_recall double, least_precision double")
    assert {r.video: r.passed for r in A.golden_gate(scores, limits).collect()} == {1: True, 2: False, 3: True}


def test_sink_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k long, v string")
    ok, to = F.col("v").isNotNull(), str(tmp_path)
    first = C.write_valid(df.where("k < 3"), ok, to, "rows", "a").first()
    last = C.write_valid(df.where("k = 3"), ok, to, "rows", "b").first()
    assert (first.n_valid, first.n_quarantined, first.status) == (1, 1, "partial") and (last.n_valid, last.n_quarantined) == (2, 1) and last.updated_at > first.updated_at
    read = lambda quarantined=False: sorted(tuple(r) for r in C.read_valid(spark, to, "rows", df.schema, quarantined).collect())
    assert read() == [(1, "a"), (3, "b")] and read(True) == [(2, None)]
    other = C.write_valid(df.where("v is not null").orderBy(F.desc("k")), F.lit(True), str(tmp_path / "b"), "rows", "a").first()
    assert other.fingerprint == last.fingerprint and other.status == "complete"
    # a batch that is written again changes nothing, a row that repeats does
    again = C.write_valid(df.where("k = 3"), ok, to, "rows", "b").first()
    assert (again.fingerprint, again.n_valid, again.n_quarantined) == (last.fingerprint, 2, 1) and len(read()) == 2
    twice = C.write_valid(df.where("k = 3"), ok, to, "rows", "c").first()
    more = C.write_valid(df.where("k = 3"), ok, to, "rows", "d").first()
    assert len({last.fingerprint, twice.fingerprint, more.fingerprint}) == 3 and len(read()) == 4
    # a batch without its commit is not there
    df.write.parquet(f"{to}/rows/batch=e")
    assert len(read()) == 4 and C.manifest(spark, to).first().n_valid == 4
    assert C.read_valid(spark, to, "none", df.schema).count() == 0


def test_fingerprints_tell_parts_apart(spark):
    rows = [("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a", "", "b"), ("a", "b", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    assert len({r.f for r in df.select(O.chained_fingerprint({c: F.col(c) for c in "xyz"}).alias("f")).collect()}) == len(rows)
    first = df.select(O.chained_fingerprint({"y": F.col("y"), "x": F.col("x")}).alias("f")).first().f
    assert first == hashlib.sha256(b'{"x":"a","y":null}').hexdigest()[:16]


DOC = {"shots": [{"id": "A", "evidenceRefs": ["raw/a.json#shots[0].id", 5]}, {"id": None, "deep": [{"evidenceRefs": ["raw/b.json", "x.txt", "../a"]}]}], "evidenceRefs": "no list"}


def test_references_are_found_at_any_depth(spark):
    docs = spark.createDataFrame([("a", "raw/a.json", json.dumps(DOC)), ("c", "raw/c.json", "{broken"), ("d", "raw/d.json", None)], "artifact string, file string, doc string")
    refs = D.references(docs)
    assert sorted((r.path, r.ref) for r in refs.collect()) == sorted([("shots/[0]/evidenceRefs/[0]", "raw/a.json#shots[0].id"), ("shots/[0]/evidenceRefs/[1]", None), ("shots/[1]/deep/[0]/evidenceRefs/[0]", "raw/b.json"), ("shots/[1]/deep/[0]/evidenceRefs/[1]", "x.txt"), ("shots/[1]/deep/[0]/evidenceRefs/[2]", "../a")])
    known = spark.createDataFrame([("raw/a.json",), ("raw/b.json",)], "file string")
    got = {(r.path[-14:], r.severity, r.message) for r in Q.reference_rules(refs, known, docs, D.inventory(docs)).collect()}
    assert {(s, m) for _, s, m in got} == {("error", "no text"), ("warning", "artifact is missing"), ("error", "file does not exist"), ("error", "syntax: parent")}


def _paths(node, steps=()):
    yield "/".join(steps), {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(node)]
    for step, child in node.items() if isinstance(node, dict) else ((f"[{i}]", x) for i, x in enumerate(node)) if isinstance(node, list) else ():
        yield from _paths(child, (*steps, step))


def test_inventory_of_any_document(spark):
    """Brackets and quotes inside texts, escapes, depth, scalars at the root, texts that are no JSON; nothing of it runs in Python."""
    rnd = random.Random(11)

    def any_node(depth):
        if depth == 0 or rnd.random() < 0.2:
            return rnd.choice([None, True, 3, 2.5, 10**25, "", 'a"]}', "\\", "\\\"[", "[{", "\n", "日本"])
        return [any_node(depth - 1) for _ in range(rnd.randrange(4))] if rnd.random() < 0.5 else {rnd.choice("abc[]{}\"\\") + str(i): any_node(depth - 1) for i in range(rnd.randrange(4))}

    deep = 0
    for _ in range(60):
        deep = [deep] if rnd.random() < 0.5 else {"k": deep}
    values = {f"d{i}": any_node(6) for i in range(60)} | {"deep": deep, "wide": list(range(3000)), "evidenceRefs": [["x", {"evidenceRefs": "no list"}]]}
    rows = [(f, json.dumps(v, ensure_ascii=rnd.random() < 0.5)) for f, v in values.items()]
    found = D.inventory(spark.createDataFrame([*rows, ("bad", '{"a": [1'), ("none", None), ("empty", "")], "file string, doc string"))
    want = sorted([(f, *p) for f, v in values.items() for p in _paths(v)] + [(f, "", "null") for f in ("bad", "none", "empty")])
    assert sorted(map(tuple, found.collect())) == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert D.inventory(spark.createDataFrame([], "file string, doc string")).count() == 0
    assert D.inventory(spark.createDataFrame([("a", "[" * 5000 + "]" * 5000), ("b", '{"a": 1, "a": 2}')], "file string, doc string")).count() == 2


@pytest.mark.parametrize(
    ("pointer", "error"),
    [("shots", None), ("shots[1].id", None), ("shots[2]", "out of bounds"), ("shots.id", "wrong type"), ("shots[0][0]", "wrong type"), ("shots[0].name", "missing key"), ("shots[0].id.x", "wrong type"), ("shots[0]..id", "bad segment"), ("", "bad segment"), ("evidenceRefs", None)],
)
def test_pointers(spark, pointer, error):
    docs = spark.createDataFrame([("a", json.dumps(DOC))], "file string, doc string")
    refs = spark.createDataFrame([("a", pointer), ("z", "shots")], "file string, pointer string")
    assert {r.file: r.error for r in D.resolve_pointers(refs, D.inventory(docs)).collect()} == {"a": error, "z": "no document"}


def test_model_fields(spark):
    raw = {"visual.subjects": "None", "visual.setting": " City ", "visual.framing": "close", "audio.bgmStyle": "unknown", "visual.actions": None}
    df = spark.createDataFrame([(1, "succeeded", "b", raw, {"visual": "high", "audio": "sure"}), (2, "failed", "b", raw, {}), (3, "succeeded", None, raw, {})], "k long, status string, base_ref string, raw map<string,string>, sure map<string,string>")
    rows = O.model_observations(df, ["k"], {"visual.framing": {"Close": "CU", "wide": "WS"}, "visual.setting": {"city": "CITY", "City": "Exact"}}).collect()
    assert len(rows) == 3 * 23 and all(r.state == "unknown" and r.refs == [] for r in rows if r.k != 1)
    got = {r.field: (r.state, r.value, r.confidence, r.refs, r.original) for r in rows if r.k == 1}
    assert got["visual.subjects"] == ("absent-claimed", None, "high", ["b.visual.subjects"], "None")
    assert got["visual.setting"] == ("value", "Exact", "high", ["b.visual.setting"], None)  # the exact value before its alias
    assert got["visual.framing"] == ("unmapped", None, "high", ["b.visual.framing"], "close")
    assert got["audio.bgmStyle"] == ("unknown", None, "unknown", ["b.audio.bgmStyle"], "unknown") and got["visual.actions"][0] == "unknown"
    assert got["visual.props"] == ("unknown", None, "unknown", ["b"], None)


def test_completion_policies(spark):
    rows = [(1, "a", "value", False, ["x.json#p"]), (1, "b", "unknown", False, []), (2, "a", "unmapped", False, ["x.json#p"]), (2, "b", "absent", False, ["/x"])]
    df = spark.createDataFrame(rows, "shot long, field string, state string, verified boolean, refs array<string>")
    got = {r.shot: (r.unmet, r.satisfied) for r in O.completion(df, ["shot"], ["a", "b"]).collect()}
    assert got == {1: ([], True), 2: (["a: unsettled unmapped", "a: unverified unmapped", "b: bad reference"], False)}
    strict = {r.shot: r.unmet for r in O.completion(df, ["shot"], ["a", "b", "c"], allow_unknown=False, check_refs=False).collect()}
    assert strict == {1: ["b: unknown", "b: unsettled unknown", "c: missing"], 2: ["a: unsettled unmapped", "a: unverified unmapped", "c: missing"]}


@pytest.mark.parametrize(
    ("text", "inside"),
    [("```json\n{}\n```", "{}"), (" ```\n a\nb \n``` \n", "a\nb"), ("```json {}```", "```json {}```"), ("```x y\n{}\n```", "```x y\n{}\n```"), ("```\n```json\n{}\n```\n```", "```json\n{}\n```"), (" {} ", "{}"), ("```\n{}", "```\n{}")],
)
def test_one_fence_is_stripped(spark, text, inside):
    assert spark.createDataFrame([(text,)], "t string").select(R.unfenced("t").alias("x")).first().x == inside


def test_scorer_falls_from_batch_to_single_to_failed(spark):
    def scorer(texts):
        if len(texts) > 1 and "bad" in texts:
            raise ValueError("refused")
        if texts == ["bad"]:
            raise scoring.TransientError
        return [float(len(t)) for t in texts]

    rows = [(i, t) for i, t in enumerate(["a", "bb", "bad", "c", "dd", None])]
    got = {r.k: (r.score, r.status, r.attempts) for r in scoring.scored(spark.createDataFrame(rows, "k long, t string").coalesce(1), "k", "t", scorer).collect()}
    assert got == {0: (1.0, "single", 2), 1: (2.0, "single", 2), 2: (None, "failed", 4), 3: (1.0, "single", 2), 4: (2.0, "batch", 1), 5: (0.0, "batch", 1)}


def test_story_in_order(spark):
    shots = spark.createDataFrame([(1, f"s{i}", i, i * 10, i * 10 + 10) for i in range(1, 5)], "video long, shot string, seq long, start_ms long, end_ms long")

    def check(blocks, slots, status="complete"):
        b = spark.createDataFrame([(1, n, s, e, r) for n, s, e, r, _ in blocks], "video long, block string, start_ms long, end_ms long, relation string")
        m = spark.createDataFrame([(1, n, j, x) for n, _, _, _, ids in blocks for j, x in enumerate(ids)], "video long, block string, j long, shot string")
        s = spark.createDataFrame([(1, "S1", j, x) for j, x in enumerate(slots)], "video long, slot string, j long, block string")
        return sorted(r.message for r in Q.story_rules(b, m, shots, s, spark.createDataFrame([(1, status)], "video long, status string")).collect())

    good = [("B1", 10, 30, "leads → B2", ["s1", "s2"]), ("B2", 30, 50, None, ["s3", "s4"])]
    assert check(good, ["B1", "B2"]) == []
    assert check(good, ["B1"]) == ["in no slot"] and check(good, ["B1"], "partial") == [] and check(good, ["B1", "B2", "B9"]) == ["unknown block"]
    assert check([("B1", 10, 30, "→ B1, → B7", ["s1", "s2"]), good[1]], ["B1", "B2"]) == ["relation to itself", "unknown target"]
    assert check([("B1", 20, 20, None, ["s2", "s1"]), good[1]], ["B1", "B2"]) == ["shots out of order"]
    assert check([("B1", 10, 40, None, ["s1", "s3"]), ("B2", 20, 50, None, ["s2", "s4"])], ["B1", "B2"]) == ["blocks do not cover the sequence"]
    assert check([("B1", 10, 30, None, ["s1", "s2"]), ("B2", 30, 40, None, ["s3"])], ["B1", "B2"]) == ["blocks do not cover the sequence", "in no block"]
