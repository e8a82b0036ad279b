"""Results that once differed from their SQL on tables larger than those of the other tests."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq

from strandline import plans
from strandline.operators import documents as D
from strandline.operators import observe as O
from strandline.operators import quality as Q
from strandline.operators import replies as R
from strandline.operators import rules
from strandline.operators import signal as G
from strandline.operators.rules import together
from strandline.plans import bindings, observing


def test_thresholds_round_like_the_sql(spark):
    """Interpolated in one fused step and rounded as a scaled double: values at a half of the fourth place fall to the same side."""
    rnd = random.Random(1)
    columns = list(dict.fromkeys(c for c, _ in G.THRESHOLDS.values()))
    rows = [(v, *(rnd.randint(1, 20000) / 100 * k / 1000 for k in range(1, len(columns) + 1))) for v in range(400) for _ in range(40 + v % 25)]
    df = spark.createDataFrame(rows, "video long, " + ", ".join(f"{c} double" for c in columns))
    got = {r.video: r for r in G.adaptive_thresholds(df).collect()}
    for v in range(400):
        for name, (c, q) in G.THRESHOLDS.items():
            x = sorted(r[1 + columns.index(c)] for r in rows if r[0] == v)
            at = (len(x) - 1) * q
            d = at - math.floor(at)
            exact = math.fma(x[math.floor(at)], 1 - d, x[math.ceil(at)] * d)
            assert got[v][name] == math.floor(exact * 10000 + 0.5) / 10000, (v, name)


def test_a_video_of_one_block_breaks_only_its_own_rule(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(hours=k % 3), u, "view", 1.0, "{}") for k, u in enumerate(u for u in (10, 109, 12) for _ in range(3))]
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    pq.write_table(pa.table({n: pa.array(list(c), pa.timestamp("us") if n == "ts" else None) for n, c in zip(names, zip(*rows))}), tmp_path / "events.parquet")
    got = {r.video: (r.rules, r.accepted) for r in plans.queries()["story_fill_validation"](spark, str(tmp_path)).collect()}
    assert got == {10: ("block without slot", False), 109: ("block without slot,slot twice", False), 12: ("block ids", False)}


def test_a_union_of_rules_has_bounded_tasks(spark):
    parts = [spark.range(0, 8, 1, 8) for _ in range(10)]
    assert together(parts).rdd.getNumPartitions() == 16 and together(parts).count() == 80  # four times the four of a shuffle here


def test_completion_broadcasts_no_observations(spark):
    found = spark.range(50).selectExpr("id as shot", "'f' as field", "if(id % 2 = 0, 'value', 'unmapped') as state", "array('raw/a.json#x[0]') as refs", "true as verified")
    got = O.completion(found, ["shot"], ["f", "g"])
    assert {tuple(r.unmet) for r in got.collect()} == {("g: missing",), ("f: unsettled unmapped", "g: missing")}
    assert "merge" in found.hint("merge")._jdf.queryExecution().logical().toString() and "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_parts_are_made_by_many_tasks(spark, tmp_path):
    spark.range(20).selectExpr("id as p_partkey", "'a b' as p_type", "'c' as p_brand", "'d' as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert observing.model_shots(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_assembly_counts_without_a_second_pass(spark):
    shots = spark.createDataFrame([(1, 1, 1, True), (1, 1, 2, True), (1, 2, 3, False), (1, 2, 4, True), (2, 5, 6, False)], "video long, part long, shot long, ok boolean")
    got = R.assembled(shots, ["video"], "part")
    assert {(r.video, r.part, tuple(r.shots), r.batch, r.succeeded, r.failed) for r in got.collect()} == {(1, 1, (1, 2), 0, 3, 1), (1, 2, (3,), 1, 3, 1), (1, 2, (4,), 2, 3, 1), (2, 5, (6,), 0, 0, 1)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_shots_are_dealt_by_number(spark):
    assert bindings.ev_shots(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_only_metrics_that_pairs_lack_make_facts(spark):
    shots = spark.createDataFrame([(1, "1", 1, 10), (1, "2", 2, 20), (1, "3", 3, 30)], "video long, shot string, seq long, end_ms long")
    pairs = spark.createDataFrame([(1, 1, "1--2", "1", 10), (1, 2, "2--3", "2", 20)], "video long, pos long, pair string, left string, boundary_ms long")
    there = [(1, p, m, "value", ["r"]) for p in ("1--2", "2--3") for m in (*Q.METRICS, Q.METRICS[0], "other") if (p, m) != ("2--3", Q.METRICS[6])]
    metrics = spark.createDataFrame(there, "video long, pair string, name string, status string, refs array<string>")
    assert Q.relation_facts(pairs, metrics, shots).count() == 1  # 33 with a fact for each metric
    assert [(r.path, r.message) for r in Q.relation_rules(pairs, metrics, shots).collect()] == [(f"1/2--3/{Q.METRICS[6]}", "metric is missing")]
    twice = pairs.unionByName(pairs.where("pos = 2").withColumn("pos", pairs.pos + 1))
    assert [r.path for r in Q.relation_rules(twice, metrics, shots).where("message = 'metric is missing'").collect()] == [f"1/2--3/{Q.METRICS[6]}"] * 2
    assert Q.relation_rules(pairs, metrics.limit(0), shots).where("message = 'metric is missing'").count() == 14


def test_members_with_a_status_make_no_facts(spark):
    member = "video long, batch long, shot string"
    members = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (1, 2, "c")], member)
    statuses = spark.createDataFrame([(1, "a", "done"), (1, "a", "done"), (1, "b", "done"), (2, "c", "done")], "video long, shot string, status string")
    batches = spark.createDataFrame([(1, 1, "done", True), (1, 2, "done", True)], "video long, batch long, status string, has_response boolean")
    docs = spark.createDataFrame([(1, "partial", True, 0, 0, 0)], "video long, status string, terminal boolean, failed int, pending int, permanent int")
    assert Q.batch_facts(batches, members, members, statuses, docs).count() == 4  # two batches, a document, a member without a status; 11 with a fact for each
    assert [(r.path, r.message) for r in Q.batch_rules(batches, members, members, statuses, docs).collect()] == [("1/2/c", "no status")]
    got = Q.batch_rules(batches, members, members.where("shot <> 'a'"), statuses, docs).where("message = 'response differs'").collect()
    assert sorted((r.path, r.expected, r.actual) for r in got) == [("1/1", "1", "0"), ("1/2", "1", "0")]


def _nearest(df, node, *kinds):
    """For every ``node`` of the plan, which of the kinds stands first above it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    found = []
    for i, line in enumerate(lines):
        if line[at(line):].startswith(node):
            depth = at(line)
            for up in reversed(lines[:i]):
                if at(up) < depth:
                    depth = at(up)
                    if hit := next((k for k in kinds if up[depth:].startswith(k)), None):
                        found.append(hit)
                        break
    return found


def test_no_map_of_facts_is_held_beside_the_sides_that_make_them(spark):
    numbers = spark.range(20).selectExpr("id as k", "id % 3 as v")
    ranked = numbers.selectExpr("k", "v", "row_number() over (partition by v order by k) as j")
    part = together([rules.facts(ranked, rules.use("d", rules.ident("v"), "undefined", artifact="a", path="k", message="m")), rules.facts(numbers, rules.define("d", rules.ident("k")))])
    judged = Q.gate(rules.judge(part, part))
    assert set(_nearest(judged, "Coalesce", "HashAggregate", "Exchange")) == {"Exchange"}  # a coalesced task starts one side after the other
    assert set(_nearest(judged, "Window", "HashAggregate", "Exchange")) == {"Exchange"}
    assert rules.judge(part, part).count() == 0


def test_equal_facts_of_several_tasks_are_one(spark):
    rows = spark.range(0, 60, 1, 12).selectExpr("id % 2 as v", "id % 3 as k")
    told = {"artifact": "a", "path": "v"}
    part = rules.facts(
        rows, rules.use("d", rules.ident("v"), "undefined", message="each", **told), rules.use("d", rules.ident("v"), "undefined once", message="once", **told),
        rules.now("k = 0", "a", "k", "now"), rules.use("n", rules.ident("v"), "undeclared", message="count", **told))
    got = {}
    for r in rules.judge(part.where("message <> 'now'"), part.where("message = 'now'")).collect():
        got[r.message, r.path, r.expected] = got.get((r.message, r.path, r.expected), 0) + 1
    assert got == {("each", "0", None): 30, ("each", "1", None): 30, ("once", "0", None): 1, ("once", "1", None): 1, ("now", "0", None): 20, ("count", "0", "30"): 1, ("count", "1", "30"): 1}


def test_lines_of_known_shots_make_no_facts(spark):
    lines = spark.createDataFrame([("A", "1", 1), ("A", "2", 2), ("R", "3", 1), ("A", "4", 9), ("A", "4", 9), ("N", "5", 3), (None, "6", 8), ("A", None, None)], "artifact string, path string, shot long")
    shots = spark.createDataFrame([(1,), (2,), (3,), (3,)], "shot long")
    assert Q.coverage_facts(lines, shots, ["A", "R"]).count() == 9  # 4 lines that name no shot, of shot 2 one fact, of each 3 two; 26 with a fact for each
    got = sorted((r.severity, r.artifact or "", r.path or "", r.message, r.actual) for r in Q.coverage_rules(lines, shots, ["A", "R"]).collect())
    lost = [("error", "", "6", "unknown shot", "8"), ("error", "A", "", "unknown shot", ""), *[("error", "A", "4", "unknown shot", "9")] * 2]
    assert got == [*lost, ("warning", "A", "3", "not covered", "3"), ("warning", "R", "2", "not covered", "2"), ("warning", "R", "3", "not covered", "3")]
    assert all(m == "unknown shot" for m in (r.message for r in Q.coverage_rules(lines, shots, []).collect()))


def test_an_inventory_is_not_broadcast(spark):
    files = spark.createDataFrame([("a", '{"lines": ["x", "y"]}')], "file string, doc string")
    refs = spark.createDataFrame([("a", "lines[1]"), ("a", "lines[2]")], "file string, pointer string")
    got = D.resolve_pointers(refs, D.inventory(files))
    assert {(r.pointer, r.error) for r in got.collect()} == {("lines[1]", None), ("lines[2]", "out of bounds")}
    assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()


def test_facts_are_dealt_by_number(spark):
    part = rules.facts(spark.range(5).selectExpr("id as k"), rules.use("d", rules.ident("k"), "undefined", artifact="a", path="k", message="m"))
    assert rules.dealt(part).rdd.getNumPartitions() == rules.judge(part).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
