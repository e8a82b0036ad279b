"""Integrity rules over tables. Every rule gives issues: severity, artifact, path, message, expected, actual.

Each group comes twice: as facts, which many groups share one judgement of (see ``rules``), and as issues. Every artifact is read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ISSUE, Sql, define, differs, facts, ident, judge, now, path_of, together, unpacked, use, word

__all__ = ["ISSUE"]


def _issues_of(group):
    """A group of facts as issues of its own."""

    @wraps(group)
    def rules(*args, **more) -> DataFrame:
        return judge(group(*args, **more))

    return rules


def schema_facts(df: DataFrame, artifact: str, path: Column, rules: Mapping[str, Mapping]) -> DataFrame:
    """rules: column -> any of required, enum, pattern, least, most. One pass: each row explodes to the rules that it breaks."""
    broken = []
    for name, rule in rules.items():
        tests = {
            "required": f"{name} is null" if rule.get("required") else None,
            "enum": f"{name} not in ({', '.join(map(word, rule['enum']))})" if "enum" in rule else None,
            "pattern": f"not cast({name} as string) rlike {word(rule['pattern'])}" if "pattern" in rule else None,
            "minimum": f"{name} < {rule['least']}" if "least" in rule else None,
            "maximum": f"{name} > {rule['most']}" if "most" in rule else None,
        }
        broken += [now(test, artifact, "_path", f"{name}: {kind}", None, name) for kind, test in tests.items() if test is not None]
    return facts(df.withColumn("_path", path), *broken)


def equal_facts(df: DataFrame, artifact: str, path: Column, message: str, expected: Column, actual: Column) -> DataFrame:
    """Rows where actual is not expected."""
    return facts(df.select(path.alias("_path"), expected.alias("_a"), actual.alias("_b")), now(differs("_a", "_b"), artifact, "_path", message, "_a", "_b"))


def audio_cut_facts(cuts: DataFrame, known: DataFrame, tolerance_ms: int) -> DataFrame:
    """cuts: id, offset_ms, declared, ref; known: ref. The declared offset is the offset, lies within the tolerance, and the reference is known."""
    return together([
        facts(cuts, now(differs("offset_ms", "declared"), "audio_cuts", "id", "offset", "offset_ms", "declared"), now(f"abs(offset_ms) > {tolerance_ms}", "audio_cuts", "id", "beyond tolerance", str(tolerance_ms), "offset_ms"),
              use("cuts.ref", ident("ref"), "undefined", artifact="audio_cuts", path="id", message="unknown ref", actual="ref")),
        facts(known, define("cuts.ref", ident("ref"))),
    ])


def music_facts(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """rows: video, state, id, ratio; declared: video, state, n. Ratios lie in 0..1, and as many rows have a state as declared (0 where one side has none)."""
    key, told = ident("video", "state"), {"artifact": "music", "path": path_of("video", "state"), "message": "tally"}
    return together([
        facts(rows, now("ratio < 0 or ratio > 1", "music", "id", "ratio outside"), use("music.tally", key, "undeclared", **told)),
        facts(declared, define("music.tally", key, "count", said="n", **told)),
    ])


def shot_facts(shots: DataFrame, ranges: DataFrame, partial: Column, declared: DataFrame | None = None, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Sequence without gaps, end after start, duration identity, overlap, adjacency (a warning where the analysis is partial), and cover of the range;
    types of the first and last boundary where shots have type_in and type_out, and the number of boundaries where ``declared`` (keys, n) is given.

    shots: seq, start_ms, end_ms, duration_ms."""
    over = f"over (partition by {', '.join(keys)} order by seq)"
    rows = shots.select("*", partial.alias("_partial"), F.expr(f"lead(start_ms) {over} as _next"), F.expr(f"row_number() {over} as _rank"), F.expr(f"lead(1) {over} is null as _last"))
    path, video, key = path_of(*keys, "seq"), path_of(*keys), ident(*keys)
    own = [
        now(differs("_rank", "seq"), "shots", path, "sequence", "_rank", "seq"), now("end_ms <= start_ms", "shots", path, "end before start", "start_ms", "end_ms"),
        now(differs("end_ms - start_ms", "duration_ms"), "shots", path, "duration", "end_ms - start_ms", "duration_ms"), now("_next < end_ms", "shots", path, "overlap", "end_ms", "_next"),
        now("_next > end_ms", "shots", path, "not adjacent", "end_ms", "_next", Sql("if(_partial, 'warning', 'error')")), use("shots.cover", key, low="start_ms", high="end_ms"),
    ]
    if {"type_in", "type_out"} <= set(shots.columns):
        ends = [("_rank = 1", "first boundary", "'sourceStart'", "type_in"), ("_last", "last boundary", "'sourceEnd'", "type_out")]
        own += [now(f"{at} and {differs(wanted, given)}", "shots", video, message, wanted, given) for at, message, wanted, given in ends]
    told = lambda message: {"artifact": "shots", "path": video, "message": message}
    parts = [facts(ranges, define("shots.cover", key, "from", said="range_start", **told("range start not covered")), define("shots.cover", key, "to", said="range_end", **told("range end not covered")))]
    if declared is not None:
        own.append(use("shots.boundaries", key, "undeclared", n="if(_rank > 1, 1, 0)", **told("boundary count")))
        parts.append(facts(declared, define("shots.boundaries", key, "count", said="n", **told("boundary count"))))
    return together([facts(rows, *own), *parts])


def coverage_facts(rows: DataFrame, shots: DataFrame, complete: Sequence[str], strict: bool = False, on: Sequence[str] = ("shot",)) -> DataFrame:
    """Rows of shot-level artifacts (artifact, path, ``on``) must name known shots; complete artifacts must name all of them (a warning unless strict)."""
    name, severity = path_of(*on), "error" if strict else "warning"
    # rows meet the shots here, so that only rows that name none make facts, and shots that a complete artifact lacks
    sides = rows.selectExpr(f"{name} as _name", "false as _shot", "artifact", "path").unionByName(shots.selectExpr(f"{name} as _name", "true as _shot"), allowMissingColumns=True)
    lacks = [f"count_if(not _shot and artifact = {word(a)}) over (partition by _name) = 0 as _lacks{k}" for k, a in enumerate(complete)]
    sides = sides.selectExpr("*", "count_if(_shot) over (partition by _name) = 0 as _unknown", *lacks)
    return facts(
        sides, now("not _shot and _unknown", Sql("artifact"), "path", "unknown shot", None, "_name"),
        *(use("cover.all", ident(word(a), "_name"), "undefined once", when=f"_shot and _lacks{k}", artifact=a, path="_name", message="not covered", actual="_name", severity=severity) for k, a in enumerate(complete)))


def frame_facts(frames: DataFrame, shots: DataFrame, ranges: DataFrame, files: DataFrame) -> DataFrame:
    """frames: video, i, id, shot, t, file. The id is the place, the shot is known, the time lies in the range, the file (listed in ``files``: file) exists."""
    path = path_of("video", "i")
    own = {"artifact": "frames", "path": path}
    return together([
        facts(frames.join(ranges, "video", "left"), now(differs("i", "id"), "frames", path, "id", "i", "id"), now("t < range_start or t >= range_end", "frames", path, "time outside", "range_end", "t"),
              use("frames.shot", ident("video", "shot"), "undefined", message="unknown shot", actual="shot", **own), use("frames.file", ident("file"), "undefined", message="no such file", actual="file", **own)),
        facts(shots, define("frames.shot", ident("video", "shot"))), facts(files, define("frames.file", ident("file"))),
    ])


def batch_facts(batches: DataFrame, members: DataFrame, responses: DataFrame, statuses: DataFrame, docs: DataFrame) -> DataFrame:
    """batches: video, batch, status, has_response; members, responses: video, batch, shot; statuses: video, shot, status; docs: video, status, terminal and counts failed, pending, permanent.

    The shots of a response are those of its batch (a failed batch may have none), every member has a status, nothing is pending in a terminal document, and a complete one counts no failures."""
    on, batch, shot = ["video", "batch", "shot"], ident("video", "batch"), ident("video", "shot")
    sides = members.select(*on, F.lit(1).alias("_a")).unionByName(responses.select(*on, F.lit(2).alias("_a")))
    # a shot's statuses meet its members here, so that only members without one make facts
    sides = sides.unionByName(statuses.select("video", "shot", F.lit(4).alias("_a")), allowMissingColumns=True).groupBy(*on).agg(F.bit_or("_a").alias("_a"))
    known = "bit_or(_a) over (partition by video, shot) & 4 > 0"
    sides = sides.selectExpr("*", f"{known} as _known").where("_a & 3 > 0").selectExpr(*on, "_a & 1 > 0 as _asked", "_a & 2 > 0 as _told", "_known")
    own = lambda path, message: {"artifact": "batches", "path": path, "message": message}
    return together([
        facts(sides, use("batches.answer", batch, when="_asked <> _told", n="int(_asked)", x="int(_told)"), now(f"_asked and not _known and {shot} is not null", **own(path_of(*on), "no status"))),
        facts(batches, define("batches.answer", batch, "two sums", when="not (status = 'failed' and not has_response)", **own(path_of("video", "batch"), "response differs"))),
        facts(statuses, use("batches.pending", ident("video"), when="status = 'pending'")),
        facts(docs, define("batches.pending", ident("video"), "forbidden", when="terminal", **own("video", "pending in a terminal document")),
              *(now(f"status = 'complete' and {f} <> 0", "batches", path_of("video", word(f)), "complete with failures", "0", f) for f in ("failed", "pending", "permanent"))),
    ])


def story_facts(blocks: DataFrame, members: DataFrame, shots: DataFrame, slots: DataFrame, docs: DataFrame) -> DataFrame:
    """blocks: video, block (its name), start_ms, end_ms, relation (text); members: video, block, j, shot; shots: video, shot, seq, start_ms, end_ms; slots: video, slot, j, block; docs: video, status.

    Members are known shots in order, each block's times are those of its first and last shot, relations name another known block, every shot is in exactly one block, blocks
    cover the sequence one after the other, slots name known blocks, and in a complete story every block is in a slot."""
    # shots and members come together once, by video; every window below finds them there
    rows = members.select("video", F.lit(True).alias("_m"), "block", "j", "shot").unionByName(shots.select("video", F.lit(False).alias("_m"), "shot", "seq", "start_ms", "end_ms"), allowMissingColumns=True).repartition("video")
    same, group = "over (partition by video, shot)", "partition by video, _m, block"
    rows = rows.selectExpr("video", "_m", "block", "j", "shot", *(f"max({f}) {same} as {f}" for f in ("seq", "start_ms", "end_ms")), f"count_if(_m) {same} as _n")
    rows = rows.selectExpr("*", f"coalesce(seq < lag(seq) over ({group} order by j), false) as _back", f"row_number() over ({group} order by j) as _at")
    rows = rows.selectExpr("*", *(f"{e} over ({group}) as {a}" for e, a in (("count_if(seq is null)", "_unknown"), ("bool_or(_back)", "_torn"), ("min(seq)", "_first"), ("min_by(start_ms, j)", "_s"), ("max_by(end_ms, j)", "_e"))))
    # members by block, then by sequence: the k-th must be the k-th shot
    rows = rows.selectExpr("*", "row_number() over (partition by video, _m, seq is null order by if(_m, _first, null), if(_m, block, null), seq) as _k")
    place = "over (partition by video, seq is null, _k)"
    rows = rows.selectExpr("*", f"seq is not null and {differs(f'max(if(_m, seq, null)) {place}', f'max(if(_m, null, seq)) {place}')} as _odd")
    path, block, video = path_of("video", "block"), ident("video", "block"), ident("video")
    own = lambda path, message, **more: {"artifact": "story", "path": path, "message": message, **more}
    whole, at_shot = "_m and _at = 1 and _unknown = 0", path_of("video", "shot")
    targets = "array_distinct(regexp_extract_all(relation, '→ *([A-Za-z0-9]+)', 1))"
    return together([
        facts(rows, now("_m and seq is null", "story", path_of("video", "block", "j"), "unknown shot", None, "shot"), now(f"{whole} and _torn", "story", path, "shots out of order"), use("story.block", block, when=whole, low="_s", high="_e"),
              now("not _m and _n = 0", "story", at_shot, "in no block"), now("not _m and _n > 1", "story", at_shot, "in several blocks", "1", "_n"), use("story.torn", video, when="_odd", low="_k")),
        facts(blocks.join(docs.select("video", "status"), "video", "left"), define("story.block", block, "start", said="start_ms", **own(path, "start")), define("story.block", block, "end", said="end_ms", **own(path, "end")),
              define("story.name", block), now(f"array_contains({targets}, block)", "story", path, "relation to itself"), define("story.slot", block, "unused", when="status = 'complete'", **own(path, "in no slot")),
              define("story.torn", video, "number of first", **own("video", "blocks do not cover the sequence")),
              more=[f"coalesce(transform({targets}, t -> {use('story.name', ident('video', 't'), 'undefined', **own(path, 'unknown target', actual='t'))}), array())"]),
        facts(slots, use("story.name", block, "undefined", **own(path_of("video", "slot", "j"), "unknown block", actual="block")), use("story.slot", block)),
    ])


def profile_facts(slots: DataFrame, slot_shots: DataFrame, roles: DataFrame, role_shots: DataFrame, requirements: DataFrame, chains: DataFrame, story_slots: DataFrame, story_blocks: DataFrame, shots: DataFrame) -> DataFrame:
    """slots: video, slot, share, count, avg_sec; slot_shots: video, slot, shot; roles: video, role, slot, block; role_shots: video, role, shot; requirements: video, pos, slot; chains: video, pos, from_slot, to_slot, block;
    story_slots: video, slot, block; story_blocks: video, block, shot; shots: video, shot, duration_ms.

    The profile has the story's slots; shares lie in 0..1 and sum to 1; counts and averages are those of the slot's shots; hook and payoff name a slot, a block of that slot and shots of that block; requirements and chains name known slots and blocks."""
    at_slot, at_role, at_pos = path_of("video", "slot"), path_of("video", "role"), path_of("video", "pos")
    slot, block, member, pair = ident("video", "slot"), ident("video", "block"), ident("video", "block", "shot"), ident("video", "slot", "block")
    own = lambda path, message, **more: {"artifact": "profile", "path": path, "message": message, **more}
    # the shots of slots and of roles meet the shots at once
    named = roles.join(role_shots, ["video", "role"], "full").select("video", "role", "slot", "block", "shot")
    held = slot_shots.select("video", "slot", "shot").unionByName(named, allowMissingColumns=True).join(shots.select("video", "shot", "duration_ms", F.lit(True).alias("_known")), ["video", "shot"], "left")
    a_role, a_slot, foreign = "role is not null", "role is null", "shot is not null and _known is null"
    outside = own(at_role, "block outside the slot", actual="block", parts="3", when=a_role)
    ends = [use("profile.told", ident("video", f"{end}_slot"), "undefined", **own(path_of("video", "pos", word(end)), "chain of unknown slot", actual=f"{end}_slot")) for end in ("from", "to")]
    return together([
        facts(held, now(f"{a_slot} and {foreign}", "profile", at_slot, "unknown shot", None, "shot"), now(f"{a_role} and {foreign}", "profile", at_role, "role of unknown shot", None, "shot"),
              use("profile.held", slot, when=f"{a_slot} and shot is not null"), use("profile.mean", slot, when=f"{a_slot} and duration_ms is not null", x="duration_ms / 1000"),
              use("profile.told", slot, "undefined once", when=a_role, **own(at_role, "role of unknown slot", actual="slot")), use("profile.blocks", block, "undefined once", when=a_role, **own(at_role, "role of unknown block", actual="block")),
              use("profile.told", slot, "defined", **outside), use("profile.blocks", block, "defined", **outside), use("profile.pairs", pair, "undefined", **outside),
              use("profile.members", member, "undefined", when=a_role, **own(at_role, "shot outside the block", actual="shot"))),
        facts(slots, define("profile.slots", slot), use("profile.told", slot, "undefined", **own(at_slot, "slot is foreign")), now("share < 0 or share > 1", "profile", at_slot, "share outside"),
              use("profile.share", ident("video"), "sum is one", x="share", **own("video", "shares do not sum to 1")), define("profile.held", slot, "count", said="count", **own(at_slot, "shot count")),
              define("profile.mean", slot, "mean", mean="avg_sec", **own(at_slot, "average"))),
        facts(story_slots, define("profile.told", slot), define("profile.pairs", pair), use("profile.slots", slot, "undefined once", **own(at_slot, "slot is missing"))),
        facts(story_blocks, define("profile.blocks", block), define("profile.members", member)),
        facts(requirements, use("profile.told", slot, "undefined", **own(at_pos, "requirement of unknown slot", actual="slot"))),
        facts(chains, *ends, use("profile.blocks", block, "undefined", **own(at_pos, "chain of unknown block", actual="block"))),
    ])


def timeline_facts(docs: DataFrame, points: DataFrame, peaks: DataFrame) -> DataFrame:
    """docs: video, mode, frame_count, range_start, range_end, wave_status, bin_count, bin_ms; points: video, i, t (double); peaks: video, i, lo, hi.

    With a frame index: some frames, whole times from 0 that never go back and lie in the range, as many as counted. With a complete waveform: some bins, as many as counted, of at least 1 ms, and none upside down (only the first is told)."""
    path, video, order = path_of("video", "i"), ident("video"), "partition by video order by i"
    rows = points.join(docs, "video", "full").selectExpr("*", "coalesce(t >= 0 and t = floor(t), false) as _good")
    rows = rows.selectExpr("*", f"last(if(_good, t, null), true) over ({order} rows between unbounded preceding and 1 preceding) as _before", f"row_number() over ({order}) = 1 as _head")
    # facts of a document are told by its first point
    indexed, waved, time = "mode = 'pts-index' and i is not null", "_head and wave_status = 'complete'", "cast(t as bigint)"
    counted, good = "_head and mode = 'pts-index'", f"{indexed} and _good"
    own = lambda message, path="video", **more: {"artifact": "timeline", "path": path, "message": message, **more}
    return together([
        facts(rows, now(f"{indexed} and not _good", "timeline", path, "no whole time", None, time), now(f"{good} and t < _before", "timeline", path, "not monotone", "cast(_before as bigint)", time),
              now(f"{good} and (t < range_start or t >= range_end)", "timeline", path, "outside", None, time), use("timeline.frames", video, when="i is not null"),
              define("timeline.frames", video, "unused", when=counted, **own("no frames")), define("timeline.frames", video, "count if any", when=counted, said="frame_count", **own("frame count")),
              define("timeline.bins", video, "unused", when=waved, **own("no bins")), define("timeline.bins", video, "count if any", when=waved, said="bin_count", **own("bin count")),
              define("timeline.bins", video, "used", when=f"{waved} and coalesce(bin_ms, 0) < 1", **own("bin length", expected="1", actual="bin_ms")), define("timeline.upside", video, "place of first", when=waved, **own("bin upside down"))),
        facts(peaks, use("timeline.bins", video), use("timeline.upside", video, when="lo > hi", low="i")),
    ])


METRICS = ("lumaDelta", "audioLevelDeltaDb", "cameraMotionChange", "audioCutAligned", "speechGapMs", "speechSpansBoundary", "musicContinuity")


def relation_facts(relations: DataFrame, metrics: DataFrame, shots: DataFrame) -> DataFrame:
    """relations: video, pos, pair, left, boundary_ms; metrics: video, pair, name, status, refs; shots: video, shot, seq, end_ms.

    The pairs are the adjacent shots in order (the first difference of a video is told), the boundary is the left shot's end, all metrics are there, and one with a value has references."""
    rows = shots.select("video", F.lit(False).alias("_g"), F.col("seq").alias("_at"), "shot", "end_ms")
    rows = rows.unionByName(relations.select("video", F.lit(True).alias("_g"), F.col("pos").alias("_at"), F.col("left").alias("shot"), "pair", "boundary_ms"), allowMissingColumns=True)
    # which metrics a pair has comes as bits, a row a pair (_g null), so that only those it lacks make facts; metrics are read once, so those without references come along
    bit = {m: 1 << k for k, m in enumerate(METRICS)}
    held = metrics.groupBy("video", "pair").agg(F.expr(f"bit_or(case name {' '.join(f'when {word(m)} then {b}' for m, b in bit.items())} else 0 end) as _held"), F.expr("collect_list(if(status = 'value' and coalesce(size(refs), 0) <= 0, struct(name), null)) as _bare"))
    rows = unpacked(rows.unionByName(held, allowMissingColumns=True), "video")
    order, place, same = "over (partition by video, _g order by _at)", "over (partition by video, _k)", "over (partition by video, shot)"
    rows = rows.selectExpr("*", f"if(_g is null, null, row_number() {order}) as _k", f"if(_g, null, concat(shot, '--', lead(shot) {order})) as _wanted")
    rows = rows.selectExpr("video", "_g", "_k", "pair", "boundary_ms", f"max(_wanted) {place} as _wanted", f"max(pair) {place} as _pair", f"min(_g) {place} = _g as _one", f"max(end_ms) {same} as end_ms", "bit_or(_held) over (partition by video, pair) as _held", "_bare")
    rows = rows.selectExpr("*", f"_one and {differs('_wanted', '_pair')} as _odd").selectExpr("*", "min(if(_odd, _k, null)) over (partition by video) = _k as _first")
    own = lambda message, *names: {"artifact": "relations", "path": path_of("video", "pair", *names), "message": message}
    bare = now("true", "relations", path_of("video", "pair", "t.name"), "value without references")
    return facts(
        rows, now("_odd and _first", "relations", "video", "pairs are not the adjacent shots", "_wanted", "_pair"), now("_g and boundary_ms <> end_ms", "relations", path_of("video", "pair"), "boundary", "end_ms", "boundary_ms"),
        *(now(f"_g and {ident('video', 'pair')} is not null and coalesce(_held, 0) & {b} = 0", **own("metric is missing", word(m))) for m, b in bit.items()),
        more=[f"coalesce(transform(_bare, t -> {bare}), array())"])


def reference_facts(refs: DataFrame, artifacts: DataFrame, files: DataFrame, inventory: DataFrame) -> DataFrame:
    """refs: artifact, path, ref (null where the entry is no text); artifacts: file (of every known artifact); files: file (that exist); inventory: file, path, kind of JSON files.

    Syntax, then the file (a known artifact that is missing is a warning, any other missing file an error), then the pointer."""
    from ..functions.scalars import evidence_ref
    from .documents import resolve_pointers

    rows = refs.withColumn("_r", evidence_ref("ref")).selectExpr("*", "substring_index(ref, '#', 1) as file", "if(instr(ref, '#') > 0, substring(ref, instr(ref, '#') + 1), null) as pointer")
    known = files.select("file", F.lit(True).alias("_f")).unionByName(artifacts.select("file", F.lit(False).alias("_f"))).groupBy("file").agg(F.expr("bool_or(_f) as _there"), F.expr("bool_or(not _f) as _named"))
    rows = rows.join(known, "file", "left").fillna(False, ["_there", "_named"]).selectExpr("*", "ref is not null and _r.reason is null as _good")
    walked = resolve_pointers(rows.withColumn("pointer", F.expr("if(_good and _there, pointer, null)")), inventory)
    tell = lambda broken, message, severity="error": now(broken, Sql("artifact"), "path", message, None, "ref", severity)
    return facts(
        walked, tell("ref is null", "no text"), tell("ref is not null and not _good", Sql("concat('syntax: ', _r.reason)")), tell("_good and not _there and _named", "artifact is missing", "warning"),
        tell("_good and not _there and not _named", "file does not exist"), tell("pointer is not null and error is not null", Sql("concat('pointer: ', error)")))


schema_rules, equal_rules, audio_cut_rules, music_rules, shot_rules, coverage_rules, frame_rules, batch_rules, story_rules, profile_rules, timeline_rules, relation_rules, reference_rules = map(_issues_of, (
    schema_facts, equal_facts, audio_cut_facts, music_facts, shot_facts, coverage_facts, frame_facts, batch_facts, story_facts, profile_facts, timeline_facts, relation_facts, reference_facts))


def gate(found: DataFrame, strict: bool = True) -> DataFrame:
    """artifact, errors, warnings, passed: with ``strict`` any error fails."""
    rows = found.groupBy("artifact").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return rows.withColumn("passed", (F.col("errors") == 0) if strict else F.lit(True))
