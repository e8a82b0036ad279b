"""Replies of models as tables: fences, JSON, closed sets of ids, and the rules that make a reply acceptable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import together


def unfenced(text: str | Column) -> Column:
    """The text inside one pair of fences around all of it, with at most a word after the first; other text as it is."""
    body = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inside = F.regexp_extract(body, r"^```[ \t]*([A-Za-z]*)[ \t]*\r?\n((?s:.*))\n[ \t]*```$", 2)
    return F.when(body.rlike(r"^```[ \t]*[A-Za-z]*[ \t]*\r?\n(?s:.*)\n[ \t]*```$"), F.regexp_replace(inside, r"^\s+|\s+$", "")).otherwise(body)


def _part(value: str | Column, path: str) -> Column:
    """What a path of a VARIANT holds, with its own type; null if there is nothing (a JSON null is something)."""
    return F.try_variant_get(value, path, "variant")


def _is(value: Column, kind: str) -> Column:
    """Whether a VARIANT is of a JSON type (STRING, OBJECT, ARRAY, ...), false for null. Nothing is coerced."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _items(value: str | Column, path: str) -> Column:
    """The items of an array, null if the path holds no array."""
    return F.when(_is(_part(value, path), "ARRAY"), F.try_variant_get(value, path, "array<variant>"))


def _text(value: str | Column, path: str) -> Column:
    """Text that is text; null for anything else."""
    return F.when(_is(_part(value, path), "STRING"), F.try_variant_get(value, path, "string"))


def _shown(value: str | Column, path: str) -> Column:
    """A scalar as trimmed text, '' for null and nothing."""
    return F.coalesce(F.trim(F.regexp_replace(F.try_variant_get(value, path, "string"), r"^\s+|\s+$", "")), F.lit(""))


def group_reply(df: DataFrame, reply: str, expected: str, fields: Sequence[str]) -> DataFrame:
    """Adds verdict (ok, not json, schema, ids) and, where ok, shots: an array of struct(shotID, fields). ``expected`` is the array of ids that were asked for.

    Every shot is an object with a shotID and all fields as text (a number is no text); the ids are the expected ones, each as often."""
    rows = df.withColumn("_v", F.try_parse_json(unfenced(reply)))
    rows = rows.withColumn("_s", F.transform(_items("_v", "$.shots"), lambda x: F.struct(*(_text(x, f"$.{c}").alias(c) for c in ("shotID", *fields)))))
    shots = F.col("_s")
    whole = F.coalesce(F.forall(shots, lambda x: F.forall(F.array(*[x[c] for c in ("shotID", *fields)]), lambda y: y.isNotNull())), F.lit(False))
    same = F.array_sort(F.transform(shots, lambda x: x["shotID"])) == F.array_sort(F.col(expected).cast("array<string>"))
    verdict = F.when(F.col("_v").isNull(), "not json").when(~whole, "schema").when(~same, "ids").otherwise("ok")
    return rows.withColumn("verdict", verdict).withColumn("shots", F.when(F.col("verdict") == "ok", shots)).drop("_v", "_s")


def assembled(shots: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Response rows: a group that came back whole is one row, otherwise each shot is one, numbered as batches of the video; with how many shots of the video succeeded and failed. shots: keys, group, shot, ok."""
    from pyspark.sql import Window as W

    per = shots.groupBy(*keys, group).agg(F.bool_and("ok").alias("whole"), F.array_sort(F.collect_list(F.struct("shot", "ok"))).alias("s"))
    one = F.array(F.struct(F.transform("s", lambda x: x["shot"]).alias("shots"), F.lit(True).alias("ok")))
    each = F.transform("s", lambda x: F.struct(F.array(x["shot"]).alias("shots"), x["ok"].alias("ok")))
    rows = per.select(*keys, group, F.when(F.col("whole"), "batch").otherwise("shot").alias("kind"), F.explode(F.when(F.col("whole"), one).otherwise(each)).alias("r")).select(*keys, group, "kind", "r.*")
    video = W.partitionBy(*keys)  # a row's shots are all of its kind, so the counts need no second pass over the shots
    count = lambda ok: F.sum(F.when(ok, F.size("shots")).otherwise(0)).over(video)
    rows = rows.select("*", (F.row_number().over(video.orderBy(group, F.get("shots", F.lit(0)))) - 1).alias("batch"), count(F.col("ok")).alias("succeeded"), count(~F.col("ok")).alias("failed"))
    return rows.withColumn("status", F.when(F.col("ok"), "succeeded").otherwise("failed"))


def broken(df: DataFrame, keys: Sequence[str], where: str | Column, rule: str) -> DataFrame:
    return df.where(where).select(*keys, F.lit(rule).alias("rule"))


def story_fill_rules(scaffold: DataFrame, blocks: DataFrame, slots: DataFrame, slot_types: Sequence[str], keys: Sequence[str] = ("video",), block_title: int = 12, slot_title: int = 15) -> DataFrame:
    """keys, rule: every rule that a video's reply breaks; one is enough to reject it.

    scaffold: keys, block, shots, start_ms, end_ms; blocks (of the reply): keys, block, shots, start_ms, end_ms, title (null: not given); slots: keys, slot, types (array), title, blocks (array).
    The blocks are the scaffold's, each once, and leave its shots and times alone; titles are short; slots have a well-formed id of their own, a known type and known blocks; every block has a slot."""
    on = [*keys, "block"]
    a, b = scaffold.groupBy(*on).agg(F.count("*").alias("_a")), blocks.groupBy(*on).agg(F.count("*").alias("_b"))
    ids = a.join(b, on, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    both = blocks.join(scaffold.select(*on, *[F.col(c).alias(f"_{c}") for c in ("shots", "start_ms", "end_ms")]), on)
    moved = lambda c: F.col(c).isNotNull() & (F.col(c) != F.col(f"_{c}"))
    named = slots.select(*keys, F.explode("blocks").alias("block"))
    known = scaffold.select(*on).distinct()
    parts = [
        broken(ids, keys, F.lit(True), "block ids"), broken(both, keys, moved("shots"), "shots moved"), broken(both, keys, moved("start_ms") | moved("end_ms"), "bounds moved"),
        broken(blocks, keys, F.char_length("title") > block_title, "block title"), broken(slots, keys, ~F.coalesce(F.col("slot").rlike("^S[0-9]{3}$"), F.lit(False)), "slot id"),
        broken(slots.groupBy(*keys, "slot").agg(F.count("*").alias("n")), keys, "n > 1", "slot twice"), broken(slots, keys, F.coalesce(F.size(F.array_intersect("types", F.array(*map(F.lit, slot_types)))), F.lit(0)) <= 0, "slot type"),
        broken(slots, keys, F.char_length("title") > slot_title, "slot title"), broken(slots, keys, F.coalesce(F.size("blocks"), F.lit(0)) <= 0, "slot without blocks"),
        broken(named.join(known, on, "left_anti"), keys, F.lit(True), "unknown block"), broken(known.join(named, on, "left_anti"), keys, F.lit(True), "block without slot"),
    ]
    return together(parts).distinct()


def story_reply(replies: DataFrame, reply: str, scaffold: DataFrame, enums: Mapping[str, Sequence[str]], lists: Mapping[str, Sequence[str]], texts: Sequence[str], slot_types: Sequence[str], keys: Sequence[str] = ("video",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the text of a reply to its accepted story: rules (keys, rule: what a rejected reply breaks), blocks and slots of the accepted replies.

    replies: keys and the text; scaffold: keys, block, shots (array of text), start_ms, end_ms. The reply is an object with blocks, and slots if any. Types are not coerced: shots are a list of text,
    times are numbers. Of a block, fields in ``enums`` outside their values are unknown, fields in ``lists`` keep their known values (unknown if none is left), ``texts`` are trimmed; the scaffold's shots and times stay.
    Slots have types of ``slot_types``, their blocks once each, and a rationale."""
    # dealt by key, as every rule joins by it; and parsed once, since plans do not look through an exchange
    rows = replies.select(*keys, F.try_parse_json(unfenced(reply)).alias("_v")).repartition(*keys)
    rows = rows.withColumn("_blocks", _items("_v", "$.blocks")).withColumn("_slots", _items("_v", "$.slots"))
    objects = lambda c: F.coalesce(F.forall(c, lambda x: _is(x, "OBJECT")), F.lit(True))
    shape = F.when(F.col("_v").isNull(), "not json").when(~_is(F.col("_v"), "OBJECT"), "no object").when(F.col("_blocks").isNull(), "blocks are no list").when(
        _part("_v", "$.slots").isNotNull() & F.col("_slots").isNull(), "slots are no list").when(~objects("_blocks"), "block is no object").when(~objects("_slots"), "slot is no object")
    rows = rows.withColumn("_shape", shape)
    good = rows.where("_shape is null")

    def moved(path: str, kind: str, typed: str, otherwise: Column) -> Column:
        """The value, null if nothing is given, ``otherwise`` if it is of another type."""
        x = _part("b", path)
        return F.when(x.isNull(), None).when(F.schema_of_variant(x).rlike(kind), F.try_variant_get("b", path, typed)).otherwise(otherwise)

    numbers = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
    pick = lambda name, allowed: F.when(_shown("b", f"$.{name}").isin(list(allowed)), _shown("b", f"$.{name}")).otherwise("unknown")
    known = lambda shown, allowed: F.array_distinct(F.filter(F.transform(F.split(shown, "[、，,]"), lambda x: F.trim(x)), lambda x: x.isin(list(allowed))))
    chosen = lambda name, allowed: F.coalesce(F.nullif(F.array_join(known(_shown("b", f"$.{name}"), allowed), "、"), F.lit("")), F.lit("unknown"))
    blocks = good.select(*keys, F.explode("_blocks").alias("b")).select(
        *keys, F.coalesce(_text("b", "$.storyBlockID"), F.concat(F.lit("no text: "), F.coalesce(F.to_json(_part("b", "$.storyBlockID")), F.lit("")))).alias("block"),
        moved("$.shotIDs", r"^ARRAY<(STRING|VOID)>$", "array<string>", F.array(F.lit("no list of text"))).alias("shots"),
        *(moved(f"$.{path}", numbers, "double", F.lit(float("nan"))).alias(name) for path, name in (("startMs", "start_ms"), ("endMs", "end_ms"))), F.nullif(_shown("b", "$.blockTitle"), F.lit("")).alias("title"),
        *(pick(n, v).alias(n) for n, v in enums.items()), *(chosen(n, v).alias(n) for n, v in lists.items()), *(_shown("b", f"$.{n}").alias(n) for n in texts))
    slots = good.select(*keys, F.explode("_slots").alias("b")).select(
        *keys, _shown("b", "$.slotID").alias("slot"), known(_shown("b", "$.slotType"), slot_types).alias("types"), _shown("b", "$.slotTitle").alias("title"),
        F.array_distinct(F.transform(_items("b", "$.blockIDs"), lambda x: F.try_variant_get(x, "$", "string"))).alias("blocks"), _shown("b", "$.slotRationale").alias("rationale"))
    of_shape = rows.where("_shape is not null").select(*keys, F.col("_shape").alias("rule"))
    asked = scaffold.join(good.select(*keys), list(keys), "left_semi")
    rules = story_fill_rules(asked, blocks, slots, slot_types, keys).unionByName(of_shape)
    rejected = rules.select(*keys).distinct()
    kept = blocks.drop("shots", "start_ms", "end_ms").join(rejected, list(keys), "left_anti").join(scaffold, [*keys, "block"])
    return rules, kept, slots.join(rejected, list(keys), "left_anti").withColumn("types", F.array_join("types", "、"))


def pair_semantics(df: DataFrame, reply: str, enums: Mapping[str, Sequence[str]], motivations: Sequence[str], ref: str | Column) -> DataFrame:
    """Adds parsed (false: the whole reply failed), for each field name_state, name_value and name_confidence, refs (``ref``: where the reply's raw text lies) and issues (names of the fields that were not as asked).

    A value outside its enum leaves that field unknown; motivations outside the list go, none left is a claim of absence, no array is unknown; the summary must be text. Enums are of medium confidence, the others of low."""
    rows = df.withColumn("_v", F.try_parse_json(unfenced(reply))).withColumn("parsed", _is(F.col("_v"), "OBJECT"))
    issues = []

    def told(name: str, state: Column, value: Column, confidence: str, odd: Column) -> None:
        nonlocal rows
        rows = rows.withColumns({f"{name}_state": state, f"{name}_value": value, f"{name}_confidence": F.when(state == "unknown", "unknown").otherwise(confidence)})
        issues.append(F.when(odd, F.lit(name)))

    for name, enum in enums.items():
        v = _text("_v", f"$.{name}")
        known = F.col("parsed") & F.coalesce(v.isin(list(enum)), F.lit(False))
        told(name, F.when(known, "value").otherwise("unknown"), F.when(known, v), "medium", ~known)
    given = _items("_v", "$.editMotivations")
    rows = rows.withColumn("_given", F.transform(given, lambda m: F.when(_is(m, "STRING"), F.try_variant_get(m, "$", "string"))))
    kept = F.filter("_given", lambda m: m.isin(list(motivations)))
    state = F.when(~F.col("parsed") | kept.isNull(), "unknown").when(F.size(kept) == 0, "absent-claimed").otherwise("value")
    told("motivations", state, F.when(state == "value", kept), "low", F.coalesce(F.size("_given") != F.size(kept), F.lit(True)) | kept.isNull())
    summary = F.trim(_text("_v", "$.relationSummary"))
    fine = F.col("parsed") & F.coalesce(summary != "", F.lit(False))
    told("summary", F.when(fine, "value").otherwise("unknown"), F.when(fine, summary), "low", ~fine)
    where = F.array(F.concat(ref if isinstance(ref, Column) else F.col(ref), F.lit(".semantic.raw")))
    return rows.withColumns({"refs": where, "issues": F.when(F.col("parsed"), F.array_compact(F.array(*issues)))}).drop("_v", "_given")


def distill_rules(slots: DataFrame, expected: DataFrame, roles: DataFrame, role_shots: DataFrame, requirements: DataFrame, hints: DataFrame, questions: DataFrame, story_slots: DataFrame, story_blocks: DataFrame, keys: Sequence[str] = ("video",)) -> DataFrame:
    """keys, rule: every rule that a video's reply breaks.

    slots: slot, fixed (a deterministic field was given), layered (L1 and L2 are there); expected: slot; roles: role, slot, block, at_seconds, form, content; role_shots: role, shot; requirements: pos, slot, kind, text, evidence;
    hints: strengths, cautions, suggested; questions: id, options (array), texts (array of its texts); story_slots: slot, block; story_blocks: block, shot.
    The slots are the expected ones and overwrite nothing; hook and payoff close over slot, block and shots and are complete; requirements, hints and questions have their shape."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    by = lambda *c: [*keys, *c]
    given, want = slots.select(*by("slot")).distinct(), expected.select(*by("slot")).distinct()
    placed = role_shots.join(roles.select(*by("role", "block")), by("role"))
    parts = [
        broken(given.join(want, by("slot"), "left_anti").unionByName(want.join(given, by("slot"), "left_anti")), keys, F.lit(True), "slot set"), broken(slots, keys, "fixed", "fixed field"), broken(slots, keys, "not layered", "slot layers"),
        broken(roles.join(want, by("slot"), "left_anti"), keys, F.lit(True), "role slot"), broken(roles.join(story_blocks.select(*by("block")).distinct(), by("block"), "left_anti"), keys, F.lit(True), "role block"),
        broken(roles.join(story_slots, by("slot", "block"), "left_anti"), keys, F.lit(True), "role block outside its slot"), broken(roles, keys, F.col("at_seconds").isNull() | blank("form") | blank("content"), "role layers"),
        broken(roles.join(role_shots.select(*by("role")).distinct(), by("role"), "left_anti"), keys, F.lit(True), "role without shots"), broken(placed.join(story_blocks, by("block", "shot"), "left_anti"), keys, F.lit(True), "role shot outside its block"),
        broken(requirements.join(want, by("slot"), "left_anti"), keys, F.lit(True), "requirement slot"), broken(requirements, keys, blank("kind") | blank("text") | blank("evidence"), "requirement texts"),
        broken(hints, keys, F.col("strengths").isNull() | F.col("cautions").isNull() | blank("suggested"), "hints"), broken(questions, keys, blank("id") | (F.coalesce(F.size("options"), F.lit(0)) <= 0) | F.exists("texts", lambda t: F.coalesce(F.trim(t) == "", F.lit(True))), "question"),
        broken(questions.groupBy(*by("id")).agg(F.count("*").alias("n")), keys, "n > 1", "question twice"),
    ]
    return together(parts).distinct()
