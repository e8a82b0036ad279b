"""Column functions over times, identifiers, references, labels and vocabularies. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
ABSENCE_WORDS = ["无", "没有", "不存在", "无内容", "none", "no", "nothing", "n/a", "null"]
CONFIDENCES = ["unknown", "low", "medium", "high"]
HOST_WORDS = ["人物", "主持人", "主播", "讲解", "受访", "嘉宾", "旅客", "游客", "旅行者", "人群", "路人", "出镜", "采访", "主角"]
LOUDNESS = [(-60, "静音"), (-40, "低"), (-25, "中"), (-12, "高")]
LOUDEST = "峰值"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bands(x: str | Column, edges: list[tuple[float, str]], top: str) -> Column:
    """Label of the first edge that lies above x (strictly); ``top`` if none does."""
    x, out = col(x), F.lit(top)
    for edge, label in reversed(edges):
        out = F.when(x < edge, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def seconds_to_ms(x: str | Column) -> Column:
    """Decimal seconds (number or numeric string) to integer ms, half up."""
    return F.round(col(x).cast("string").try_cast("decimal(38,9)") * 1000, 0).cast("bigint")


def seconds_to_ms_half_even(x: str | Column) -> Column:
    """Binary double seconds to integer ms, half even: the rounding of frame timestamps."""
    return F.bround(col(x).cast("double") * 1000, 0).cast("bigint")


def parse_fraction(x: str | Column) -> Column:
    """'a/b' or a plain number to a double; null for a zero denominator or anything else."""
    parts = F.split(F.trim(col(x)), "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, number(0)).when(F.size(parts) == 2, F.try_divide(number(0), number(1)))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def intersection_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def contains(start: Column, end: Column, t: Column, t_end: Column | None = None) -> Column:
    """Half-open containment; an interval that is a point contains only itself."""
    t_end = t if t_end is None else t_end
    return F.when(start == end, (t == start) & (t_end == start)).when(t == t_end, (start <= t) & (t < end)).otherwise((start <= t) & (t_end <= end))


def entity_id(prefix: str, n: str | Column, width: int = 4) -> Column:
    """SH0001 and the like; numbers beyond the width are kept whole."""
    return F.format_string(f"{prefix}%0{width}d", col(n).cast("bigint"))


def keyframe_id(shot_id: str | Column, k: str | Column) -> Column:
    """F_<shot>_MAIN for k null, F_<shot>_Knn for 1..99, null beyond."""
    k = col(k).cast("bigint")
    return F.when(k.isNull(), F.concat(F.lit("F_"), shot_id, F.lit("_MAIN"))).when(k.between(1, 99), F.concat(F.lit("F_"), shot_id, F.format_string("_K%02d", k)))


def is_shot_id(x: str | Column) -> Column:
    return col(x).rlike("^SH[0-9]{4}$")


def evidence_ref(x: str | Column) -> Column:
    """struct(file, pointer, is_file, reason): reason is null for a legal reference."""
    x = col(x)
    cut = F.instr(x, "#")
    path = F.when(cut > 0, F.substring(x, F.lit(1), cut - 1)).otherwise(x)
    pointer = F.when(cut > 0, F.substring(x, cut + 1, F.length(x)))
    reason = (
        F.when(x.isNull() | (F.trim(x) == ""), "empty")
        .when(path == "", "no file")
        .when(path.startswith("/") | path.startswith("~"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(F.array_contains(F.split(path, "/"), ".."), "parent")
        .when((cut > 0) & (pointer == ""), "no pointer")
    )
    return F.struct(path.alias("file"), pointer.alias("pointer"), (F.coalesce(cut, F.lit(0)) == 0).alias("is_file"), reason.alias("reason"))


def is_absence_claim(x: str | Column) -> Column:
    return F.lower(F.trim(col(x))).isin(ABSENCE_WORDS)


def raw_value_state(x: str | Column) -> Column:
    """unknown for null, blank or 'unknown'; absent-claimed for an absence word; else value."""
    text = F.lower(F.trim(col(x)))
    return F.when(text.isNull() | (text == "") | (text == "unknown"), "unknown").when(is_absence_claim(x), "absent-claimed").otherwise("value")


def enum_single(x: str | Column, allowed: list[str]) -> Column:
    return F.when(F.trim(col(x)).isin(allowed), F.trim(col(x))).otherwise("unknown")


def enum_multi(x: str | Column, allowed: list[str]) -> Column:
    """Parts between 、 ， , or ; that are allowed, in order and without repeats, joined by 、."""
    parts = F.transform(F.split(col(x), "[、，,;]"), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p.isin(allowed))), "、")


def confidence(x: str | Column) -> Column:
    return F.when(col(x).isin(CONFIDENCES), col(x)).otherwise("unknown")


def confidence_rank(x: str | Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CONFIDENCES)), confidence(x)).cast("int") - 1


def confidence_of_rank(rank: str | Column) -> Column:
    return F.get(F.array(*map(F.lit, CONFIDENCES)), col(rank).cast("int"))


def loudness_label(db: str | Column) -> Column:
    return bands(db, LOUDNESS, LOUDEST)


def cut_confidence(score: str | Column) -> Column:
    return F.when(col(score) >= 12, "high").otherwise("medium")


def motion_confidence(value: str | Column, threshold: str | Column) -> Column:
    ratio = F.try_divide(col(value), col(threshold))
    return F.when(col(threshold) <= 0, "unknown").when(ratio >= 1.8, "high").when(ratio >= 1.25, "medium").otherwise("low")


def motion_intensity(px: str | Column) -> Column:
    return bands(px, [(1, "static"), (3, "low"), (10, "medium")], "high")


def gap_state(level: str | Column, bass: str | Column) -> Column:
    return F.when((col(level) >= -18) | (col(bass) >= 150), "music").when(col(level) <= -55, "silent").otherwise("unknown")


def texture_state(level: str | Column, bass: str | Column, flatness: str | Column) -> Column:
    level, bass, flatness = col(level), col(bass), col(flatness)
    music = ((bass >= 150) & (flatness <= 0.5)) | ((level >= -18) & (bass >= 50) & (flatness <= 0.35))
    return F.when(level <= -55, "silent").when(music, "music").otherwise("unknown")


def representative_time(start: Column, end: Column) -> Column:
    """Midpoint inside [start, end); an illegal range raises."""
    legal = F.assert_true(end > start, "a shot must end after it starts")
    return F.when(legal.isNull(), F.least(F.greatest(F.floor((start + end) / 2), start), end - 1).cast("bigint"))


def adaptive_bin(duration: Column, width: int, most: int) -> Column:
    return F.when(F.ceil(duration / width) > most, F.ceil(duration / most)).otherwise(width).cast("bigint")


def content_summary(*columns: str | Column) -> Column:
    """The telling ones of the columns joined by ；."""
    return F.array_join(F.filter(F.array(*[F.trim(col(c)) for c in columns]), lambda x: raw_value_state(x) == "value"), "；")


def has_keyword(x: str | Column, words: list[str] = HOST_WORDS) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(col(x), F.lit(w))
    return hit


def transition(kind: str | Column) -> Column:
    """struct(value, state) of a boundary's type."""
    kind = col(kind)
    state = F.when(kind == "hardCutCandidate", "value").when(kind == "sourceStart", "absent").otherwise("unknown")
    return F.struct(F.when(kind == "hardCutCandidate", "硬切").alias("value"), state.alias("state"))


def fingerprint(*columns: str | Column, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the columns' JSON with sorted keys."""
    named = sorted(columns, key=lambda c: c if isinstance(c, str) else c._jc.toString())
    return F.substring(F.sha2(F.to_json(F.struct(*named)), 256), 1, size)


def text_fingerprint(x: str | Column, size: int = 12) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, size)


def relation_target(x: str | Column) -> Column:
    """The whole text '<kind> → Bnnnn' to struct(kind, target), both null if it is anything else."""
    pattern = r"^\s*(.+?)\s*→\s*(B\d{4})\s*$"
    found = lambda i: F.nullif(F.regexp_extract(col(x), pattern, i), F.lit(""))
    return F.struct(found(1).alias("kind"), found(2).alias("target"))


def relation_targets(x: str | Column) -> Column:
    """Every '→ Bnnnn' in the text."""
    return F.regexp_extract_all(col(x), F.lit(r"→\s*(B\d{4})"), F.lit(1))


def split_types(x: str | Column) -> Column:
    """Parts between 、 without blanks; blank or null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "、"), lambda p: F.trim(p)), lambda p: p != "")
