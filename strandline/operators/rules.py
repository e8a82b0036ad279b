"""Integrity rules compiled to one pass over each artifact and one grouping of what they say.

An artifact's rows explode to facts. A fact names a domain and a key (the shots of a video, the members of a batch), says that it defines the key or uses it, and
carries numbers to be summed or bounded; it may carry an issue, told if its test holds for the group of its key. Rules about a row alone are facts that are told at
once, and only rows that break them make one. So a rule across artifacts is no join: whoever defines a key and whoever uses it meet in one window over
(domain, key), and any number of rule groups share it (``judge``). Rules are SQL text, so that a group of any size is one expression
to build and parse. Equal facts of a task are summed before their keys meet, so that pure counts of a hot key cost a
row a task. A row that breaks a rule is told as often as it occurs, a rule about a key once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

ISSUE = ("severity", "artifact", "path", "message", "expected", "actual")
_FIELDS = {
    "domain": "string", "key": "string", "defines": "boolean", "n": "bigint", "x": "double", "low": "bigint", "high": "bigint", "said": "bigint", "mean": "double",
    "test": "string", "parts": "int", **dict.fromkeys(ISSUE, "string"),
}
_SUMS = {"n": "sum", "x": "sum", "low": "min", "high": "max"}
_WORDS = ("domain", "test", "severity", "artifact", "message")  # given as words, all other fields as SQL


class Sql(str):
    """SQL in place of a word."""


#: What may be asked of a key's group (definitions, uses, the sum of x, the bounds): holds, expected, actual, path; None: as the fact has it.
TESTS: dict[str, tuple[str, str | None, str | None, str | None]] = {
    "now": ("true", None, None, None),
    "undefined": ("_defs = 0", None, None, None),
    "undefined once": ("_defs = 0", None, None, None),
    "defined": ("_defs > 0", None, None, None),
    "unused": ("_uses = 0", None, None, None),
    "used": ("_uses > 0", None, None, None),
    "forbidden": ("_uses > 0", "0", "_uses", None),
    "count": ("not said <=> _uses", "_uses", "said", None),
    "undeclared": ("_defs = 0 and _uses > 0", "_uses", "0", None),
    "count if any": ("_uses > 0 and not said <=> _uses", "_uses", "said", None),
    "start": ("_low is not null and not said <=> _low", "_low", "said", None),
    "end": ("_high is not null and not said <=> _high", "_high", "said", None),
    "from": ("_low is not null and not said <=> _low", "said", "_low", None),
    "to": ("_high is not null and not said <=> _high", "said", "_high", None),
    "sum is one": ("abs(_x - 1) > 0.000001", None, None, None),
    "mean": ("_uses > 0 and abs(_x / _uses - mean) > 0.01", None, None, None),
    "two sums": ("_uses > 0 or _x > 0", "_uses", "cast(_x as bigint)", None),
    "place of first": ("_low is not null", None, None, "concat_ws('/', path, _low)"),
    "number of first": ("_low is not null", None, "_low", None),
}


def word(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ident(*columns: str) -> str:
    """A key of several columns, null if one of them is."""
    return "concat(" + ", '\x01', ".join(f"cast({c} as string)" for c in columns) + ")"


def path_of(*columns: str) -> str:
    return f"concat_ws('/', {', '.join(columns)})"


def differs(expected: str, actual: str) -> str:
    """Null equals null."""
    return f"not ({expected} <=> {actual})"


def fact(domain: str, key: str, defines: bool, when: str | None = None, **given) -> str:
    """One fact, null (and left out) where its key is null or ``when`` does not hold. ``given``: n, x, low, high, said, mean, test, parts and the fields of an issue."""
    given = {"n": "1", "parts": "1", "severity": "error", **given, "domain": domain, "key": key, "defines": str(defines).lower()}
    values = {f: "null" if given.get(f) is None else word(given[f]) if f in _WORDS and not isinstance(given[f], Sql) else given[f] for f in _FIELDS}
    row = ", ".join(f"{word(f)}, cast({values[f]} as {kind})" for f, kind in _FIELDS.items())
    return f"if(({key}) is not null{'' if when is None else f' and ({when})'}, named_struct({row}), null)"


def define(domain: str, key: str, test: str | None = None, **given) -> str:
    return fact(domain, key, True, test=test, **given)


def use(domain: str, key: str, test: str | None = None, **given) -> str:
    return fact(domain, key, False, test=test, **given)


def now(broken: str, artifact: str, path: str, message: str, expected: str | None = None, actual: str | None = None, severity: str = "error") -> str:
    """The issue of a row that breaks a rule by itself."""
    return fact("now", f"coalesce(cast({path} as string), '')", False, broken, test="now", artifact=artifact, path=path, message=message, expected=expected, actual=actual, severity=severity)


def facts(rows: DataFrame, *some: str, more: Sequence[str] = ()) -> DataFrame:
    """The facts of one artifact; ``more``: arrays of facts."""
    each = f"array({', '.join(some)})"
    return rows.selectExpr(f"inline(array_compact({'concat(' + ', '.join([each, *more]) + ')' if more else each}))")


def together(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts in at most four times as many partitions as a shuffle has: a union has the sum of its sides', and every task sends the figures of all sides' operators to the driver."""
    return reduce(DataFrame.unionByName, parts).coalesce(4 * int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unpacked(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over as many partitions as a shuffle has, eight a core at least. A given number is not joined again up to a size in compressed bytes, of which chains of windows and maps of wide rows need many times as much memory."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def _asked(field: int, otherwise: str, kind: str = "string") -> str:
    cases = " ".join(f"when {word(t)} then cast({how[field]} as {kind})" for t, how in TESTS.items() if how[field] is not None)
    return f"case test {cases} else {otherwise} end"


def dealt(part: DataFrame) -> DataFrame:
    """A group's facts, those of one task that are equal as one. They are summed behind a shuffle: in the tasks that make them, a map of facts keeps its memory while the sides that a task has yet to read ask for theirs."""
    from pyspark.sql import functions as F

    rows = unpacked(part.withColumn("_task", F.spark_partition_id()), "domain", "key", "_task")
    return rows.groupBy(*(f for f in _FIELDS if f not in _SUMS), "_task").agg(*(F.expr(f"{how}({f}) as {f}") for f, how in _SUMS.items())).drop("_task")


def judge(*parts: DataFrame) -> DataFrame:
    """The issues of all facts."""
    from pyspark.sql import functions as F

    group, used = "over (partition by domain, key)", lambda f: f"if(defines, null, {f})"
    rows = unpacked(together([dealt(p) for p in parts]), "domain", "key").selectExpr(
        *_FIELDS, f"count_if(defines) {group} as _defs", f"coalesce(sum({used('n')}) {group}, 0) as _uses",
        f"sum({used('x')}) {group} as _x", f"min({used('low')}) {group} as _low", f"max({used('high')}) {group} as _high")
    issue = {"expected": _asked(1, "expected"), "actual": _asked(2, "actual"), "path": _asked(3, "path")}
    as_given = [f for f in _FIELDS if f not in _SUMS and f not in issue]
    found = rows.where(_asked(0, "false", "boolean")).selectExpr("n", *as_given, *(f"{f} as _{f}" for f in issue), *(f"{how} as {f}" for f, how in issue.items()))
    # equal facts of several tasks are one, and facts that tell an issue are few; behind a shuffle for the same reason as in ``dealt``
    found = unpacked(found, *ISSUE, "parts").groupBy(*(c for c in found.columns if c != "n")).agg(F.sum("n").alias("n"))
    found = found.selectExpr("parts", "case when test in ('now', 'undefined') and parts = 1 then n else 1 end as _n", *ISSUE)
    # an issue of several parts needs all of them, and is told once
    found = found.groupBy(*ISSUE, "parts").agg(F.sum("_n").alias("_n")).where("_n >= parts")
    return found.selectExpr(*ISSUE, "explode(sequence(1L, if(parts = 1, _n, 1L))) as _i").drop("_i")
