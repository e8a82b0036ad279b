"""Conversation structure repair by depth-first branch-and-bound.

A conversation is repaired by the cheapest edits (keep, rerole, delete, insert) after which its roles read system?, then user and assistant in turn.
``solve`` walks prefixes with an explicit stack: a lower bound on what the rows behind must cost and the incumbent (cost, audit) cut
branches, and a table at every node (rows read, place in the pattern) cuts prefixes that are no better than one seen there. Two prefixes at one
node with equal costs differ before either ends (insertions alone would differ in cost), so the better one stays better whatever follows.

The same argument makes segments compose: the best edits of a stretch of rows from one place of the pattern to another are a table of 4 x 4,
and tables chain by (sum of costs, joined audits). So a conversation of any size is spread:

1. Rows are reduced to a digest of role and text, the first letter of the role, flags and a count, and equal rows of a turn are summed, before they are shuffled.
2. The first row of each (conversation, digest) is no duplicate.
3. Rows are dealt by ranges of (conversation, turn), so that a long conversation lies on many tasks. Conversations that end inside one are solved there; those that
   reach a task's edge or ``SEGMENT`` rows give tables of segments.
4. Segments, then the texts in order, stream through a task for each conversation: tables are chained, what all four best audits have in common is settled, and the repaired text
   is hashed row by row. One SHA-256 over one conversation is sequential by nature; nothing but the audit is held.

Rows of one turn are taken by the digest of role and text, so equal rows are neighbours.

Defined results: null role, text, conversation and turn count as one space in hashes and texts, and a null conversation is one of its own; null turns come first and open no
gaps; conversations without rows left have zeros, an empty audit and the hash of an empty string; repeated rows are duplicates; roles other than system, user and assistant can be reroled or deleted
only (their first letter decides); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of one segment of a long conversation.
SEGMENT = 64
ROWS = 5000
SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()

#: Places in the pattern: nothing yet, after system, after user, after assistant; a repaired conversation ends at the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = frozenset((START, ASSISTANT))
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})  # by place: first letters that may follow, and where they lead
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled row leads
ROLE = {USER: "user", ASSISTANT: "assistant"}

Best = tuple[int, str]


def suffix_bounds(codes: str, goals: frozenset[int]) -> list[tuple[int, int]]:
    """For each row: the least that it and all rows behind it cost if a user or an assistant is due. Relaxed: system rows may stay anywhere, and places
    where a user is due are one."""
    late = [TRUNCATED if c in "SUA+" else 0 for c in codes]
    ends = {g == USER for g in goals}
    out = [tuple(0 if due in ends else INSERT for due in (False, True))]
    for c, more in zip(reversed(codes), reversed(late)):
        behind, own = out[-1], []
        for due in (0, 1):
            ways = [DELETE + behind[due]]
            if c != "x":
                ways.append(more + (KEEP if c.lower() == "ua"[due] else REROLE) + behind[1 - due])
            if c in "sS":
                ways.append(more + KEEP + behind[due])
            own.append(min(ways))
        out.append((min(own[0], INSERT + own[1]), min(own[1], INSERT + own[0])))
    return out[::-1]


@lru_cache(100_000)
def solve(codes: str, entry: int = START, goals: frozenset[int] = GOALS) -> Best | None:
    """Least (cost, audit) that leads over all rows from ``entry`` to one of ``goals``. Codes: x for rows that must go, else the role's first letter (- for others, + if
    truncated), upper case if the row is truncated."""
    n, best = len(codes), None
    behind = suffix_bounds(codes, goals)
    seen: dict[tuple[int, int], Best] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, place = stack.pop()
        least = cost + behind[i][place == USER]
        if best is not None and (least > best[0] or least == best[0] and audit > best[1]):
            continue
        known = seen.get((i, place))
        if known is not None and known <= (cost, audit):
            continue
        seen[i, place] = cost, audit
        if i == n and place in goals and (best is None or (cost, audit) < best):
            best = cost, audit
        more = [(cost + INSERT, audit + "I", i, NEXT[place])]
        if i < n:
            code = codes[i]
            more.append((cost + DELETE, audit + "D", i + 1, place))
            if code != "x":
                late = TRUNCATED if code in "SUA+" else 0
                more.append((cost + REROLE + late, audit + "R", i + 1, NEXT[place]))
                kept = KEPT[place].get(code.lower())
                if kept is not None:
                    more.append((cost + KEEP + late, audit + "K", i + 1, kept))
        stack += sorted(more, key=lambda m: (m[0] + behind[m[2]][m[3] == USER], m[1]), reverse=True)
    return best


def transitions(codes: str) -> list[Best | None]:
    """Best edits from every place (major) to every place."""
    return [solve(codes, a, frozenset((b,))) for a in range(4) for b in range(4)]


class Chain:
    """Best edits from the start to every place over the segments so far; ``done`` is the part of the audit that all of them share."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.best: list[Best | None] = [(0, ""), None, None, None]

    def add(self, step: list[Best | None]) -> None:
        ways = [[(x[0] + y[0], x[1] + y[1]) for a, x in enumerate(self.best) if x is not None and (y := step[4 * a + b]) is not None] for b in range(4)]
        self.best = [min(w, default=None) for w in ways]
        shared = os.path.commonprefix([x[1] for x in self.best if x is not None])
        if shared:
            self.done.append(shared)
            self.best = [None if x is None else (x[0], x[1][len(shared) :]) for x in self.best]

    def end(self) -> Best:
        cost, audit = min(x for b, x in enumerate(self.best) if x is not None and b in GOALS)
        return cost, "".join(self.done) + audit


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (0 if the row is dropped, 2 if repeated), by a hash of conversation and turn."""
    given = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    given = given.withColumn("d", F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20)
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, n, initial, blank, cut_off, first: one row for all equal rows of a turn; ``rows``: conv_id, turn, digest, role, text, n."""
    tail = F.rtrim("text", F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    rows = rows.select("conv_id", "turn", "digest", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    equal = rows.groupBy("conv_id", "turn", "digest").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("initial", "blank", "cut_off")))
    order = W.partitionBy("conv_id", "digest", F.col("n") > 0).orderBy(F.asc_nulls_first("turn"))
    return equal.withColumn("first", F.row_number().over(order) == 1)


SEGMENTS = (
    "conv_id bigint, turn bigint, digest binary, part int, count bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, initials string, "
    "low bigint, high bigint, turns bigint, costs array<bigint>, audits array<string>"
)
_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("count", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("initials", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
LEGAL = frozenset(("su", "ua", "au"))


class Segment:
    """Rows of one conversation in order."""

    def __init__(self, conv_id: int | None, turn: int | None, digest: bytes, part: int) -> None:
        self.key = conv_id, turn, digest, part  # place of the first row, number of the segment within the task
        self.codes: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.initials = ""  # of the first and the last row
        self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, cut_off: bool, duplicate: bool) -> None:
        self.illegal += bool(self.codes) and self.initials[-1] + initial not in LEGAL
        self.initials = (self.initials or initial)[0] + initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if blank or duplicate:
            self.blank += blank
            self.duplicate += not blank
            self.codes.append("x")
        else:
            self.truncated += cut_off
            self.codes.append(("+" if initial == "-" else initial.upper()) if cut_off else initial)

    def row(self, edge: bool) -> tuple:
        codes = "".join(self.codes)
        best = transitions(codes) if edge else [solve(codes)]
        costs, audits = [None if b is None else b[0] for b in best], [None if b is None else b[1] for b in best]
        return (*self.key, len(codes), self.blank, self.duplicate, self.truncated, self.illegal, self.initials, self.low, self.high, self.turns, costs, audits)


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, edge, out = None, True, []
        for batch in slices(batches, ROWS):
            for conv_id, turn, digest, n, initial, blank, cut_off, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "n", "initial", "blank", "cut_off", "first"))):
                if own is None or own.key[0] != conv_id:
                    if own is not None:
                        out.append(own.row(edge))
                        edge = False
                    own = Segment(conv_id, turn, digest, 0)
                for i in range(n):
                    if len(own.codes) == size:
                        out.append(own.row(True))
                        own, edge = Segment(conv_id, turn, digest, own.key[3] + 1), True
                    own.add(turn, initial, blank, cut_off, i > 0 or not first)
                if len(out) >= ROWS:
                    yield _batch(out, _SEGMENTS)
                    out = []
        if own is not None:
            out.append(own.row(True))
        if out:
            yield _batch(out, _SEGMENTS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Repair:
    """One conversation: its segments, then its rows."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.chain, self.whole = conv_id, Chain(), None
        self.sums = [0] * 4  # blank, duplicate, truncated, illegal
        self.last, self.low, self.high, self.turns = "", None, None, 0
        self.audit: str | None = None
        self.at, self.place, self.hash, self.written = 0, START, hashlib.sha256(), False

    def segment(self, count, sums, initials, low, high, turns, costs, audits) -> None:
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        if count:
            self.sums[3] += bool(self.last) and self.last + initials[0] not in LEGAL
            self.last = initials[-1]
        if turns:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        if len(costs) == 1:
            self.whole = costs[0], audits[0]
        else:
            self.chain.add([None if c is None else (c, a) for c, a in zip(costs, audits)])

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.whole or self.chain.end()

    def _write(self, line: str) -> None:
        self.hash.update((("\n" if self.written else "") + line).encode())
        self.written = True

    def _insert(self) -> None:
        while self.audit.startswith("I", self.at):
            self.place, self.at = NEXT[self.place], self.at + 1
            self._write(ROLE[self.place] + ":")

    def row(self, role: str, text: str) -> None:
        self.settle()
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.place = KEPT[self.place][role[:1]]
            self._write(f"{role}:{text}")
        elif edit == "R":
            self.place = NEXT[self.place]
            self._write(f"{ROLE[self.place]}:{text}")

    def result(self) -> tuple:
        self.settle()
        self._insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.sums, self.cost, self.audit, self.hash.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, out = None, []
    for batch in slices(batches):
        for r in batch.to_pylist():
            if own is None or own.conv_id != r["conv_id"]:
                if own is not None:
                    out.append(own.result())
                own = Repair(r["conv_id"])
            if r["role"] is None:
                own.segment(r["count"], [r[c] for c in ("blank", "duplicate", "truncated", "illegal")], r["initials"], r["low"], r["high"], r["turns"], r["costs"], r["audits"])
            else:
                for _ in range(r["n"]):
                    own.row(r["role"], r["text"])
        if len(out) >= ROWS:
            yield _batch(out, _RESULT)
            out = []
    if own is not None:
        out.append(own.result())
    if out:
        yield _batch(out, _RESULT)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text without nulls, n: how often the row occurs, 0 for conversations that are to be listed):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    name = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("digest", F.substring(F.unhex(F.sha2(name, 256)), 1, 16))
    order = ["conv_id", "turn", "digest"]
    ranged = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    heads = ranged.mapInArrow(_segments(segment), SEGMENTS)
    both = heads.unionByName(rows.where("n > 0").select(*order, "role", "text", "n"), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("role").isNotNull(), "turn", "digest", "part")
    return dealt.mapInArrow(_repair, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
