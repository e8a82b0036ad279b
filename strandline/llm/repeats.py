"""Suffix-array dedup of byte windows by a depth-limited radix sort.

The order of suffixes matters only through the first ``depth`` bytes, so equal groups at that depth are exactly the
repeated windows. The sort goes by most significant digits, and a group that is down to one document leaves it:

1. First digit. Of a window's 24-byte substrings the smallest by hash (leftmost on ties) is its anchor; equal windows have
   equal anchors at equal places, so the anchor's hash is a digit that all of them share. Neighbouring windows mostly have the same anchor,
   which makes about one value for every 14 bytes. Blocks of texts send the distinct values to buckets and hear which occur in several documents.
2. Second digit. For those anchors, the run of text under the anchor's windows goes to the bucket of the anchor, once for each
   block. Runs that are equal as a whole are settled by their smallest doc_id.
3. Further digits. In an anchor's group with different runs, the windows are sorted by eight bytes at a time, leaving
   out those that have become single, until the depth is reached.

Each block hears, for each of its runs, the smallest doc_id that has the run and which windows occur in a
document of a smaller one; bytes under such windows are removed.

Defined results: null text is empty; texts under ``depth`` bytes lose nothing; a null doc_id counts as larger than all others; rows
of the same doc_id never remove each other's bytes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .exchange import U64, bucket_of, dealt, mix, shared, to_buckets, weights_of

DEPTH = 50
ANCHOR = 24
SEGMENT = 1 << 17
NO_ID = np.iinfo(np.int64).max
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = [U64(x) for x in np.random.default_rng(51).integers(1, 1 << 63, 8, dtype=np.uint64) * U64(2) + U64(1)]

RUNS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchor", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("size", pa.binary()), ("text", pa.binary())])
RUNS_SQL = "bucket int, block int, anchor binary, doc binary, place binary, size binary, text binary"
VERDICT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("least", pa.binary()), ("mask", pa.binary())])
VERDICT_SQL = "block int, bucket int, least binary, mask binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def substring_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR (16 + 8) bytes from each place."""
    h = _BYTE[data]
    for i, width in enumerate((1, 2, 4)):
        h = h[:-width] * _STEP[i] + h[width:]
    eight = h
    h = h[:-8] * _STEP[3] + h[8:]
    return mix(h[:-8] * _STEP[4] + eight[16:])


def window_anchors(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the windows of ``depth`` bytes in data, a segment at a time: where the segment starts, the place of each window's anchor and the anchor's hash."""
    span = depth - ANCHOR + 1
    for at in range(0, len(data) - depth + 1, SEGMENT):
        h = substring_hashes(data[at : min(len(data), at + SEGMENT + depth - 1)])
        low, width = (h & U64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        own = (low & U64(0xFFFFFF)).astype(np.int64)
        yield at, own + at, h[own]


class Block:
    """Texts of a block laid end to end, and their runs: windows first..last, all in one text, that share an anchor."""

    def __init__(self, rows: pa.Table, depth: int) -> None:
        ids = rows["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy()
        bodies = rows["body"].to_pylist()
        # a fixed order: the rows of a block may arrive in another one each time, and what is sent is answered by position
        order = sorted(range(len(bodies)), key=lambda i: (ids[i], bodies[i]))
        bodies, ids = [bodies[i] for i in order], ids[order]
        given = rows["doc_id"].to_pylist()
        self.given = [given[i] for i in order]
        self.bodies, self.ids = bodies, ids
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.raw = b"".join(bodies)
        data = np.frombuffer(self.raw, np.uint8)
        runs, stops = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))], []
        before = (-1, -1, False)  # place, text and wholeness of the window before
        for at, place, code in window_anchors(data, depth):
            window = np.arange(at, at + len(place))
            text = np.searchsorted(self.ends, window, "right")
            whole = self.ends[text] - depth >= window
            place_, text_, whole_ = (np.concatenate(([x], y[:-1])) for x, y in zip(before, (place, text, whole)))
            new = (place != place_) | (text != text_) | ~whole_.astype(bool)
            first = np.flatnonzero(new & whole)
            runs.append((window[first], code[first], (place[first] - window[first]).astype(np.uint8), text[first]))
            stops.append(window[np.flatnonzero((new | ~whole) & whole_.astype(bool))] - 1)
            before = (place[-1], text[-1], whole[-1])
        if before[2]:
            stops.append(np.array([len(data) - depth]))
        self.first, code, self.place, self.text = (np.concatenate([r[i] for r in runs]) for i in range(4))
        self.last = np.concatenate([*stops, np.zeros(0, np.int64)]).astype(np.int64)
        self.anchor = mix(code + U64(0x9E3779B97F4A7C15))
        self.doc = ids[self.text]


def _block_number(rows: pa.Table) -> int:
    return rows["block"][0].as_py()


class Runs:
    """The distinct runs of a block under shared anchors, by bucket: what is sent, and in which order."""

    def __init__(self, block: Block, answer: pa.Table, buckets: int, depth: int) -> None:
        keep = np.flatnonzero(weights_of(block.anchor, answer, buckets))
        self.keep = keep
        first, end = block.first[keep], block.last[keep] + depth
        number: dict[tuple, int] = {}
        raw, anchor, place = block.raw, block.anchor[keep].tolist(), block.place[keep].tolist()
        self.slot = np.fromiter((number.setdefault((a, p, raw[s:e]), len(number)) for a, p, s, e in zip(anchor, place, first.tolist(), end.tolist())), np.int64, len(keep))
        self.count = len(number)
        self.sample = np.zeros(self.count, np.int64)
        self.sample[self.slot] = np.arange(len(keep))
        self.least = np.full(self.count, NO_ID)
        np.minimum.at(self.least, self.slot, block.doc[keep])
        own = block.anchor[keep][self.sample] if self.count else np.zeros(0, np.uint64)
        self.bucket = bucket_of(own, buckets)
        self.order = np.argsort(self.bucket, kind="stable")
        self.edges = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))
        self.first, self.end, self.anchor, self.place = first, end, own, block.place[keep]

    def rows(self, block: Block, number: int) -> pa.Table:
        out = []
        for b, (s, e) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            if e > s:
                own = self.order[s:e]
                at = self.sample[own]
                text = b"".join(block.raw[i:j] for i, j in zip(self.first[at].tolist(), self.end[at].tolist()))
                size = (self.end[at] - self.first[at]).astype(np.uint8 if ANCHOR + 2 * DEPTH < 256 else np.int32)
                out.append((b, number, self.anchor[own].tobytes(), self.least[own].tobytes(), self.place[at].tobytes(), size.tobytes(), text))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(RUNS)], schema=RUNS)


def _send_runs(buckets: int, depth: int):
    def run(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows or not answer.num_rows:
            return RUNS.empty_table()
        block = Block(rows, depth)
        return Runs(block, answer, buckets, depth).rows(block, _block_number(rows))

    return run


def sort_windows(group: np.ndarray, windows: np.ndarray, docs: np.ndarray, depth: int) -> np.ndarray:
    """Radix passes of eight bytes over windows (rows of ``depth`` bytes) that start out in ``group``; the smallest doc of each window's equal group."""
    least = docs.copy()
    live = np.arange(len(group))
    pad = -depth % 8
    digits = np.pad(windows, ((0, 0), (0, pad))).view(">u8") if len(windows) else np.zeros((0, 1), ">u8")
    for level in range(digits.shape[1]):
        if not len(live):
            break
        digit = digits[live, level].astype(np.uint64)
        order = np.lexsort((digit, group))
        g, d = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        rank = np.cumsum(new) - 1
        size = np.bincount(rank)
        more = size[rank] > 1
        live, group = live[order[more]], rank[more]
    if len(live):
        best = np.full(int(group.max()) + 1, NO_ID)
        np.minimum.at(best, group, docs[live])
        least[live] = np.minimum(least[live], best[group])
    return least


def _judge(depth: int):
    def run(sent: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return VERDICT.empty_table()
        anchor = np.concatenate([np.frombuffer(b, np.uint64) for b in sent["anchor"].to_pylist()])
        doc = np.concatenate([np.frombuffer(b, np.int64) for b in sent["doc"].to_pylist()])
        place = np.concatenate([np.frombuffer(b, np.uint8) for b in sent["place"].to_pylist()])
        size = np.concatenate([np.frombuffer(b, np.uint8) for b in sent["size"].to_pylist()]).astype(np.int64)
        text = b"".join(sent["text"].to_pylist())
        counts = [len(b) for b in sent["size"].to_pylist()]
        ends = np.cumsum(size)
        starts = ends - size
        number: dict[tuple, int] = {}
        run_of = np.fromiter((number.setdefault((a, p, text[s:e]), len(number)) for a, p, s, e in zip(anchor.tolist(), place.tolist(), starts.tolist(), ends.tolist())), np.int64, len(size))
        least = np.full(len(number), NO_ID)
        np.minimum.at(least, run_of, doc)
        sample = np.zeros(len(number), np.int64)
        sample[run_of] = np.arange(len(size))
        # anchors with different runs: compare their windows
        _, group = np.unique(anchor[sample], return_inverse=True)
        mixed = np.flatnonzero(np.bincount(group)[group] > 1)
        mask = np.zeros(len(number), np.uint32)
        at = sample[mixed]
        many = size[at] - depth + 1
        data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), depth) if len(mixed) else None
        # windows of one anchor are comparable where the anchor lies at the same distance: one distance at a time, at most one window of each run
        for before in range(depth - ANCHOR + 1 if len(mixed) else 0):
            offset = place[at].astype(np.int64) - before
            own = np.flatnonzero((offset >= 0) & (offset < many))
            if len(own):
                best = sort_windows(group[mixed[own]], data[starts[at[own]] + offset[own]], least[mixed[own]], depth)
                hit = own[best < least[mixed[own]]]
                mask[mixed[hit]] |= np.uint32(1) << offset[hit].astype(np.uint32)
        bucket, rows, s = sent["bucket"][0].as_py(), [], 0
        for block, n in zip(sent["block"].to_pylist(), counts):
            own = run_of[s : s + n]
            s += n
            rows.append((block, bucket, least[own].tobytes(), mask[own].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(VERDICT)], schema=VERDICT)

    return run


def _remove(buckets: int, depth: int):
    def run(rows: pa.Table, heard: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return RESULT.empty_table()
        answer = heard.filter(pc.is_valid(heard["weights"])) if heard.num_rows else heard
        verdict = heard.filter(pc.is_valid(heard["least"])) if heard.num_rows else heard
        if not answer.num_rows or not verdict.num_rows:
            given, bodies = rows["doc_id"].to_pylist(), rows["body"].to_pylist()
            return _table([(i, len(b), 0, [], b) for i, b in zip(given, bodies)])
        block = Block(rows, depth)
        runs = Runs(block, answer, buckets, depth)
        least, mask = np.full(runs.count, NO_ID), np.zeros(runs.count, np.uint32)
        for bucket, a, m in zip(verdict["bucket"].to_pylist(), verdict["least"].to_pylist(), verdict["mask"].to_pylist()):
            own = runs.order[runs.edges[bucket] : runs.edges[bucket + 1]]
            least[own], mask[own] = np.frombuffer(a, np.int64), np.frombuffer(m, np.uint32)
        docs, slot = block.doc[runs.keep], runs.slot
        depth_mark = np.zeros(len(block.raw) + 1, np.int32)
        whole = least[slot] < docs
        np.add.at(depth_mark, runs.first[whole], 1)
        np.add.at(depth_mark, runs.end[whole], -1)
        part = np.flatnonzero(~whole & (mask[slot] != 0))
        for bit in range(depth - ANCHOR + 1):
            own = part[(mask[slot[part]] >> np.uint32(bit)) & np.uint32(1) == 1]
            np.add.at(depth_mark, runs.first[own] + bit, 1)
            np.add.at(depth_mark, runs.first[own] + bit + depth, -1)
        gone = np.cumsum(depth_mark[:-1]) > 0
        out = []
        for given, body, s, e in zip(block.given, block.bodies, block.starts.tolist(), block.ends.tolist()):
            own = gone[s:e]
            if not own.any():
                out.append((given, len(body), 0, [], body))
                continue
            edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
            out.append((given, len(body), int(own.sum()), spans, np.frombuffer(body, np.uint8)[~own].tobytes()))
        return _table(out)

    return run


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte ranges), kept (the remaining bytes). ``depth`` from 30 to 50."""
    if not ANCHOR < depth <= DEPTH:
        raise ValueError(f"depth must be over {ANCHOR} and at most {DEPTH}")
    blocks, buckets = dealt(docs)

    def send(rows: pa.Table) -> pa.Table:
        block = Block(rows, depth)
        return to_buckets(block.anchor, block.doc, _block_number(rows), buckets)

    answer = shared(blocks, send)
    runs = blocks.groupBy("block").cogroup(answer.groupBy("block")).applyInArrow(_send_runs(buckets, depth), RUNS_SQL)
    verdict = runs.groupBy("bucket").applyInArrow(_judge(depth), VERDICT_SQL)
    heard = answer.unionByName(verdict, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(_remove(buckets, depth), RESULT_SQL)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
