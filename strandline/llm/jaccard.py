"""Similarity join of shingle sets by universe partitioning.

Every document is the set of its distinct five-word shingles. Size bands grow by the inverse of the similarity, so that two linked
sets lie in one band or in neighbouring ones, and a set takes part in the scheme of its own band and of the next. A
scheme hashes the shingles into segments. Linked sets of sizes s and t differ in at most H = (s + t) / 7 shingles, so
of any H + 1 segments of one of them at least one is equal in the other (pigeonhole). A scheme has more segments than that, and
a set is free to choose:

* Signatures of all its segments are sent to buckets in packed form, which answer how many blocks hold each.
* Cost-based allocation: a set probes with its H + 1 cheapest non-empty segments. Segments that no other set has cost nothing and
  are not looked up at all, and those of common passages are left alone while rarer ones suffice.
* In the bands of small sets, where a set may lack non-empty segments, a segment of two or more shingles can count twice, by looking up its
  one-deletion neighbourhood as well: it then fails only if it differs in two shingles.

Sets equal as a whole are joined first. Candidates are verified on whole sets (of 64-bit shingle hashes). Large groups of near copies are not
expanded to pairs: first each of a sample of signature groups links its members to a leader, and verified links give components; then
all candidate pairs whose documents are still in different components are verified, without a cap, packed by the place that verifies them.
Links inside a component change no class, so classes are exact. Two kinds of sets leave this path for an exact one of their own:

* Signature groups that would make too many pairs in one task (near copies of a template that stay under the similarity) give no pairs.
  Their members form clusters, which are cut into parts of bounded bytes by size band; each pair of parts is one task's work and tells most
  pairs apart by parity bitmaps, whose differing bits are a lower bound of the sets' difference.
* Sets of which so many shingles share segments that even double counting falls short of H + 1 (rare) are compared with every text
  through a prefix of their shingles, in broadcasts of bounded size.

Defined results: null or empty text, or no words, is an empty set, linked with nothing; one to four words are one shingle;
exact copies are linked; a null doc_id is linked with nothing and has a null component_id; rows that repeat a doc_id are documents of
their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table
from .exchange import ANSWER_SQL, SENT_SQL, U64, bucket_of, compare, dealt, mix, to_buckets, weights_of
from .graph import components

SHINGLE = 5
#: Links have PER_UNION * shared >= PER_SHARED * union, here 100 * shared >= 75 * union.
PER_UNION, PER_SHARED = 100, 75
SMALL = 64
PIECE = 1 << 20
LEADERS = 4
SAMPLED = 16
#: Pairs that a bucket hands on; groups beyond that are verified by parts of so many bytes. Bits of a parity bitmap, at most.
PAIRS_A_BUCKET = 1 << 21
PART_BYTES = 16 << 20
BITMAP_BITS = 1 << 16
#: Bytes of sets short of segments that are broadcast at once.
SHORT_BYTES = 16 << 20
#: Places where pairs are verified, for each bucket; and how many members of a leader share one.
HOMES = 4
HOME_DOCS = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = [U64(x) for x in _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U64(2) + U64(1)]
_BASE = int(_RANDOM.integers(1, 1 << 62)) * 4 + 3
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, U64(base))
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash."""
    raw = np.frombuffer(data.translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([0], (~_SPACE[raw]).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power, dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < PIECE):
            size += len(texts[to]) + 1
            to += 1
        own = texts[at:to]
        start, words = word_hashes(b" ".join(own))
        edges = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in own)]))
        n = max(0, len(words) - SHINGLE + 1)
        whole = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            whole += words[j : n + j] * _PLACE[j]
        whole = mix(whole)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s >= SHINGLE:
                out.append(np.unique(whole[s : e - SHINGLE + 1]))
            elif e > s:
                out.append(mix((words[s:e] * np.array(_PLACE[: e - s])).sum(keepdims=True) + U64(e - s)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def set_key(items: np.ndarray) -> bytes:
    """128 bits and the size: equal for equal sets."""
    return b"".join(int(x).to_bytes(8, "little") for x in (mix(items + _PLACE[0]).sum(), mix(items ^ _PLACE[1]).sum(), len(items)))


def band_edges(size: int) -> list[tuple[int, int]]:
    """Bands (lowest, highest size) up to the one after that of ``size``."""
    out, low = [], 1
    while not out or out[-1][0] <= size:
        high = max(low, low * PER_UNION // PER_SHARED)
        out.append((low, high))
        low = high + 1
    return out


def most_different(s, t):
    """Most shingles in which linked sets of these sizes can differ: a seventh of s + t. Grows with either size, so it holds for all smaller ones too."""
    return (s + t) * (PER_UNION - PER_SHARED) // (PER_UNION + PER_SHARED)


def segments_of(high: int) -> int:
    """More than most_different + 1: some stay empty, some hold only common shingles."""
    need = most_different(high, high) + 1
    return 4 * high if high <= 16 else 2 * need + 8 if high <= SMALL else need * 7 // 5 + 8


class Signatures:
    """Signatures of many sets: hash, owner (number of the set), group (set and scheme), segment, and whether it is of a segment or of one less a shingle."""

    def __init__(self, sets: list[np.ndarray], segments: Callable[[int], int] = segments_of) -> None:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bands = band_edges(int(sizes.max(initial=1)))
        low, high = (np.array([b[i] for b in bands]) for i in (0, 1))
        items = np.concatenate([*sets, np.zeros(0, np.uint64)])
        parts, base = [], 0
        self.need = np.zeros(2 * len(sets), np.int64)
        for scheme in (0, 1):
            band = np.searchsorted(high, sizes) + scheme
            taking = np.ones(len(sets), bool) if not scheme else sizes * PER_UNION // PER_SHARED >= low[np.minimum(band, len(low) - 1)]
            top = high[np.minimum(band, len(high) - 1)]
            many = np.array([segments(int(h)) for h in high])[np.minimum(band, len(high) - 1)]
            self.need[scheme::2] = np.where(taking, most_different(sizes, top) + 1, 0)
            owner = np.repeat(np.arange(len(sets)), sizes)
            mine = taking[owner]
            owner, own = owner[mine], items[mine]
            code = mix(own + (band.astype(np.uint64) + U64(1))[owner] * _PLACE[2])
            place = ((code >> U64(32)) * many.astype(np.uint64)[owner] >> U64(32)).astype(np.int64)
            starts = np.cumsum(many) - many
            cell = starts[owner] + place
            total, count = np.zeros(int(many.sum()), np.uint64), np.bincount(cell, minlength=int(many.sum()))
            np.add.at(total, cell, code)
            full = np.flatnonzero(count)
            of = np.repeat(np.arange(len(sets)), many)
            salt = mix((band.astype(np.uint64) << U64(40))[of] + (np.arange(len(of)) - starts[of]).astype(np.uint64))
            parts.append((mix(total[full] + salt[full]), of[full], 2 * of[full] + scheme, base + full, np.zeros(len(full), bool)))
            less = np.flatnonzero((top <= SMALL)[owner] & (count[cell] > 1))
            at = cell[less]
            parts.append((mix(total[at] - code[less] + salt[at]), owner[less], 2 * owner[less] + scheme, base + at, np.ones(len(less), bool)))
            base += len(of)
        self.hashes, self.owner, self.group, self.segment, self.less = (np.concatenate([p[i] for p in parts]) for i in range(5))
        groups = len(self.need)
        _, twice = np.unique(self.segment[self.less], return_index=True)
        held = np.bincount(self.group[~self.less], minlength=groups) + np.bincount(self.group[self.less][twice], minlength=groups)
        #: Sets that cannot count up to ``need`` in one of their schemes.
        self.short = (held < self.need).reshape(-1, 2).any(1)

    def allocate(self, weights: np.ndarray) -> np.ndarray:
        """Which signatures to look up: for each set and scheme the cheapest that together count ``need``."""
        cost = np.where(weights > 0, np.exp2(weights / 8.0), 0.0)
        out = np.zeros(len(cost), bool)
        whole = np.flatnonzero(~self.less)
        order = whole[np.lexsort((cost[whole], self.group[whole]))]
        group = self.group[order]
        first = np.searchsorted(group, group)
        out[order[np.arange(len(order)) - first < self.need[group]]] = True
        # sets that lack segments: those of several shingles count twice, cheapest first, with their one-deletion neighbourhoods
        short = self.need - np.bincount(self.group[whole], minlength=len(self.need))
        less = np.flatnonzero(self.less & (short > 0)[self.group])
        price: dict[tuple[int, int], float] = {}
        for i in less.tolist():
            key = int(self.group[i]), int(self.segment[i])
            price[key] = price.get(key, 0.0) + float(cost[i])
        taken, left = set(), short.copy()
        for (g, segment), _ in sorted(price.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            if left[g] > 0:
                left[g] -= 1
                taken.add(segment)
        out[[i for i in less.tolist() if int(self.segment[i]) in taken]] = True
        return out


ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("hashes", pa.binary()), ("nodes", pa.binary()), ("probes", pa.binary()), ("short", pa.bool_())])
ROWS_SQL = "bucket int, block int, node bigint, hashes binary, nodes binary, probes binary, short boolean"
PAIRS_SQL = "a bigint, b bigint"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches):
        sets = shingle_sets(rows.column("body").to_pylist())
        columns = [rows.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_key(x) for x in sets], pa.binary()), rows.column("block")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key", "block"])


def _representatives(rows: pa.Table, heard: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Numbers of the sets that texts of the block stand for, in order, and the sets."""
    wanted = {(d, bytes(k)): n for d, k, n in zip(*(heard[c].to_pylist() for c in ("doc_id", "key", "node"))) if k is not None}
    ids = rows["doc_id"].to_pylist()
    known = {d for d, _ in wanted}
    at = [i for i, d in enumerate(ids) if d in known]
    bodies = rows["body"].take(pa.array(at, pa.int64())).to_pylist()
    found = {}
    for i, items in zip(at, shingle_sets(bodies)):
        if (node := wanted.get((ids[i], set_key(items)))) is not None:
            found[node] = items
    return sorted(found), [found[k] for k in sorted(found)]


def _send(buckets: int, segments: Callable[[int], int]):
    def run(rows: pa.Table, heard: pa.Table) -> pa.Table:
        docs, sets = _representatives(rows, heard) if rows.num_rows and heard.num_rows else ([], [])
        signatures = Signatures(sets, segments)
        return to_buckets(signatures.hashes, signatures.owner, rows["block"][0].as_py() if docs else 0, buckets)

    return run


def _probe(buckets: int, segments: Callable[[int], int]):
    def run(rows: pa.Table, heard: pa.Table) -> pa.Table:
        if not rows.num_rows or not heard.num_rows:
            return ROWS.empty_table()
        answer = heard.filter(pc.is_valid(heard["weights"]))
        nodes, sets = _representatives(rows, heard.filter(pc.is_valid(heard["key"])))
        if not nodes:
            return ROWS.empty_table()
        signatures = Signatures(sets, segments)
        weights = weights_of(signatures.hashes, answer, buckets)
        probes = signatures.allocate(weights)
        # a set none of whose probes occurs elsewhere is linked with nothing, so no other set needs to find it either
        live = np.zeros(len(nodes), bool)
        live[signatures.owner[probes & (weights > 0)]] = True
        keep = np.flatnonzero(live[signatures.owner] & (weights > 0))
        hashes, owner, probes = signatures.hashes[keep], signatures.owner[keep], probes[keep]
        at = bucket_of(hashes, buckets)
        order = np.argsort(at, kind="stable")
        cuts, ids, block, out = np.searchsorted(at[order], np.arange(buckets + 1)), np.array(nodes, np.int64), rows["block"][0].as_py(), []
        for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
            if e > s:
                own = order[s:e]
                out.append((b, block, None, hashes[own].tobytes(), ids[owner[own]].tobytes(), probes[own].tobytes(), None))
        short = signatures.short
        out += [(None, block, nodes[i], sets[i].tobytes(), None, None, bool(short[i])) for i in np.flatnonzero(live | short).tolist()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(ROWS)], schema=ROWS)

    return run


def _joined(sent: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, kind) for b in sent[column].to_pylist()])


def _leaders(sampled: int):
    def run(sent: pa.Table) -> pa.Table:
        return _sampled_leaders(sent, sampled)

    return run


def _sampled_leaders(sent: pa.Table, sampled: int) -> pa.Table:
    """In a sample of the signature groups that somebody probes, each member with the group's leader under one of a few orders: a is the leader."""
    hashes, docs, probes = _joined(sent, "hashes", np.uint64), _joined(sent, "nodes", np.int64), _joined(sent, "probes", bool)
    own = np.flatnonzero(hashes % U64(sampled) == 0)
    hashes, docs, probes = hashes[own], docs[own], probes[own]
    rank = mix(docs.astype(np.uint64) + (hashes // U64(sampled) % U64(LEADERS)) * _PLACE[3])
    order = np.lexsort((rank, hashes))
    hashes, docs, probes = hashes[order], docs[order], probes[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(hashes)))
    asked = np.logical_or.reduceat(probes, first) if len(first) else np.zeros(0, bool)
    leader, keep = np.repeat(docs[first], size), np.repeat(asked, size)
    both = np.unique(np.stack([leader, docs], 1)[keep & (leader != docs)], axis=0) if len(docs) else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


MARKED_SQL = "bucket int, hashes binary, nodes binary, probes binary, comps binary, homes binary"


def _with_classes(sent: pa.Table, classes: pa.Table) -> pa.Table:
    """The rows of a block with each set's class and home."""
    known = dict(zip(classes["node"].to_pylist(), zip(classes["comp"].to_pylist(), classes["home"].to_pylist())))
    out = []
    for bucket, hashes, docs, probes in zip(*(sent[c].to_pylist() for c in ("bucket", "hashes", "nodes", "probes"))):
        used, inverse = np.unique(np.frombuffer(docs, np.int64), return_inverse=True)
        got = [known.get(d, (d, None)) for d in used.tolist()]
        comps = np.array([g[0] if g[0] is not None else d for g, d in zip(got, used.tolist())], np.int64)[inverse]
        homes = np.array([g[1] if g[1] is not None else -1 for g in got], np.int64)[inverse]
        out.append((bucket, hashes, docs, probes, comps.tobytes(), homes.tobytes()))
    names = ("bucket", "hashes", "nodes", "probes", "comps", "homes")
    return pa.table({n: pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i, n in enumerate(names)})


ACROSS = pa.schema([("home", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("count", pa.binary()), ("names", pa.binary()), ("comps", pa.binary()), ("group", pa.int64())])
ACROSS_SQL = "home bigint, left binary, right binary, count binary, names binary, comps binary, group bigint"
NAMES_A_ROW = 1 << 16


def _across(homes: int, most: int):
    def run(sent: pa.Table) -> pa.Table:
        """All pairs of a probe and another member of its signature group in a different class, packed by the home of the one with the smaller number.

        Groups are taken by their number of such pairs, up to ``most`` in all; the members of the others are handed on instead (home null, group set).
        """
        hashes, ids = _joined(sent, "hashes", np.uint64), _joined(sent, "nodes", np.int64)
        probes, comp_of, home_of = _joined(sent, "probes", bool), _joined(sent, "comps", np.int64), _joined(sent, "homes", np.int64)
        names, first, docs = np.unique(ids, return_index=True, return_inverse=True)
        comp_of, home_of = comp_of[first], home_of[first]
        home_of = np.where(home_of < 0, mix(names.astype(np.uint64)) % U64(homes), home_of.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((comp_of[docs], hashes))
        hashes, docs, probes = hashes[order], docs[order], probes[order]
        comps = comp_of[docs]
        edges = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True]))) if len(hashes) else np.zeros(1, np.int64)
        start, end = edges[:-1], edges[1:]
        live = np.flatnonzero((comps[start] != comps[end - 1]) & np.logical_or.reduceat(probes, start)) if len(start) else np.zeros(0, np.int64)
        # pairs of a group: each probe with the members that are not of its class
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (comps[1:] != comps[:-1])
        same = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(hashes) else np.zeros(0, np.int64)
        others = np.where(probes, np.repeat(end - start, end - start) - same, 0)
        pairs = np.add.reduceat(others, start)[live] if len(live) else np.zeros(0, np.int64)
        live = live[np.argsort(pairs, kind="stable")]
        few = int(np.searchsorted(np.cumsum(np.sort(pairs)), most, "right"))
        fresh = [np.zeros(0, np.int64)]
        for g in live[:few].tolist():
            s, e = start[g], end[g]
            own = docs[s:e]
            for p in (s + np.flatnonzero(probes[s:e])).tolist():
                other = own[comps[s:e] != comps[p]]
                fresh.append(np.minimum(other, docs[p]) * len(names) + np.maximum(other, docs[p]))
        found, out = np.unique(np.concatenate(fresh)), []
        for g in live[few:].tolist():
            group = int(hashes[start[g]].astype(np.int64))
            for at in range(start[g], end[g], NAMES_A_ROW):
                out.append((None, None, None, None, names[docs[at : min(end[g], at + NAMES_A_ROW)]].tobytes(), None, group))
        left, right = found // max(1, len(names)), found % max(1, len(names))
        at = home_of[left]
        for home in np.unique(at).tolist():
            own = at == home
            a, b = left[own], right[own]
            used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            kind = np.uint16 if len(used) < 1 << 16 else np.uint32
            heads, count = np.unique(place[: len(a)], return_counts=True)
            out.append((home, heads.astype(np.uint32).tobytes(), place[len(a) :].astype(kind).tobytes(), count.astype(np.uint32).tobytes(), names[used].tobytes(), comp_of[used].tobytes(), None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(ACROSS)], schema=ACROSS)

    return run


def _needed(sent: pa.Table) -> pa.Table:
    names = np.unique(_joined(sent, "names", np.int64)) if sent.num_rows else np.zeros(0, np.int64)
    return pa.table({"home": pa.array(np.full(len(names), sent["home"][0].as_py() if len(names) else 0), pa.int64()), "node": pa.array(names, pa.int64())})


def _verify_home(sent: pa.Table, sets: pa.Table) -> pa.Table:
    """Pairs of classes that links among the pairs of a home join; a pair that earlier links have joined is left out."""
    known = {d: np.frombuffer(x, np.uint64) for d, x in zip(sets["node"].to_pylist(), sets["hashes"].to_pylist())}
    partners: dict[int, list[np.ndarray]] = {}
    parent: dict[int, int] = {}
    comp: dict[int, int] = {}
    for left, right, count, names, comps in zip(*(sent[c].to_pylist() for c in ("left", "right", "count", "names", "comps"))):
        names = np.frombuffer(names, np.int64)
        comp.update(zip(names.tolist(), np.frombuffer(comps, np.int64).tolist()))
        place = np.frombuffer(right, np.uint16 if len(names) < 1 << 16 else np.uint32)
        cuts = np.cumsum(np.frombuffer(count, np.uint32))[:-1]
        for a, b in zip(names[np.frombuffer(left, np.uint32)].tolist(), np.split(names[place], cuts)):
            partners.setdefault(a, []).append(b)

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a in sorted(partners):
        x, root = known.get(a), find(comp[a])
        others = [b for b in np.unique(np.concatenate(partners[a])).tolist() if b in known and find(comp[b]) != root]
        if x is None or not others:
            continue
        sizes = np.fromiter((len(known[b]) for b in others), np.int64, len(others))
        fits = np.minimum(sizes, len(x)) * PER_UNION >= PER_SHARED * np.maximum(sizes, len(x))
        others, sizes = [b for b, f in zip(others, fits) if f], sizes[fits]
        for at in range(0, len(others), 256):
            own, n = others[at : at + 256], sizes[at : at + 256]
            flat = np.concatenate([known[b] for b in own])
            near = np.minimum(np.searchsorted(x, flat), len(x) - 1)
            shared = np.add.reduceat((x[near] == flat).astype(np.int64), np.cumsum(n) - n)
            for b, hit in zip(own, PER_UNION * shared >= PER_SHARED * (n + len(x) - shared)):
                if hit:
                    out.append((comp[a], comp[b]))
                    parent[find(comp[b])] = find(comp[a])
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) * PER_UNION < PER_SHARED * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return PER_UNION * shared >= PER_SHARED * (len(both) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, PAIRS_SQL)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group, names in zip(batch.column("group").to_pylist(), batch.column("names").to_pylist()):
            nodes = np.frombuffer(names, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), group)), pa.array(nodes)], names=["group", "node"])


def parity_bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of 64-bit words for each set: bit h(x) mod ``bits`` of its shingles, added modulo 2. Rows differ in at most as many bits as the sets do in shingles."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = (mix(np.concatenate([*sets, np.zeros(0, np.uint64)]) + _PLACE[4]) & U64(bits - 1)).astype(np.int64)
    np.bitwise_xor.at(out, (owner, at >> 6), U64(1) << (at & 63).astype(np.uint64))
    return out


def _verify_parts(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of classes that links between two parts of a cluster (or inside one) join; a pair that earlier links have joined is left out."""
    _, band, _, x, y = (k.as_py() for k in key)
    comps = rows["comp"].to_numpy()
    root = comps.copy()
    left = np.flatnonzero((rows["band"].to_numpy() == band) & (rows["part"].to_numpy() == x))
    inside = key[2].as_py() == 0 and x == y
    right = left if inside else np.setdiff1d(np.arange(len(root)), left)
    found = []
    if len(left) and len(right) and (root != root[0]).any():
        sets = [np.frombuffer(b, np.uint64) for b in rows["hashes"].to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        bits = 64
        while bits < min(2 * int(sizes.max()), BITMAP_BITS):
            bits *= 2
        maps = parity_bitmaps(sets, bits)
        for n, a in enumerate(left.tolist()):
            other = right[n + 1 :] if inside else right
            other = other[root[other] != root[a]]
            other = other[np.minimum(sizes[other], sizes[a]) * PER_UNION >= PER_SHARED * np.maximum(sizes[other], sizes[a])]
            differ = np.bitwise_count(maps[other] ^ maps[a]).sum(1, dtype=np.int64)
            for b in other[differ <= most_different(sizes[other], sizes[a])].tolist():
                if root[b] != root[a] and _linked(sets[a], sets[b]):
                    found.append((comps[a], comps[b]))
                    root[root == root[b]] = root[a]
    return pa.table({c: pa.array([f[i] for f in found], pa.int64()) for i, c in enumerate(("a", "b"))})


def _cluster_links(hot: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes that links of the members of large signature groups join: clusters are cut by size band and into parts, and parts of one band or of neighbouring ones are compared."""
    members = cut(hot.mapInArrow(_members, "group bigint, node bigint").distinct())
    star = members.join(members.groupBy("group").agg(F.min("node").alias("a")), "group").select("a", F.col("node").alias("b")).distinct()
    clusters = components(star).withColumnRenamed("comp", "cluster")
    size = F.octet_length("hashes") / 8
    rows = clusters.join(sets.select("node", "hashes"), "node").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    highest = int(rows.agg(F.coalesce(F.max(size), F.lit(1.0))).first()[0])
    highs = F.array(*[F.lit(h) for _, h in band_edges(highest)])
    rows = cut(rows.withColumn("band", F.size(F.filter(highs, lambda h: h < size))))
    parts = rows.groupBy("cluster", "band").agg(F.ceil(F.sum(F.octet_length("hashes")) / PART_BYTES).cast("int").alias("parts"))
    near = [parts.select("cluster", (F.col("band") - by).alias("band"), F.col("parts").alias(name)) for by, name in ((0, "own"), (1, "above"), (-1, "below"))]
    for table_ in near:
        rows = rows.join(table_, ["cluster", "band"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))

    def with_each(count: str, make) -> Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array())

    def pair(band, above, x, y):
        return F.struct(band.alias("low"), F.lit(above).alias("above"), x.cast("int").alias("x"), y.cast("int").alias("y"))

    part, band = F.col("part"), F.col("band")
    places = F.concat(
        with_each("own", lambda j: pair(band, 0, F.least(part, j), F.greatest(part, j))),
        with_each("above", lambda j: pair(band, 1, part, j)), with_each("below", lambda j: pair(band - 1, 1, j, part)))
    dealt_ = rows.select("cluster", "node", "comp", "hashes", "band", "part", F.explode(places).alias("to")).select("*", "to.low", "to.above", "to.x", "to.y").drop("to")
    return dealt_.groupBy("cluster", "low", "above", "x", "y").applyInArrow(_verify_parts, PAIRS_SQL)


def _compare_with(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets = given.value
        # a linked set holds one of any n - ceil(0.75 n) + 1 shingles
        prefix = [x[: len(x) - -(-PER_SHARED * len(x) // PER_UNION) + 1] for x in sets]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in prefix])
        every = np.concatenate(prefix)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for batch in slices(batches):
            found = []
            for items in shingle_sets(batch.column("body").to_pylist()):
                low, high = np.searchsorted(every, items), np.searchsorted(every, items, "right")
                hit = np.flatnonzero(high > low)
                if len(hit):
                    own = set().union(*(owner[s:e].tolist() for s, e in zip(low[hit].tolist(), high[hit].tolist())))
                    found += [(nodes[i], set_key(items)) for i in sorted(own) if _linked(sets[i], items)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["a", "key"])

    return run


def _short_links(blocks: DataFrame, sets: DataFrame, stand: DataFrame) -> DataFrame | None:
    """Links of the sets that are short of segments, compared with all texts."""
    short = sets.where("short").select("node", "hashes")
    total = short.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0]
    rounds, links = -(-total // SHORT_BYTES), None
    for r in range(rounds):
        rows = short.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == r).toArrow()  # about SHORT_BYTES
        if rows.num_rows:
            given = blocks.sparkSession.sparkContext.broadcast((rows["node"].to_pylist(), [np.frombuffer(b, np.uint64) for b in rows["hashes"].to_pylist()]))
            found = blocks.where("doc_id is not null").select("body").mapInArrow(_compare_with(given), "a bigint, key binary").distinct()
            found = cut(found.join(stand.select("key", F.col("node").alias("b")), "key").where("a <> b").select("a", "b"))
            links = found if links is None else links.unionByName(found)
    return links


def similar_classes(docs: DataFrame, segments: Callable[[int], int] = segments_of, most_pairs: int = PAIRS_A_BUCKET, sampled: int = SAMPLED) -> DataFrame:
    """doc_id, n_shingles, component_id. The parameters change the cost, not the result: segments of a band by its highest size, pairs that a bucket hands on, one in how many groups gets leaders."""
    blocks, buckets = dealt(docs)
    described = cut(blocks.mapInArrow(_describe, "doc_id bigint, n_shingles bigint, key binary, block int"))
    stand = described.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "block")).alias("s"))
    stand = cut(stand.select("key", F.col("s.doc_id").alias("doc_id"), F.col("s.block").alias("block"), F.monotonically_increasing_id().alias("node")))
    answer = blocks.groupBy("block").cogroup(stand.groupBy("block")).applyInArrow(_send(buckets, segments), SENT_SQL).groupBy("bucket").applyInArrow(compare, ANSWER_SQL)
    heard = stand.unionByName(answer, allowMissingColumns=True)
    sent = cut(blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(_probe(buckets, segments), ROWS_SQL))
    groups, sets = sent.where("bucket is not null"), sent.where("bucket is null")
    stars = cut(groups.groupBy("bucket").applyInArrow(_leaders(sampled), PAIRS_SQL).distinct())
    links = cut(_links(stars, sets))
    if (more := _short_links(blocks, sets, stand)) is not None:
        links = links.unionByName(more)
    classes = components(links)
    # near copies mostly share a leader, so a leader's members are verified in one place; large groups are spread over several
    size = stars.groupBy("a").agg(F.count("*").alias("_n"))
    best = stars.groupBy("b").agg(F.min(F.struct(F.xxhash64("a").alias("_rank"), "a")).alias("_s")).select(F.col("b").alias("node"), F.col("_s.a").alias("a"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / HOME_DOCS))
    homes = best.join(size, "a").select("node", F.pmod(F.xxhash64("a", salt), F.lit(buckets * HOMES)).alias("home"))
    at = stand.join(classes, "node", "left").join(homes, "node", "left").where("comp is not null or home is not null").select("node", "block", "comp", "home")
    marked = groups.groupBy("block").cogroup(at.groupBy("block")).applyInArrow(_with_classes, MARKED_SQL)
    rest = cut(marked.groupBy("bucket").applyInArrow(_across(buckets * HOMES, most_pairs), ACROSS_SQL))
    pairs, hot = rest.where("home is not null"), rest.where("home is null")
    need = pairs.groupBy("home").applyInArrow(_needed, "home bigint, node bigint").join(sets.select("node", "hashes"), "node")
    joined = cut(pairs.groupBy("home").cogroup(need.groupBy("home")).applyInArrow(_verify_home, PAIRS_SQL))
    if hot.limit(1).count():
        joined = joined.unionByName(cut(_cluster_links(hot, sets, classes)))
    # classes are joined to larger ones; a set without links so far is its own class
    larger = components(joined).select(F.col("node").alias("_from"), F.col("comp").alias("_to"))
    whole = stand.join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = whole.join(larger, F.col("comp") == F.col("_from"), "left").select("key", "doc_id", F.coalesce("_to", "comp").alias("comp"))
    # the smallest doc_id of each class
    least = whole.groupBy(F.col("comp").alias("_class")).agg(F.min("doc_id").alias("_comp"))
    whole = whole.join(least, F.col("comp") == F.col("_class")).select(F.col("key").alias("_key"), "_comp")
    rows = described.join(whole, described["key"] == whole["_key"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))
