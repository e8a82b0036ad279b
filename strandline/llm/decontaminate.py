"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all benchmark items.

Text and items are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A window is ``n``
consecutive words of an item (all its words if it has fewer, none if it has none). The automaton's patterns are the
windows, each word a code of three characters of which only the first is above 127, so that matches start at words; a document is coded the same way
(words of no item are one code that no pattern has) and scanned once, marking hits as they are found. Only documents
with hits pay for mapping word numbers to character offsets in the original text.

Texts of items are broadcast and every Python worker builds the automaton, some 220 bytes of memory a byte of item text. Beyond
``AUTOMATON_BYTES`` of text the benchmark is cut into blocks of items, one automaton and one pass each, so memory has a bound.

Defined results: null or empty text has no words and no hits; repeated documents are judged row by row; items with a
null id or null text are no items; items of the same id count once; an empty benchmark leaves every document clean;
other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, cut, table, word_table

WINDOW_WORDS = 10
AUTOMATON_BYTES = 2 << 20
_WORDS = word_table()
NO_WORD = "\0\0\0"
_BUILT: dict = {}

SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(_WORDS).split())


class Machine:
    """Automaton over the windows of some items. ``any``: whether there are windows."""

    def __init__(self, items: list[tuple[str, bytes]], n: int) -> None:
        self.code: dict[bytes, str] = {}
        found: dict[str, set[str]] = {}
        for item, text in items:
            words = [self._coded(w) for w in normalise(text).split()]
            for i in range(max(1, len(words) - n + 1) if words else 0):
                found.setdefault("".join(words[i : i + n]), set()).add(item)
        self.any = bool(found)
        self.machine = ahocorasick.Automaton()
        for pattern, own in found.items():
            self.machine.add_word(pattern, (len(pattern) // 3, sorted(own)))
        if found:
            self.machine.make_automaton()

    def _coded(self, word: bytes) -> str:
        if word not in self.code:
            i = len(self.code)
            if i >= 1 << 21:
                raise ValueError("too many distinct words for one automaton: lower block_bytes")
            self.code[word] = chr(128 + (i >> 14)) + chr(i >> 7 & 127) + chr(i & 127)
        return self.code[word]

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """Which words are hit, and the items found; None if there are none."""
        if not self.any:
            return None
        code, mark, found = self.code.get, None, set()
        for end, (size, items) in self.machine.iter("".join([code(w, NO_WORD) for w in words])):
            if mark is None:
                mark = np.zeros(len(words) + 1, np.int64)
            last = end // 3
            mark[last - size + 1] += 1
            mark[last + 1] -= 1
            found.update(items)
        return None if mark is None else (np.cumsum(mark[:-1]) > 0, found)


def _automaton(given: Broadcast) -> Machine:
    value = given.value  # one object in a worker for as long as it lives
    if _BUILT.get("of") is not value:
        _BUILT.update(of=value, machine=Machine(*value))
    return _BUILT["machine"]


def scan(text: bytes, machine: Machine) -> tuple[int, int, set[str], list[dict]]:
    """Number of words, of hit words, items found, and maximal hit spans as character offsets in the text."""
    flat = text.translate(_WORDS)
    words = flat.split()
    found = machine.hits(words) if words else None
    if found is None:
        return len(words), 0, set(), []
    hit, items = found
    raw = np.frombuffer(flat, np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], raw.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    # offsets in characters: bytes that do not continue a character
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    spans = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in zip(starts[np.flatnonzero(run == 1)], ends[np.flatnonzero(run == -1) - 1])]
    return len(words), int(hit.sum()), items, spans


def _scan_batches(given: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(given)
        for batch in slices(batches):
            out = [scan(t, machine) for t in as_bytes(batch.column("text"))]
            columns = [batch.column("doc_id"), [x[0] for x in out], [x[1] for x in out], [sorted(x[2]) for x in out], [x[3] for x in out]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items with windows in the text), spans (character offsets of the maximal hit runs).

    A benchmark is small by nature, but its size is checked: beyond ``block_bytes`` of text the hits of several passes are merged.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    blocks = _blocks(items, block_bytes)
    if blocks == 1:
        given = spark.sparkContext.broadcast(_block(items, n, 0, 1))
        return docs.mapInArrow(_scan_batches(given), SCHEMA)
    return _in_blocks(docs, items, n, blocks)


def _clean(given: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(given)
        for batch in slices(batches):
            batch = batch.filter(pa.array([machine.hits(t.translate(_WORDS).split()) is None for t in as_bytes(batch.column("text"))], pa.bool_()))
            yield batch

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without any window of the benchmark; no row is shuffled. One pass for each block of items, with what is left written
    between passes, so that no task has two automata at a time."""
    spark = docs.sparkSession
    items = _items(benchmark)
    blocks = _blocks(items, block_bytes)
    for b in range(blocks):
        given = spark.sparkContext.broadcast(_block(items, n, b, blocks))
        docs = docs.mapInArrow(_clean(given), docs.schema)
        if b < blocks - 1:
            docs = cut(docs)
    return docs


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _blocks(items: DataFrame, block_bytes: int) -> int:
    return max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes))


def _block(items: DataFrame, n: int, b: int, blocks: int) -> tuple[list[tuple[str, bytes]], int]:
    own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
    return [(r.item_id, r.text.encode()) for r in own.collect()], n  # about block_bytes


def _in_blocks(docs: DataFrame, items: DataFrame, n: int, blocks: int) -> DataFrame:
    spark = docs.sparkSession
    rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    parts = None
    for b in range(blocks):
        given = spark.sparkContext.broadcast(_block(items, n, b, blocks))
        part = cut(rows.select(F.col("row").alias("doc_id"), "text").mapInArrow(_scan_batches(given), SCHEMA))
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = rows.join(merged, "row")
    return joined.mapInArrow(_count_hits, SCHEMA)


def _joined(spans: list[dict]) -> list[dict]:
    """Spans in order of start: those that overlap or touch as one."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the spans of all blocks, and count hit words again."""
    for batch in slices(batches):
        hits, spans = [], [_joined(own) for own in batch.column("spans").to_pylist()]
        for text, own in zip(batch.column("text").to_pylist(), spans):
            hits.append(sum(len((text or "")[s["start"] : s["end"]].encode().translate(_WORDS).split()) for s in own))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items").cast(_ARROW.field("items").type), pa.array(spans, _ARROW.field("spans").type)], schema=_ARROW)


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
