"""Token counts with overlap resynchronisation.

Documents of at most ``STEP`` + ``OVERLAP`` bytes are counted where they lie. Longer ones are cut into overlapping chunks, which are dealt over
all tasks as rows of their own (a text that repeats is cut once), encoded with offsets by the library, and spliced from small rows:

* A boundary is where a pre-token starts. What follows it depends on the text behind it alone, and what precedes it was read in full if it lies
  ``margin`` characters before the chunk's end (the longest added token or contraction has then ended). So a boundary of the left chunk there is one of
  the whole text, given that the left chunk itself was entered at one; and where the right chunk has a boundary at the same character, both chunks
  agree with the whole text from there on. The first such character is the seam, and tokens are counted from seam to seam.
* An overlap without a common boundary (one very long word) proves nothing: its text is cut anew with overlaps eight times as wide, until
  every seam is found or the text is a single chunk.

The proof needs a byte-level model with the usual pattern, without normaliser, prefix space or stripping added tokens; this is checked when the
model is loaded, and other models (.model: sentencepiece) encode every text whole. Texts that are counted where they lie are split at single spaces between
other characters, which are boundaries by the pattern, and a table keeps the counts of the parts; it is emptied at ``TABLE_WORDS`` words, without effect on results.

Defined results: null or empty text has no bytes and no tokens; strings of special tokens inside a text count as the library's default has it (one
token); rows are independent, so repeated rows and ids, null ids and clashing extra columns have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table

MODEL = "byte_bpe_50k.json"
LIMIT = 512
#: Characters from one chunk's start to the next, and characters that both share.
STEP = 16384
OVERLAP = 512
WIDER = 8
TABLE_WORDS = 400_000
ROWS = 200
#: Copies of one long text share a key; the rows of a key are dealt over so many parts.
SALTS = 32

_SPACE = re.compile(r"(?<=\S)(?= \S)")
_MODELS: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer file; ``margin`` is None if chunks of its texts cannot be proved stable."""

    def __init__(self, path: str) -> None:
        self.counts: dict[str, int] = {}
        self.margin = None
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._whole = lambda texts: [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        cuts, added = given.get("pre_tokenizer") or {}, given["added_tokens"]
        plain = not given.get("normalizer") and not given.get("post_processor") and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
        if plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"] for a in added) and self.library.encode(" a b").offsets == [(0, 2), (2, 4)]:
            self.margin = max([3, *(len(a["content"]) for a in added)]) + 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.margin is None:
            return self._whole(texts)
        parts = [_SPACE.split(x) for x in texts]
        if len(self.counts) > TABLE_WORDS:
            self.counts.clear()
        new = list(set(chain.from_iterable(parts)).difference(self.counts))
        self.counts.update(zip(new, self._whole(new)))
        known = self.counts.__getitem__
        return [sum(map(known, own)) for own in parts]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Characters where a pre-token starts, tokens before each of them, and tokens in all."""
        got = self.library.encode(text, add_special_tokens=False)
        words = np.array(got.word_ids, np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        return np.array([got.offsets[0][0], *_starts(got.offsets, first[1:])], np.int32) if len(first) else first.astype(np.int32), first.astype(np.int32), len(words)


def _starts(offsets: list[tuple[int, int]], at: np.ndarray) -> list[int]:
    return [offsets[i][0] for i in at.tolist()]


def encoder(path: str) -> Encoder:
    if path not in _MODELS:
        _MODELS[path] = Encoder(path)
    return _MODELS[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, ROWS):
            counts = own.count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, text = batch.column("key")[0].as_py(), batch.column("text")[0].as_py()
            chunks = max(1, -(-(len(text) - overlap) // step))
            for k in range(0, chunks, ROWS):
                own = range(k, min(chunks, k + ROWS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(own)), pa.array(own, pa.int32()), pa.array([chunks] * len(own), pa.int32()), pa.array([text[i * step : (i + 1) * step + overlap] for i in own])],
                    names=["key", "k", "chunks", "part"])

    return run


ENCODED = "key string, k int, chunks int, n int, head_at array<int>, head_n array<int>, tail_at array<int>, tail_n array<int>"


def _encode(path: str, step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in slices(batches, 64):
            out = []
            for k, chunks, part in zip(batch.column("k").to_pylist(), batch.column("chunks").to_pylist(), batch.column("part").to_pylist()):
                if chunks == 1:
                    out.append((own.count([part])[0], [], [], [], []))
                    continue
                at, before, n = own.boundaries(part)
                head, tail = (at <= overlap - own.margin) & (k > 0), (at >= step) & (at <= step + overlap - own.margin) & (k < chunks - 1)
                out.append((n, at[head], before[head], at[tail] - step, before[tail]))
            arrays = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "k", "chunks")), pa.array([x[0] for x in out], pa.int32()), *arrays], names=["key", "k", "chunks", "n", "head_at", "head_n", "tail_at", "tail_n"])

    return run


def spliced(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """key, n_tokens of each distinct text (key, text); n_tokens is null where some overlap has no common boundary."""
    parts = texts.mapInArrow(_cut(step, overlap), "key string, k int, chunks int, part string")
    parts = parts.groupBy("key", "k").agg(F.first("chunks").alias("chunks"), F.first("part").alias("part"))  # equal keys are equal texts
    rows = parts.mapInArrow(_encode(path, step, overlap), ENCODED)
    order = W.partitionBy("key").orderBy("k")
    rows = rows.withColumn("seam", F.get(F.array_intersect("tail_at", F.lead("head_at").over(order)), 0)).withColumn("entry", F.lag("seam").over(order))
    left = F.when(F.col("k") == F.col("chunks") - 1, F.col("n")).otherwise(F.get("tail_n", F.array_position("tail_at", F.col("seam")).cast("int") - 1))
    skipped = F.when(F.col("k") == 0, 0).otherwise(F.get("head_n", F.array_position("head_at", F.col("entry")).cast("int") - 1))
    own = (left - skipped).cast("long")
    return rows.groupBy("key").agg(F.when(F.count(own) == F.count("*"), F.sum(own)).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens. ``path``: a tokenizer file (.json or .model) on the driver and every executor."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    margin = encoder(path).margin
    if margin is None:
        return docs.mapInArrow(_count(path), counted)
    if not margin < overlap <= step:
        raise ValueError(f"overlaps must be longer than {margin} characters and no longer than a step")
    huge = F.col("n_bytes") > step + overlap
    long = docs.where(huge).withColumn("key", F.sha2("text", 256))
    left, done = long.select("key", "text"), None
    while True:
        counts = cut(spliced(left, path, step, overlap))
        done = counts if done is None else done.unionByName(counts)
        failed = counts.where("n_tokens is null").select("key")
        if failed.isEmpty():
            break
        left, overlap = left.join(failed, "key", "left_semi"), overlap * WIDER
        step = max(step, 4 * overlap)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = done.where("n_tokens is not null").withColumn("salt", salts)
    long = long.select("doc_id", "n_bytes", "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return docs.where(~huge).mapInArrow(_count(path), counted).unionByName(long.join(found, ["key", "salt"]).select("doc_id", "n_bytes", "n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
