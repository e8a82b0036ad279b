"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker after another character (checked when the model is loaded), so
merges never cross the place where a run of markers starts. A text is cut there; each distinct marked chunk is
segmented once per task by the library, and ids, counts and surfaces are joined back by position. The table is emptied
when it reaches ``TABLE_CHUNKS`` chunks, which bounds memory without changing results.

Defined results: null or empty text has no ids and decodes to ''; rows are independent, so repeated rows and clashing
extra columns have no effect; a literal U+2581 is the marker itself and decodes to a space, as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

MODEL = "piece_bpe_32k.model"
TABLE_CHUNKS = 400_000
PIECE_ROWS = 500
MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +")
_TABLES: dict[str, ChunkTable] = {}
SCHEMA = "doc_id bigint, ids array<int>, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class ChunkTable:
    """Chunk (at least one space, then no space) -> its ids as packed 32-bit integers."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.library.encode(" a") == self.library.encode("a") or self.library.encode("a")[0] == self.library.piece_to_id("a"):
            raise ValueError("the model must keep extra spaces and add a marker before the text")
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # surfaces of the chunks that decode to something else than themselves

    def learn(self, new: list[str]) -> None:
        """Segment new chunks. The library puts a marker before what it encodes: that is the chunk's first space."""
        got = self.library.encode([x[1:] for x in new], num_threads=1)
        for x, ids, back in zip(new, got, self.library.decode(got, num_threads=1) if new else []):
            if len(x) == 1:
                ids = [self.library.piece_to_id(MARK)]
            self.ids[x] = np.array(ids, np.int32).tobytes()
            if back != x[1:]:
                self.odd[x] = " " + back

    def segment(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids and the decoded text of each text."""
        chunks = [_CHUNK.findall(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids.clear()
            self.odd.clear()
        self.learn(list(set().union(*chunks).difference(self.ids)))
        packed = [b"".join(map(self.ids.__getitem__, own)) for own in chunks]
        if self.odd:
            return packed, ["".join([self.odd.get(x, x) for x in own])[1:] for own in chunks]
        return packed, ["".join(own)[1:] for own in chunks]


def _chunk_table(path: str) -> ChunkTable:
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _chunk_table(path)
        for batch in slices(batches, PIECE_ROWS):
            packed, decoded = own.segment(pc.fill_null(batch.column("text"), "").to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(decoded, pa.string())], schema=_ARROW)

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (no begin or end ids), decoded (the ids decoded again). ``path``: a sentencepiece model on every executor."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
