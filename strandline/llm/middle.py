"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its own bytes and the sentinels. Cutting splits
descriptors, an arrangement permutes them, and hashes and outputs read them in order; no text is copied on the way. The inverse works on the
output in the same manner: its sentinels are found, the descriptors between them are put back by the inverse permutation.

Lengths of prefix, middle and suffix, the form and the arrangement follow from a hash of the document's id alone, so that a run that is repeated, or a task that is, gives
the same rows. A document that holds a sentinel stays plain, since its output could not be read back.

Defined results: null text is empty, and empty texts are plain with no units; white space only is one unit; a null id hashes as an empty string; rows are independent, so
repeated rows have equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, table

SEED = 42
FIM_RATE = 50
SPM_RATE = 80
SENTINELS = b"<P><S><M>"
SENTINEL_BYTES = 3
#: Pieces of a cut document by number: prefix, middle, suffix; each form's order, a sentinel before each piece.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARK_OF = {0: 0, 1: 2, 2: 1}  # piece -> its sentinel: prefix <P>, middle <M>, suffix <S>
ROWS = 500

TEXT, MARKS = 0, 1
Descriptor = tuple[int, int, int]  # buffer, start, length
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class PieceTable:
    """Descriptors over a text's bytes and the sentinels."""

    def __init__(self, text: bytes, pieces: list[Descriptor] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, offset: int) -> None:
        """Splits the descriptor that holds this offset of what the table spells; a cut at an end leaves an empty piece."""
        at = 0
        for i, (buffer, start, length) in enumerate(self.pieces):
            inside = offset - at
            if inside <= length:
                self.pieces[i : i + 1] = [(buffer, start, inside), (buffer, start + inside, length - inside)]
                return
            at += length

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        """The pieces in another order, each behind its sentinel."""
        pieces = []
        for i in order:
            pieces += [(MARKS, MARK_OF[i] * SENTINEL_BYTES, SENTINEL_BYTES), self.pieces[i]]
        return PieceTable(self.buffers[TEXT].obj, pieces)

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """The inverse of ``arranged``: sentinels go, pieces return to their places."""
        back = [0] * len(order)
        for place, i in enumerate(order):
            back[i] = place
        own = [p for p in self.pieces if p[0] == TEXT]
        return PieceTable(self.buffers[TEXT].obj, [own[place] for place in back])

    def spans(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        done = hashlib.sha256()
        for span in self.spans():
            done.update(span)
        return done.hexdigest()

    def to_bytes(self) -> bytes:
        return b"".join(self.spans())


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets where units end: a word with the white space before it, or white space at the end."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(text)) if text else ends


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def _chars(text: memoryview) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def transform(doc_id: int | None, text: bytes, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, PieceTable]:
    """Units, form, characters of prefix and middle (None if plain), and the arranged piece table."""
    ends = unit_ends(text)
    n, given = len(ends), draws(doc_id, seed)
    whole = PieceTable(text)
    if not text or any(text.find(SENTINELS[i : i + SENTINEL_BYTES]) >= 0 for i in range(0, len(SENTINELS), SENTINEL_BYTES)) or given[2] % 100 >= fim_rate:
        return n, "plain", None, None, whole
    first, second = (0 if not u else int(ends[u - 1]) for u in sorted((given[0] % (n + 1), given[1] % (n + 1))))
    whole.cut(first)
    whole.cut(second)
    form = "spm" if given[3] % 100 < spm_rate else "psm"
    prefix, middle, _ = whole.spans()
    return n, form, _chars(prefix), _chars(middle), whole.arranged(ORDER[form])


def restore(output: bytes, form: str) -> PieceTable:
    """The document's text out of an output and its form, as descriptors over the output."""
    if form == "plain":
        return PieceTable(output)
    order, pieces, at = ORDER[form], [], 0
    marks = [SENTINELS[MARK_OF[i] * SENTINEL_BYTES :][:SENTINEL_BYTES] for i in order]
    starts = []
    for mark in marks:
        found = output.find(mark, at)
        if found < 0 or not starts and found:
            raise ValueError("not an output of this form")
        starts.append(found)
        at = found + SENTINEL_BYTES
    for start, end in zip(starts, [*starts[1:], len(output)]):
        pieces.append((TEXT, start + SENTINEL_BYTES, end - start - SENTINEL_BYTES))
    return PieceTable(output, pieces).restored(order)


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())])


def _transform(seed: int, fim_rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *transform(i, text, seed, fim_rate, spm_rate)) for i, text in zip(ids, as_bytes(batch.column("text")))]
            out = [(*r[:5], r[5].to_bytes(), r[5].sha256()) for r in rows]
            columns = [pa.array([r[c] for r in out], pa.binary() if f.name == "output" else f.type) for c, f in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256; rates in percent."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_transform(seed, fim_rate, spm_rate), SCHEMA)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, ROWS):
        tables = [restore(out, form) for out, form in zip(as_bytes(batch.column("output")), batch.column("form").to_pylist())]
        added = [pa.array([t.to_bytes() for t in tables], pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "restored", "restored_sha256"])


def restore_texts(outputs: DataFrame) -> DataFrame:
    """The rows of ``outputs`` (any columns beside output and form) with restored and restored_sha256: the text rebuilt from output and form alone."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(_restore, f"{fields}, restored string, restored_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return restore_texts(fill_in_middle(table(spark, sf_dir, "documents"))).drop("output", "restored")


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (
  select doc_id, text, units, len(units)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
v as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
w as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from v)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from w
"""
