"""Dealing texts into blocks, and comparing hashes between blocks in packed form.

Row-per-hash shuffles of every position of a corpus cost several times its size. Here a block of texts keeps its hashes in
arrays (blocks grow with the square root of the corpus, so that the number of rows sent stays in proportion to it): each block sends every bucket (a digit of the hash) one row with its sorted distinct values, the bucket
compares the blocks' arrays in numpy, and answers each block with one small row. The hashes of hot texts
are thereby pre-aggregated to one value for each block before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least bytes of a block, and bytes of text for each row that a block sends to a bucket. With as many buckets as blocks that is
#: bytes / ROW_BYTES rows whatever the size of the corpus: blocks of 5 MB up to 17 GB, 40 MB at 1 TB, 400 MB at 100 TB.
BLOCK_BYTES = 5 << 20
ROW_BYTES = 1600
#: Copies of one text share blocks (so that they are compared once), but over no fewer than this share of all blocks.
SPREAD = 8

U64 = np.uint64


def dealt(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, body (UTF-8, null: empty), block; and the number of blocks. Blocks are dealt by text, salted by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))
    total, count = rows.agg(F.coalesce(F.sum(F.octet_length("body") + 16), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-total // max(block_bytes, int((total * ROW_BYTES) ** 0.5) if block_bytes == BLOCK_BYTES else 1)))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(-(-blocks // SPREAD)))
    return rows.withColumn("block", F.pmod(F.xxhash64("body", salt), F.lit(blocks)).cast("int")), blocks


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U64(40)) * U64(buckets) >> U64(24)).astype(np.int64)


#: The low bits of a hash are not sent: what is, is a first digit only. Equal digits of unequal hashes cost work later, never results.
UNSENT_BITS = U64(20)


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct values as 32-bit steps, or 64-bit ones if a step is larger."""
    steps = np.diff(values, prepend=U64(0))
    return (steps.astype(np.uint32) if not len(steps) or steps.max() < 1 << 32 else steps).tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.uint64).astype(np.uint64), dtype=np.uint64)


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("packed", pa.binary()), ("several", pa.binary())])
SENT_SQL = "bucket int, block int, n int, packed binary, several binary"
ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("weights", pa.binary())])
ANSWER_SQL = "block int, bucket int, weights binary"


def to_buckets(hashes: np.ndarray, owners: np.ndarray, block: int, buckets: int) -> pa.Table:
    """One row for each bucket: the distinct hash digits of the block, and which of them have several owners in it."""
    order = np.argsort(hashes)  # buckets are ranges of hashes
    low, owners = hashes[order] >> UNSENT_BITS, owners[order]
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(low) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first) if len(first) else np.zeros(0, bool)
    at, low = bucket_of(hashes[order[first]], buckets), low[first]
    edges = np.searchsorted(at, np.arange(buckets + 1))
    rows = [(b, block, int(e - s), pack(low[s:e]), np.packbits(several[s:e]).tobytes()) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:])) if e > s]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SENT)], schema=SENT)


def compare(sent: pa.Table) -> pa.Table:
    """For one bucket: each block's answer is, for each of its values, 0 if it has one owner in all, else about 1 + 8 log2 of the number of blocks (owners in one block count as two)."""
    if not sent.num_rows:
        return ANSWER.empty_table()
    n = sent["n"].to_numpy()
    values = np.concatenate([unpack(b, k) for b, k in zip(sent["packed"].to_pylist(), n)])
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(sent["several"].to_pylist(), n)])
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    group = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
    owners = np.bincount(group, 1 + several[order])
    weight = np.empty(len(values), np.uint8)
    weight[order] = np.where(owners > 1, np.minimum(255, 1 + 8 * np.log2(np.maximum(owners, 1))), 0).astype(np.uint8)[group]
    edges = np.concatenate(([0], np.cumsum(n)))
    bucket, rows = int(sent["bucket"][0].as_py()), []
    for block, s, e in zip(sent["block"].to_pylist(), edges[:-1], edges[1:]):
        if weight[s:e].any():
            rows.append((block, bucket, weight[s:e].tobytes()))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ANSWER)], schema=ANSWER)


def weights_of(hashes: np.ndarray, answer: pa.Table, buckets: int) -> np.ndarray:
    """The answered weight of each hash of a block (in the order given)."""
    out = np.zeros(len(hashes), np.uint8)
    if not answer.num_rows or not len(hashes):
        return out
    order = np.argsort(hashes)
    low = hashes[order] >> UNSENT_BITS
    new = np.concatenate(([True], low[1:] != low[:-1]))
    rank = np.cumsum(new) - 1
    own = np.zeros(int(rank[-1]) + 1, np.uint8)
    place = np.searchsorted(bucket_of(hashes[order[new]], buckets), np.arange(buckets + 1))
    for bucket, blob in zip(answer["bucket"].to_pylist(), answer["weights"].to_pylist()):
        own[place[bucket] : place[bucket + 1]] = np.frombuffer(blob, np.uint8)
    out[order] = own[rank]
    return out


def shared(blocks: DataFrame, send: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers (block, bucket, weights) to what ``send`` makes of each block."""
    return blocks.groupBy("block").applyInArrow(send, SENT_SQL).groupBy("bucket").applyInArrow(compare, ANSWER_SQL)
