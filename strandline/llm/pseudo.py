"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token of a text is masked in turn and predicted from both sides: log P(word | two words on the left, two on the right). A document's
score is the sum over all its words. The vocabulary is every word of the corpus (a 63-bit hash, no cut). Three levels, each from all data:

1. The network predicts the word's class. Words fall into ``CLASSES`` classes: the most frequent hashed words one each, the others by hash, and 0
   for the text's ends. It embeds the class on the left and the class on the right, adds them in a tanh layer and gives a softmax over classes. It
   learns from the counts of all (left, word, right) triples of classes of the corpus, at most CLASSES**3 sums, full-batch in numpy.
2. P(word | class) is the word's share of all words of its class in the corpus.
3. Occurrences of the window elsewhere in the corpus. With n the number of other places with the same four neighbours, and k those of them
   that hold the same word, P = (k + STRENGTH * P(class) * P(word | class)) / (n + STRENGTH): a Dirichlet prior whose mean is the network. The
   masked occurrence itself is left out of n and k, so only text that occurs elsewhere gains.

Counts of words and windows grow with the corpus and stay distributed: blocks of texts send their distinct values to buckets in packed
form, which answer each block with the sums of what it asked for. A window or word that is hot is one value a block.

Windows are compared by 48 bits and words in them by 16 more; a collision changes a probability slightly.

Defined results: null or empty text, and text without words, have 0 words, sum 0 and null mean; a corpus without words
leaves a uniform network; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, table, word_table
from .exchange import U64, bucket_of, dealt, mix, pack, unpack

CLASSES = 128
FREQUENT = 63
BUCKETS = 1 << 16
HIDDEN = 24
STEPS = 120
RATE = 0.05
STRENGTH = 1.0
WORDS_KEPT = 400_000
PARTS = 64
_WORDS = word_table()
_SIDES = [U64(x) for x in np.random.default_rng(9).integers(1, 1 << 63, 5, dtype=np.uint64) * U64(2) + U64(1)]


class Words(dict):
    """Word -> 63-bit id; its low bits are the bucket."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = int.from_bytes(blake2b(word, digest_size=6).digest()) >> 1 << 16 | zlib.crc32(word) & (BUCKETS - 1)
        return code


_IDS = Words()


def ids_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and the number of words of each text."""
    if len(_IDS) > WORDS_KEPT:
        _IDS.clear()
    words = [t.translate(_WORDS).split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.fromiter((i for w in words for i in map(_IDS.__getitem__, w)), np.int64, int(lengths.sum())), lengths


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and the number of words of each text."""
    flat, lengths = ids_of(texts)
    return (flat & (BUCKETS - 1)).astype(np.int32), lengths


def class_table(frequent: list[int]) -> np.ndarray:
    """Class of each bucket: 1.. for the frequent ones in order, hash classes above."""
    out = (1 + FREQUENT + np.arange(BUCKETS) % (CLASSES - 1 - FREQUENT)).astype(np.uint8)
    out[frequent] = np.arange(1, len(frequent) + 1)
    return out


def _places(lengths: np.ndarray, side: int) -> tuple[np.ndarray, int]:
    """Where each word stands in a line that has ``side`` empty places before each text and at the end; and the line's length."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(text)) + side * (text + 1), int(lengths.sum()) + side * (len(lengths) + 1)


def triples(flat: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Code left * CLASSES**2 + right * CLASSES + word of every word."""
    at, size = _places(lengths, 1)
    line = np.zeros(size, np.int32)
    line[at] = classes[flat]
    return (line[at - 1] * CLASSES + line[at + 1]) * CLASSES + line[at]


def windows(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """48 bits of the two neighbours on each side of every word, and 16 of the word."""
    at, size = _places(lengths, 2)
    line = np.zeros(size, np.uint64)
    line[at] = mix(flat.astype(np.uint64) + U64(1))
    around = mix(line[at - 2] * _SIDES[0] + line[at - 1] * _SIDES[1] + line[at + 1] * _SIDES[2] + line[at + 2] * _SIDES[3])
    return (around & ~U64(0xFFFF)) | (line[at] & U64(0xFFFF))


def words_alone(flat: np.ndarray) -> np.ndarray:
    """Values that count a word itself, among those of windows."""
    return mix(flat.astype(np.uint64) * _SIDES[4] + U64(3)) & ~U64(0xFFFF)


# -- counts that the network learns from: partial arrays per task, summed by part

PARTIAL_SQL = "part int, sums binary"


def _partial(total: np.ndarray) -> pa.RecordBatch:
    parts = np.array_split(total, PARTS)
    used = [i for i, p in enumerate(parts) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], pa.binary())], names=["part", "sums"])


def _sum_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = None, None
    for batch in rows:
        for i, blob in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            own = np.frombuffer(zlib.decompress(blob), np.int64)
            part, total = i, own if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "sums"])


def _summed(texts: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all texts of an array of ``size`` counts: the driver gets PARTS rows."""
    sums = texts.mapInArrow(count, PARTIAL_SQL).groupBy("part").applyInArrow(_sum_parts, PARTIAL_SQL).toArrow()
    parts = np.array_split(np.zeros(size, np.int64), PARTS)
    for i, blob in zip(sums["part"].to_pylist(), sums["sums"].to_pylist()):
        parts[i] = np.frombuffer(zlib.decompress(blob), np.int64)
    return np.concatenate(parts)


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        total += np.bincount(buckets_of(as_bytes(batch.column("text")))[0], minlength=BUCKETS)
    yield _partial(total)


def _count_triples(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches):
            total += np.bincount(triples(*buckets_of(as_bytes(batch.column("text"))), given.value), minlength=CLASSES**3)
        yield _partial(total)

    return run


def train(counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, rate: float = RATE, seed: int = 3) -> dict[str, np.ndarray]:
    """counts: [left, right, word]. Full-batch Adam on the mean negative log-probability."""
    rng, n = np.random.default_rng(seed), CLASSES
    p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in (("left", (n, hidden)), ("right", (n, hidden)), ("out", (hidden, n)))}
    p["bias"] = np.log1p(counts.sum((0, 1))).astype(np.float32)
    p["bias"] -= p["bias"].max()
    p["at"] = np.zeros(hidden, np.float32)
    total = counts.sum()
    if not total:
        return {k: np.zeros_like(v) for k, v in p.items()}
    pair = np.flatnonzero(counts.sum(2).ravel())
    left, right = pair // n, pair % n
    c = counts.reshape(n * n, n)[pair].astype(np.float32) / np.float32(total)
    weight = c.sum(1, keepdims=True)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        h = np.tanh(p["left"][left] + p["right"][right] + p["at"])
        logit = h @ p["out"] + p["bias"]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit *= weight / logit.sum(1, keepdims=True)
        slope = logit - c
        back = (slope @ p["out"].T) * (1 - h * h)
        grads = {"out": h.T @ slope, "bias": slope.sum(0), "at": back.sum(0)}
        for k, index in (("left", left), ("right", right)):
            grads[k] = np.zeros_like(p[k])
            np.add.at(grads[k], index, back)
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-12)
    return p


def log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """[left * CLASSES + right, word], flat."""
    h = np.tanh(p["left"][:, None] + p["right"][None] + p["at"]).reshape(CLASSES * CLASSES, -1)
    logit = h @ p["out"] + p["bias"]
    logit -= logit.max(1, keepdims=True)
    return (logit - np.log(np.exp(logit).sum(1, keepdims=True))).ravel()


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Class of each bucket, log of the number of words of each class, and the trained network."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    n = _summed(texts, _count_buckets, BUCKETS)
    seen = np.flatnonzero(n)
    own = class_table(seen[np.lexsort((seen, -n[seen]))][:FREQUENT].tolist())
    totals = np.log(np.maximum(np.bincount(own, n, CLASSES), 1))
    counts = _summed(texts, _count_triples(docs.sparkSession.sparkContext.broadcast(own)), CLASSES**3)
    return own, totals, train(counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64))


# -- counts of words and windows: distinct values of blocks, summed by bucket

ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("around", pa.binary()), ("word", pa.binary()), ("times", pa.binary())])
ASKED_SQL = "bucket int, block int, n int, around binary, word binary, times binary"
TOLD = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("several", pa.binary()), ("same", pa.binary()), ("all", pa.binary())])
TOLD_SQL = "block int, bucket int, several binary, same binary, all binary"


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64).tobytes()


def _large(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16}.get(len(blob) // n if n else 1, np.int64)).astype(np.int64)


class Block:
    """Texts of a block in a fixed order (rows may arrive in another one each time, and what is sent is answered by position), and their distinct values."""

    def __init__(self, rows: pa.Table) -> None:
        ids, bodies = rows["doc_id"].to_pylist(), rows["body"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, bodies[i]))
        self.ids = [ids[i] for i in order]
        self.flat, self.lengths = ids_of([bodies[i] for i in order])
        both = np.concatenate((windows(self.flat, self.lengths), words_alone(self.flat)))
        self.values, self.place, self.times = np.unique(both, return_inverse=True, return_counts=True)

    def edges(self, buckets: int) -> np.ndarray:
        return np.searchsorted(bucket_of(self.values, buckets), np.arange(buckets + 1))


def _ask(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        own = Block(rows)
        block, edges, out = rows["block"][0].as_py(), own.edges(buckets), []
        for b, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if e > s:
                v = own.values[s:e]
                out.append((b, block, e - s, pack(v >> U64(16)), (v & U64(0xFFFF)).astype(np.uint16).tobytes(), _small(own.times[s:e])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(ASKED)], schema=ASKED)

    return run


def _tell(asked: pa.Table) -> pa.Table:
    """For each block's values: how often the value, and how often its window, occurs in all; sent only where the window occurs more than once."""
    n = asked["n"].to_pylist()
    around = np.concatenate([unpack(b, k) for b, k in zip(asked["around"].to_pylist(), n)])
    word = np.concatenate([np.frombuffer(b, np.uint16) for b in asked["word"].to_pylist()])
    times = np.concatenate([_large(b, k) for b, k in zip(asked["times"].to_pylist(), n)])
    value = (around << U64(16)) | word
    order = np.argsort(value, kind="stable")
    v, t = value[order], times[order]
    same, all_ = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for out, key in ((same, v), (all_, v >> U64(16))):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out[order] = np.repeat(np.add.reduceat(t, first), np.diff(np.append(first, len(v))))
    bucket, rows, s = asked["bucket"][0].as_py(), [], 0
    for block, k in zip(asked["block"].to_pylist(), n):
        several = all_[s : s + k] > 1
        if several.any():
            rows.append((block, bucket, np.packbits(several).tobytes(), _small(same[s : s + k][several]), _small(all_[s : s + k][several])))
        s += k
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(TOLD)], schema=TOLD)


SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("sum_logp", pa.float64())])


def _score(buckets: int, model):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return SCORES.empty_table()
        own, (classes, totals, params) = Block(rows), model.value
        same, all_ = np.ones(len(own.values), np.int64), np.ones(len(own.values), np.int64)
        edges = own.edges(buckets)
        for b, several, k, n in zip(*(told[c].to_pylist() for c in ("bucket", "several", "same", "all"))):
            at = edges[b] + np.flatnonzero(np.unpackbits(np.frombuffer(several, np.uint8), count=int(edges[b + 1] - edges[b])))
            same[at], all_[at] = _large(k, len(at)), _large(n, len(at))
        tokens = len(own.flat)
        window, word = own.place[:tokens], own.place[tokens:]
        bucket = (own.flat & (BUCKETS - 1)).astype(np.int32)
        prior = np.exp(_known(params)[triples(bucket, own.lengths, classes)] - totals[classes[bucket]]) * same[word]
        logp = np.log((same[window] - 1 + STRENGTH * prior) / (all_[window] - 1 + STRENGTH))
        total = np.bincount(np.repeat(np.arange(len(own.lengths)), own.lengths), logp, len(own.lengths))
        return pa.Table.from_arrays([pa.array(own.ids, pa.int64()), pa.array(own.lengths), pa.array(total, pa.float64())], schema=SCORES)

    return run


_TABLE: dict = {}


def _known(params: dict[str, np.ndarray]) -> np.ndarray:
    """The network as a table, made once in each worker (a broadcast value is one object there)."""
    if _TABLE.get("of") is not params:
        _TABLE.update(of=params, table=log_probabilities(params).astype(np.float64))
    return _TABLE["table"]


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sum_logp, mean_logp."""
    blocks, buckets = dealt(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    told = blocks.groupBy("block").applyInArrow(_ask(buckets), ASKED_SQL).groupBy("bucket").applyInArrow(_tell, TOLD_SQL)
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(buckets, model), "doc_id bigint, n_words bigint, sum_logp double")
    return scored.withColumn("mean_logp", F.when(F.col("n_words") > 0, F.col("sum_logp") / F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
