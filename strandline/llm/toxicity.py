"""Toxicity: a convolutional text classifier trained in numpy.

Words (lower-cased, cut at ASCII characters that are neither letters nor digits) are hashed into an embedding table; filters
of several widths slide over the whole text, max pooling keeps each filter's strongest response, and a linear layer
gives a logit. Since a filter is linear in its words, the product of the embedding table with each filter position is
computed once, so that scoring a text is table look-ups, sums and maxima. Words of fewer than ``LEAST_DOCS`` training texts, or of fewer
than one text in ``LEAST_SHARE``, have no embedding of their own and count as padding: a filter could otherwise learn texts by heart.

Thresholds are calibrated by language on rows kept out of the gradient steps. The language is guessed from the text's
own function words, never read from a column. The calibrated threshold of each language is shifted to ``THRESHOLD``, so that one
comparison holds for all. A language takes the threshold of all rows if it has few toxic rows, or if its rows do not show that the model
ranks them; only one whose rows show that the model cannot tell its labels apart gets a threshold above its calibration scores.
Nothing in this depends on how frequent toxic rows are. If all rows together show neither, the model's own probabilities stand.

Learning uses at most ``TRAIN_ROWS`` labelled rows of at most ``TRAIN_WORDS`` words together, in the order of the hash of their doc_id, among
the rows that are not held out (crc32(doc_id) mod 4 is 2) and have at most ``LONGEST`` words. Scores use all rows and whole texts.

Defined results: null and empty text get the score of a text without words; rows are scored one by one, so repeated rows
agree; labels that are null or of unknown documents are not learnt from; without a label of each class every score is 0;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, slices, table, word_table

THRESHOLD = 0.3
TRAIN_ROWS = 20000
TRAIN_WORDS = 16_000_000
LONGEST = 100_000
SLOTS = 1 << 17
LEAST_DOCS = 3
LEAST_SHARE = 750
STEPS = 1500
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 10
INIT = 0.05
EMBEDDING_RATE = 0.2
LEAST_CALIBRATION = 50
#: Toxic and clean calibration rows that a language needs for a threshold of its own; area under the ROC curve below which, for certain, there is nothing to find.
LEAST_OF_CLASS = 10
INSEPARABLE = 0.6
CHUNK_WORDS = 1 << 17
WORDS_KEPT = 400_000
_WORDS = word_table()

# Function words by which a text's language is guessed (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in that it with for is was on are as at be this from or by",
    "de": "der die und das ist ein eine den dem nicht mit auf zu von im sich des für als auch",
    "fr": "le la les de des et est un une du que qui dans pour pas sur avec par au ce",
    "es": "el la los las de y que en un una es por con para del se no su al lo",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


class Slots(dict):
    """Word -> table slot; slot 0 is padding."""

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = 1 + zlib.crc32(word) % (SLOTS - 1)
        return slot


_SLOTS = Slots()
_VOTES: dict[bytes, tuple[int, ...]] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words.split():
        _VOTES[_w.encode()] = (*_VOTES.get(_w.encode(), ()), _i)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def slots_of(words: list[bytes]) -> np.ndarray:
    if len(_SLOTS) > WORDS_KEPT:
        _SLOTS.clear()
    return np.fromiter(map(_SLOTS.__getitem__, words), np.int32, len(words))


_VOTE_TABLE = np.zeros((SLOTS, len(FUNCTION_WORDS)), np.int32)
for _w, _for in _VOTES.items():
    for _i in _for:
        _VOTE_TABLE[1 + zlib.crc32(_w) % (SLOTS - 1), _i] = 1
_VOTED = np.flatnonzero(_VOTE_TABLE.any(1))
_IS_VOTED = np.zeros(SLOTS, bool)
_IS_VOTED[_VOTED] = True


def language_of(slots: np.ndarray) -> int:
    """Index in LANGUAGES of the language whose function words are most frequent."""
    votes = _VOTE_TABLE[slots[_IS_VOTED[slots]]].sum(0)
    return int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)


def _pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by padding so that no filter reaches the next one; where each starts."""
    lengths = np.array([len(d) for d in docs]) + max(WIDTHS)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.zeros(int(lengths.sum()) + max(WIDTHS), np.int32)
    for at, d in zip(starts, docs):
        flat[at : at + len(d)] = d
    return flat, starts


class Model:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.index = np.zeros(SLOTS, np.int32)  # row of the embedding table for each slot, 0 for none
        self.embedding = np.zeros((1, DIM), np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.offset = np.zeros(len(LANGUAGES))

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ part for part in f] for f in self.filters]

    def pooled(self, flat: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Strongest response of each filter in each text, before the bias; and all responses."""
        n, tops, all_ = len(flat) - max(WIDTHS), [], []
        ends = np.append(starts[1:], n)
        for parts in tables:
            response = parts[0][flat[:n]]
            for j, part in enumerate(parts[1:], 1):
                response += part[flat[j : n + j]]
            for j in range(1, len(parts)):
                response[ends - j] = sum(p[0] for p in parts)  # padding alone, not the next text
            tops.append(np.maximum.reduceat(response, starts, axis=0))
            all_.append(response)
        return np.concatenate(tops, 1), all_

    def logits(self, docs: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        out, at = [], 0
        while at < len(docs):  # pieces of a bounded number of words, whole texts each
            to, words = at, 0
            while to < len(docs) and (to == at or words + len(docs[to]) <= CHUNK_WORDS):
                words += len(docs[to])
                to += 1
            flat, starts = _pad(docs[at:to])
            top, _ = self.pooled(self.index[flat], starts, tables)
            out.append(np.maximum(top + self.bias, 0) @ self.out + self.shift[0])
            at = to
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def scores(self, docs: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        logit = self.logits(docs, tables).astype(np.float64) + self.offset[[language_of(d) for d in docs]]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.005, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        texts = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=SLOTS)
        kept = np.flatnonzero(texts >= max(LEAST_DOCS, len(docs) // LEAST_SHARE))
        kept = kept[kept > 0]
        self.index[kept] = np.arange(1, len(kept) + 1)
        self.embedding = rng.normal(0, INIT, (len(kept) + 1, DIM)).astype(np.float32)
        self.embedding[0] = 0
        docs = [self.index[d] for d in docs]
        epochs = max(epochs, -(-STEPS * batch // len(docs)))
        held = [self.bias, self.out, self.shift, *self.filters]
        first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
        squares, step = np.full(len(self.embedding), 1e-3, np.float32), 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                flat, starts = _pad([docs[i] for i in own])
                used, dense = np.unique(flat, return_inverse=True)  # padding is row 0 of both
                rows = self.embedding[used]
                top, responses = self.pooled(dense, starts, [[rows @ part for part in f] for f in self.filters])
                hidden = np.maximum(top + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift[0], -30, 30)))
                slope = ((p - labels[own]) / len(own)).astype(np.float32)
                at_top = slope[:, None] * self.out * (hidden > 0)
                grads = [at_top.sum(0), hidden.T @ slope, slope.sum(keepdims=True)]
                ends = np.append(starts[1:], len(flat) - max(WIDTHS))
                moved: list[tuple[np.ndarray, np.ndarray]] = []
                for k, width in enumerate(WIDTHS):
                    g = at_top[:, k * FILTERS : (k + 1) * FILTERS]
                    place = np.stack([s + responses[k][s:e].argmax(0) for s, e in zip(starts, ends)])
                    grad = np.zeros_like(self.filters[k])
                    for j in range(width):
                        slots = np.where(place + j < ends[:, None], flat[place + j], 0)
                        grad[j] = np.einsum("nfd,nf->df", self.embedding[slots], g)
                        moved.append((slots.ravel(), (g[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM)))
                    grads.append(grad)
                step += 1
                for param, grad, a, b in zip(held, grads, first, second):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    param -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                slots, change = np.concatenate([m[0] for m in moved]), np.concatenate([m[1] for m in moved])
                used, inverse = np.unique(slots, return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, inverse, change)
                squares[used] += (total * total).sum(1)
                self.embedding[used] -= EMBEDDING_RATE * total / np.sqrt(squares[used])[:, None]
                self.embedding[0] = 0

    def calibrate(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """For each language the threshold of best F1, shifted to THRESHOLD. Languages of few rows, few toxic or few clean ones take that of all rows."""
        logit, language = self.logits(docs, self.tables()).astype(np.float64), np.array([language_of(d) for d in docs])
        self.offset[:] = _shift(logit, labels)
        for i in range(len(LANGUAGES)):
            own = language == i
            toxic = (labels[own] == 1).sum()
            if own.sum() >= LEAST_CALIBRATION and min(toxic, own.sum() - toxic) >= LEAST_OF_CLASS:
                self.offset[i] = _shift(logit[own], labels[own], self.offset[i])


def _shift(score: np.ndarray, y: np.ndarray, unsure: float = 0.0) -> float:
    """From the threshold of best F1 to THRESHOLD. Whether scores tell the labels apart is judged by ranks (area under the ROC curve), which do not depend on the share of toxic rows."""
    target = np.log(THRESHOLD / (1 - THRESHOLD))
    toxic = int((y == 1).sum())
    clean = len(y) - toxic
    if not toxic or not clean:
        return unsure
    _, group, size = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[group]  # ties share their mean rank
    area = (rank[y == 1].sum() - toxic * (toxic + 1) / 2) / (toxic * clean)
    error = 2 * np.sqrt((len(y) + 1) / (12 * toxic * clean))
    if area + error < INSEPARABLE:  # nothing to find here: above all scores
        return min(target - (score.max() + 2.0), -1.0)
    if area - error <= 0.5:
        return unsure
    order = np.argsort(-score, kind="stable")
    found = np.cumsum(y[order] == 1)
    f1 = 2 * found / (np.arange(1, len(y) + 1) + toxic)
    f1 = np.where(np.append(np.diff(score[order]) != 0, True), f1, -1)  # ties go together
    best = int(f1.argmax())
    below = score[order][best + 1 :]
    low = below.max() if len(below) else score[order][best] - 2
    return target - (score[order][best] + low) / 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> Model | None:
    """The sample of at most ``rows`` labelled rows is hashed to word slots on the executors; only slots reach the driver."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``rows`` ids, so the broadcast is bounded
    sample = cut(texts.join(F.broadcast(known), "doc_id").mapInArrow(_to_slots, "doc_id bigint, toxic int, slots binary")).where(F.octet_length("slots") <= 4 * LONGEST)
    # only as many rows reach the driver as TRAIN_WORDS allows
    sizes = sorted(tuple(r) for r in sample.select(F.xxhash64("doc_id"), F.octet_length("slots") / 4).collect())
    fit = sizes[int(np.searchsorted(np.cumsum([n for _, n in sizes]), words, "right")) - 1 :] if sizes else []
    if fit:
        sample = sample.where(F.xxhash64("doc_id") <= fit[0][0])
    sample = sample.toPandas()
    sample = sample.sort_values(["doc_id", "slots"]).drop_duplicates("doc_id")
    y = sample["toxic"].to_numpy(np.float32)
    if not (0 < y.sum() < len(y)):
        return None
    x = [np.frombuffer(b, np.int32) for b in sample["slots"]]
    order = np.random.default_rng(11).permutation(len(y))
    most = max(1, len(y) * 3 // 4)
    model = Model()
    model.fit([x[i] for i in order[:most]], y[order[:most]])
    model.calibrate([x[i] for i in order[most:]], y[order[most:]])
    return model


def _to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        slots = [slots_of(words_of(t)).tobytes() for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(slots, pa.binary())], names=["doc_id", "toxic", "slots"])


def _score(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        tables = model.tables() if model else None
        for batch in slices(batches):
            texts = as_bytes(batch.column("text"))
            scores = model.scores([slots_of(words_of(t)) for t in texts], tables) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score."""
    spark = docs.sparkSession
    model = train(docs, labels, rows)
    given = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(given), "doc_id bigint, score double")


def _below(given, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        tables = model.tables() if model else None
        for batch in slices(batches):
            if model:
                scores = model.scores([slots_of(words_of(t)) for t in as_bytes(batch.column("text"))], tables)
                batch = batch.filter(pa.array(scores < limit))
            yield batch

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``; no row is shuffled."""
    given = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    return docs.mapInArrow(_below(given, limit), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
