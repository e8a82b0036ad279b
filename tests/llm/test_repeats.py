import random

import numpy as np
import pytest

from strandline.llm import exchange, repeats

DOCS = "doc_id bigint, text string, block string, n_bytes int"


def brute(rows, depth=50):
    """rows: (doc_id, bytes). Removal flags of each row."""
    first = {}
    for i, b in rows:
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            first[w] = min(first.get(w, 1 << 62), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if first[b[s : s + depth]] < i:
                gone[s : s + depth] = b"\x01" * depth
        out.append(gone)
    return out


def some_docs(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "ätsch", "%%%", "aaaaaaaa", "thndent", "or", "la", "éoi", "x"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 120))) for _ in range(8)]
    docs = []
    for i in range(n):
        t = rnd.choice(base)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(t) + 1)
            t = t[:at] + rnd.choice(["", "Z", rnd.choice(base)[:70], "a" * rnd.randint(0, 130)]) + t[at + rnd.randint(0, 9) :]
        docs.append((i * 3 % 101, t))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(repeats, "dealt", lambda d: exchange.dealt(d, 4000))
    docs = [*some_docs(seed), (500, None), (501, ""), (None, "q" * 80), (None, "q" * 80), (7, "w" * 49), (8, "w" * 49), (9, "w" * 50), (10, "w" * 50)]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in docs], DOCS)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(df).collect())
    rows = [(1 << 61 if i is None else i, (t or "").encode()) for i, t in docs]
    want = []
    for (i, b), gone in zip(rows, brute(rows)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((-1 if i == 1 << 61 else i, len(b), sum(gone), bytes(gone).decode("latin-1").replace("\0", " ").split().__len__(), kept))
    assert got == sorted(want)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_radix_passes_keep_smallest_document():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 99, (400, 50)).astype(np.uint8)
    windows[:, 6:] = 97
    group, docs = np.zeros(400, np.int64), rng.permutation(400)
    least = repeats.sort_windows(group, windows, docs, 50)
    by = {}
    for w, d in zip(map(bytes, windows), docs):
        by[w] = min(by.get(w, 999), d)
    assert least.tolist() == [by[bytes(w)] for w in windows]
