"""Search against brute force, and trained models by held-out accuracy and exact recomputation."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import exchange, pseudo, topk, toxicity

VECTORS = "vec_id bigint, embedding array<float>, label int, score int, rank string"


@pytest.mark.parametrize(("block_rows", "first"), [(7, 1), (40, 100), (1000, 8)])
def test_top_k_equals_brute_force(spark, block_rows, first):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-300, 400, 6) / 256).tolist()) for i in range(160)] + [(i, (rng.integers(-1, 2, 6) / 4).tolist()) for i in range(300, 340)]
    rows += [(3, rows[50][1]), (50, rows[50][1]), (50, rows[70][1]), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [1.0]), (None, [1.0] * 6), (250, [])]
    df = spark.createDataFrame([(i, v, 1, 1, "clash") for i, v in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, block_rows=block_rows, query_rows=2 if block_rows < 100 else 100, first=first).collect())
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for m, (i, w) in enumerate(fine) if m != n)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_of_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert topk.top_k(df.limit(0)).count() == 0
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 4 * 256 * 256)]
    assert topk.top_k(df.limit(1)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (50, [2.0, 1.0]), (1, [-1e30, 0.0]), (2, [1.0, 1e5]), (3, [1.7e308, 0.0]), (4, [1e7, 3.0]), (5, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(huge).collect())
    vectors = {0: (int(1e30 * 256), 256), 50: (512, 256), 1: (-int(1e30 * 256), 0), 2: (256, 25_600_000), 4: (2_560_000_000, 768), 5: (1280, 1280)}  # the scaled 1.7e308 is not finite
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(vectors[q], v))), i) for i, v in vectors.items() if i != q)[:5]
        want += [(q, r, i, -x) for r, (x, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_outliers_and_copies_leave_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (1500, 16))
    base[7] *= 1000
    base[200:900] = base[200]  # copies
    seen = []
    monkeypatch.setattr(topk, "cut", lambda df: seen.append(df) or topk_cut(df))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, block_rows=400).collect())
    x = np.floor(256 * base).astype(np.int64)
    want = [(q, r, i, -s) for q in range(0, 1500, 50) for r, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(1500) if i != q)[:5], 1)]
    assert got == want
    grid = topk.Grid(x[[i for i in range(1500) if i != 7]].min(0).astype(float), x[[i for i in range(1500) if i != 7]].max(0).astype(float))
    rest = np.array([i for i in range(1500) if i != 7 and not 200 <= i < 900])
    q, r, _, _ = topk.scan_block(np.array([0, 50]), x[[0, 50]].astype(float), rest, grid.cells_of(x[rest]), grid, 5)
    assert len(r) < 100  # without the outlier's own band every row would remain


topk_cut = topk.cut


def test_equal_vectors_cost_k_rows_a_block():
    grid = topk.Grid(np.full(4, 3.0), np.full(4, 3.0))
    x = np.full((900, 4), 3.0)
    q, r, low, high = topk.scan_block(np.array([2, 899]), x[:2], np.arange(900), grid.cells_of(x), grid, 5)
    assert r.tolist() == [0, 1, 3, 4, 5, 0, 1, 2, 3, 4] and (low == high).all()


def test_cell_bounds_hold():
    rng = np.random.default_rng(5)
    for size in (100, 900, 2**40, 2**62, 1e200):
        x, q = np.floor(rng.uniform(-size, size, (300, 20))), np.floor(rng.uniform(-size, size, (7, 20)))
        grid = topk.Grid(x.min(0), x.max(0))
        lower, upper = grid.bounds(q, grid.cells_of(x))
        exact = np.array([[min(max(sum(int(a) * int(b) for a, b in zip(v, w)), -(2**63)), 2**63) for w in x] for v in q], object)
        assert all(lower[i, j] <= exact[i, j] <= upper[i, j] for i in range(7) for j in range(300))
        assert [int(s) for s in topk.score_pairs(np.repeat(q, 300, 0), np.tile(x, (7, 1)))] == [min(e, 2**63 - 1) for e in exact.ravel()]
    small = rng.integers(-900, 900, (300, 20)).astype(float)
    grid = topk.Grid(small.min(0), small.max(0))
    lower, upper = grid.bounds(small[:7], grid.cells_of(small))
    assert (upper - lower).max() < 2 * 20 * 900 * grid.step.max()


def toxic_case(n):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        toxic = int(rnd.random() < 0.25)
        for _ in range(toxic * rnd.randint(2, 5)):
            w.insert(rnd.randrange(len(w)), rnd.choice(["idiot", "SCUM", "trash!", "moron"]))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_case(1500)
    extra = [(9000, None, None), (9001, "", None), (9002, "idiot " * 3000, None), (9003, "w1 " * 30000, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in [*rows, *extra]], "doc_id bigint, text string, lang string, score int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (77777, 1, 1), (9000, 1, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.THRESHOLD) == bool(y) for i, y in held)
    assert right / len(held) >= 0.95
    assert got[9000] == got[9001] and 0 <= got[9001] < toxicity.THRESHOLD <= got[9002] and got[9003] < toxicity.THRESHOLD
    assert len(got) == len(rows) + len(extra)
    assert {r.score for r in toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.0}
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, s in got.items() if s < toxicity.THRESHOLD}


def calibrated(monkeypatch, texts, scores, labels):
    docs = [toxicity.slots_of(toxicity.words_of(t)) for t in texts]
    model = toxicity.Model()
    monkeypatch.setattr(model, "logits", lambda *_: np.array(scores, np.float32))
    model.calibrate(docs, np.array(labels, np.float32))
    return model.scores(docs, None) >= toxicity.THRESHOLD


def test_calibration_does_not_depend_on_the_share_of_toxic_rows(monkeypatch):
    rng = np.random.default_rng(2)
    y = np.arange(5000) < 60
    assert (calibrated(monkeypatch, [b"the of"] * 5000, np.where(y, 1.0, -3.0) + rng.normal(0, 0.1, 5000), y) == y).all()
    assert not calibrated(monkeypatch, [b"the of"] * 5000, rng.normal(0, 1, 5000), rng.random(5000) < 0.3).any()  # nothing to tell apart
    for rows in (49, 51, 90):  # a language of few toxic rows takes the threshold of all
        texts, y = [b"the of"] * 400 + [b"der die und"] * rows, np.r_[np.arange(400) < 100, np.arange(rows) < 3]
        assert (calibrated(monkeypatch, texts, np.where(y, 1.0, -3.0) + rng.normal(0, 0.1, len(y)), y) == y).all()


def test_one_toxic_row_in_a_hundred_is_found(spark):
    rows = [(i, t) for i, t, y in toxic_case(4000) if not y][:2970]
    bad = [(5000 + i, t) for i, t, y in toxic_case(400) if y][:30]
    docs = spark.createDataFrame([*rows, *bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i, _ in [*rows, *bad]], "doc_id bigint, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert sum(i not in kept for i, _ in bad) >= 24 and sum(i not in kept for i, _ in rows) <= 15


def plain_scores(texts, own, totals, params):
    """Pseudo-likelihood by its definition, with counts in dictionaries and the forward pass for one token at a time."""
    lists = [(t or "").lower().encode().split() for t in texts]
    words, same, around = Counter(w for x in lists for w in x), Counter(), Counter()
    for x in lists:
        for i, w in enumerate(x):
            side = tuple(x[j] if 0 <= j < len(x) else None for j in (i - 2, i - 1, i + 1, i + 2))
            around[side] += 1
            same[side, w] += 1

    def class_of(x, i):
        return int(own[zlib.crc32(x[i]) % pseudo.BUCKETS]) if 0 <= i < len(x) else 0

    in_class = Counter()
    for w, n in words.items():
        in_class[class_of([w], 0)] += n
    for c, n in in_class.items():
        assert abs(np.exp(totals[c]) - n) < 1e-6 * n
    out = []
    for x in lists:
        total = 0.0
        for i, w in enumerate(x):
            hidden = np.tanh(params["left"][class_of(x, i - 1)].astype(float) + params["right"][class_of(x, i + 1)] + params["at"])
            logit = hidden @ params["out"].astype(float) + params["bias"]
            c = class_of(x, i)
            prior = np.exp(logit[c] - np.log(np.exp(logit).sum())) * words[w] / in_class[c]
            side = tuple(x[j] if 0 <= j < len(x) else None for j in (i - 2, i - 1, i + 1, i + 2))
            total += np.log((same[side, w] - 1 + pseudo.STRENGTH * prior) / (around[side] - 1 + pseudo.STRENGTH))
        out.append((len(x), total))
    return out


@pytest.mark.parametrize("block_bytes", [1000, 1 << 20])
def test_pseudo_likelihood_equals_its_definition(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(pseudo, "dealt", lambda d: exchange.dealt(d, block_bytes))
    rnd = random.Random(4)
    texts = ["the cat sat on the mat", "the dog sat on the log", None, "", "...", "mat", "the cat sat on the mat"] * 12
    texts += [" ".join(rnd.choice(["a", f"w{int(rnd.expovariate(0.01))}"]) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    texts = [t if t != "..." else " " for t in texts] + ["so " * 400, "zzqx"]
    df = spark.createDataFrame([(i % 200, t, 1.0, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, sum_logp double, block int")
    got = sorted((r.doc_id, r.n_words, r.sum_logp, r.mean_logp) for r in pseudo.score_documents(df).collect() if r.n_words)
    want = sorted((i % 200, n, total, total / max(n, 1)) for i, (n, total) in enumerate(plain_scores(texts, *pseudo.fit(df))) if n)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * max(1, abs(b[2])) and abs(a[3] - b[3]) < 1e-3 * max(1, abs(b[3]))
    assert pseudo.score_documents(df).where("n_words = 0 and (sum_logp <> 0 or mean_logp is not null)").count() == 0
    assert pseudo.score_documents(df).count() == len(texts)
    assert pseudo.score_documents(df.limit(0)).count() == 0


def test_probabilities_of_all_words_sum_to_one(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    own, totals, params = pseudo.fit(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    known = pseudo.log_probabilities(params).reshape((pseudo.CLASSES,) * 3)
    assert np.allclose(np.exp(known).sum(2), 1, atol=1e-4)
    n = Counter(w for t in texts for w in t.encode().split())
    classes = {w: int(own[zlib.crc32(w) % pseudo.BUCKETS]) for w in n}
    for left, right in ((0, 0), (3, 4)):
        assert abs(sum(np.exp(known[left, right, c] - totals[c]) * n[w] for w, c in classes.items()) - sum(np.exp(known[left, right, c]) for c in set(classes.values()))) < 1e-6


def test_repeated_documents_score_apart(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"w{int(rnd.expovariate(0.01))}" for _ in range(50)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:30]])], "doc_id bigint, text string")
    got = {r.doc_id: r.mean_logp for r in pseudo.score_documents(df).collect()}
    twice, once = [got[i] for i in range(30)], [got[i] for i in range(30, 300)]
    assert min(twice) > max(once)
