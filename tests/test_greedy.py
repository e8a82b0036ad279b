"""Greedy operators against plain loops over whole videos."""

import random

import pytest

from strandline.operators import aggregate as A
from strandline.operators import joins as J
from strandline.operators import signal as G


def series(seed, n=160, videos=3):
    rnd = random.Random(seed)
    rows = []
    for v in range(videos):
        at = 0
        for _ in range(n):
            at += rnd.choice([1, 1, 1, 2, 3, 9])
            rows.append((v, at, float(rnd.randint(0, 12)), rnd.choice(["high", "medium", "low"])))
    return rows


@pytest.mark.parametrize("step", [1, 3, 6])
def test_suppress_close(spark, step):
    rows = series(step)
    got = sorted((r.video, r.i) for r in G.suppress_close(spark.createDataFrame(rows, "video long, i long, value double, confidence string"), "value", step).collect())
    want = []
    for v in {r[0] for r in rows}:
        kept = []
        for _, i, value, _ in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[2], r[1])):
            if all(abs(i - k) >= step for k in kept):
                kept.append(i)
        want += [(v, i) for i in kept]
    assert got == sorted(want)


@pytest.mark.parametrize(("minimum", "rapid"), [(5, 2), (2, 4), (1, 1)])
def test_merge_short(spark, minimum, rapid):
    rows = series(minimum * 7 + rapid)
    got = {(r.video, r.i): r.merged_into for r in G.merge_short(spark.createDataFrame(rows, "video long, i long, value double, confidence string"), minimum, rapid).collect()}
    want = {}
    for v in {r[0] for r in rows}:
        kept = []
        for _, i, _, c in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[2], r[1])):
            near = next((k for k, kc in kept if abs(i - k) < (rapid if c == kc == "high" else minimum)), None)
            want[v, i] = near
            if near is None:
                kept.append((i, c))
    assert got == want


def test_greedy_match_and_scores(spark):
    rnd = random.Random(4)
    golden = [(v, rnd.randint(0, 3000)) for v in range(4) for _ in range(40)]
    found = [(v, rnd.randint(0, 3000)) for v in range(3) for _ in range(50)]
    g, f = (spark.createDataFrame(x, "video long, t long") for x in (golden, found))
    matched = J.greedy_match(g, f, 20)
    got = sorted((r.video, r.golden_t, r.found_t) for r in matched.collect())
    want = []
    for v in range(4):
        free = sorted(t for w, t in found if w == v)
        for t in sorted(t for w, t in golden if w == v):
            near = min((x for x in free if abs(x - t) <= 20), key=lambda x: (abs(x - t), x), default=None)
            if near is not None:
                free.remove(near)
                want.append((v, t, near))
    assert got == sorted(want)
    scores = {r.video: r for r in A.recall_precision(g, f, matched).collect()}
    hits = sum(1 for w in want if w[0] == 1)
    assert scores[1].recall == hits / 40 and scores[1].precision == hits / 50
    assert scores[3].precision == 1.0 and scores[3].recall == 0.0


def test_a_chain_over_many_batches(spark):
    """Chains of any length are decided whole, whatever batches they come in; a null key is a key."""
    from pyspark.sql import functions as F

    from strandline.operators import chains

    lengths = [1, 500, 3, 1, 1200, 64, 64, 2]
    rows = [(v, chain, i) for v in (1, None) for chain, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(rows, "video long, chain long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = chains.decide(df, ["video"], ["i"], ["i"], lambda at: [len(at) * 10_000 + x for x in at], "seen", "bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(rows) and all(r.seen == lengths[r.chain] * 10_000 + r.i for r in out)
    assert chains.decide(df.where(F.lit(False)), ["video"], ["i"], ["i"], list, "seen", "bigint").count() == 0
