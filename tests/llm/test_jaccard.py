import random
import re

import numpy as np
import pytest

from strandline.llm import exchange, graph, jaccard

DOCS = "doc_id bigint, text string, comp bigint, block int"


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def some_docs(seed, n, longest):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Über", "THE", "the"]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, longest))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 2)] = [rnd.choice(vocab) for _ in range(rnd.randint(0, 2))]
        docs.append((i * 7 % (n + 3) + 1000 * (i % 2), rnd.choice([" ", "\n"]).join(w)))
    return docs


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 150, 40), (2, 150, 12), (3, 120, 160)])
def test_equals_brute_force(spark, seed, n, longest, monkeypatch):
    monkeypatch.setattr(jaccard, "dealt", lambda d: exchange.dealt(d, 6000))
    docs = [*some_docs(seed, n, longest), (5001, None), (5002, ""), (5003, " \n"), (5004, "one"), (5005, "ONE"), (5006, "one two")]
    got = jaccard.similar_classes(spark.createDataFrame([(d, t, 1, 1) for d, t in docs], DOCS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def test_repeated_ids_and_crowded_segments(spark):
    ten = "a1 a2 a3 a4 a5 k12 k47 k155 k168 k185"  # its six shingles share few segments with the other's eight
    docs = [(1, ten + " k196 k206"), (2, ten), *((9, " ".join(f"v{i}x{j}" for j in range(30))) for i in range(12)), *((20 + i, " ".join(f"v{i}x{j}" for j in range(29))) for i in range(12))]
    got = jaccard.similar_classes(spark.createDataFrame([(d, t, 1, 1) for d, t in docs], DOCS)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def one_segment(seed, n):
    """Texts whose shingles all fall into few segments: none of a set's segments is left to count."""
    rnd, docs = random.Random(seed), []
    for i in range(n):
        w = [f"u{i}w{j}" for j in range(rnd.choice([9, 12, 30]))]
        docs += [(10 * i + k, " ".join(w[: len(w) - k])) for k in range(3)]
    return docs


def test_sets_short_of_segments(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT_BYTES", 500)
    docs = one_segment(5, 8) + some_docs(8, 60, 30)
    assert jaccard.Signatures(jaccard.shingle_sets([t.encode() for _, t in docs]), lambda high: 2).short.any()
    got = jaccard.similar_classes(spark.createDataFrame([(d, t, 1, 1) for d, t in docs], DOCS), segments=lambda high: 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


@pytest.mark.parametrize(("part", "longest"), [(1 << 20, 60), (1500, 60), (1500, 14)])
def test_large_groups_are_verified_by_parts(spark, monkeypatch, part, longest):
    monkeypatch.setattr(jaccard, "PART_BYTES", part)
    rnd = random.Random(3)
    template, docs = [f"t{i}" for i in range(longest)], some_docs(4, 60, longest)
    for i in range(60):
        own = rnd.randint(0, longest // 4)
        at = rnd.randrange(longest - own)
        docs.append((3000 + i, " ".join(template[:at] + [f"p{rnd.randrange(9)}" for _ in range(own)] + template[at + own :])))
    got = jaccard.similar_classes(spark.createDataFrame([(d, t, 1, 1) for d, t in docs], DOCS), most_pairs=3, sampled=1 << 20).collect()  # hardly any leaders
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(9)
    for bits in (64, 512):
        sets = [np.unique(rng.integers(1, 400, int(rng.integers(1, 300)), dtype=np.uint64)) for _ in range(30)]
        maps = jaccard.parity_bitmaps(sets, bits)
        for x, a in zip(sets, maps):
            for y, b in zip(sets, maps):
                assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_empty_and_null_ids(spark):
    assert jaccard.similar_classes(spark.createDataFrame([], DOCS)).count() == 0
    got = jaccard.similar_classes(spark.createDataFrame([(None, "a b c d e f", 1, 1), (3, "a b c d e f", 1, 1)], DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("3", 2, 3), ("None", 2, None)]


def test_bound_on_difference():
    for s in range(1, 60):
        for t in range(s, 60):
            most = max((s + t - 2 * i for i in range(s + 1) if 100 * i >= 75 * (s + t - i)), default=None)
            if most is not None:
                assert jaccard.most_different(s, t) >= most
                assert jaccard.most_different(s, t + 1) >= jaccard.most_different(s, t)


def test_linked_sets_share_a_probe():
    rng = np.random.default_rng(4)
    for _ in range(4000):
        n = int(rng.integers(1, rng.choice([8, 30, 200])))
        x = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate((x[int(rng.integers(0, n // 6 + 1)) :], rng.integers(1, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        a, b = jaccard.Signatures([np.sort(x)]), jaccard.Signatures([np.sort(y)])
        probe = a.allocate(rng.integers(0, 3, len(a.hashes)).astype(np.uint8))
        assert len(np.intersect1d(a.hashes[probe], b.hashes))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
