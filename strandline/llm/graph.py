"""Connected components of a table of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task joins to stars before labels start to travel.
EDGES_A_TASK = 1 << 14


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: each node to the smallest node of its part."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(find(x), x) for x in list(parent)]
    stars = [s for s in stars if s[0] != s[1]]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in range(2)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). node, comp: the smallest node reachable, for every node of an edge."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct())
    stars = edges.repartition(max(1, -(-edges.count() // EDGES_A_TASK))).mapInArrow(_forest, "a bigint, b bigint")
    both = cut(stars.union(stars.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "comp").unionByName(labels)
        least = near.groupBy("node").agg(F.min("comp").alias("comp"))
        far = labels.select(F.col("node").alias("_at"), F.col("comp").alias("_far"))
        moved = least.join(far, least["comp"] == far["_at"], "left").select("node", F.least("comp", F.coalesce("_far", "comp")).alias("comp"))
        old = labels.select(F.col("node").alias("_node"), F.col("comp").alias("_old"))
        moved = cut(moved.join(old, moved["node"] == old["_node"]).select("node", "comp", (F.col("comp") != F.col("_old")).alias("_changed")))
        labels = moved.select("node", "comp")
        if not moved.where("_changed").limit(1).count():
            return labels
