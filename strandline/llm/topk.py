"""Exact top-k inner-product search with vector-approximation files.

Vectors are told apart by magnitude: a band holds those whose largest component lies between one power of two and the next, so a few huge vectors leave the
precision of all others alone. Every vector is approximated by one byte a dimension, the number of its cell between the smallest and largest value that the dimension has
in the band. Only these cells are dealt into blocks (of one band each, packed into one row) and meet blocks of queries; the exact vectors stay where they are:

1. Scan. The cells give a lower and an upper bound of every score. A block hands on, for each query, the rows whose upper bound reaches the
   block's kth lower bound; where cells are single values, bounds are scores, and of those equal to the kth only the k first by vec_id go on, so that copies of
   one vector cost k rows a block.
2. Bound. The kth of all lower bounds of a query, over all blocks, prunes again.
3. Read. Exact vectors are fetched by row number in order of upper bound: first the best few of each query, whose kth exact score is a
   bound that is certain, then only those rows whose upper bound still reaches it.

Blocks are equi-joined: packed cells are copied to each block of queries by number, which is the stated work, queries times rows in blocks.

Defined results: null vectors, null or non-finite components (also after scaling), null ids and vectors of another length than the most common
one take no part; every row is a query or a candidate of its own, so rows that repeat a vec_id have ranks of their own and find each other; ties go to
the smaller vec_id; fewer than k candidates give fewer rows; an empty table gives none; scores beyond 64 bits count as the largest or smallest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, table

K = 5
SCALE = 256
EVERY = 50
CELLS = 256
BLOCK_ROWS = 16384
QUERY_ROWS = 16384
SLICE = 256
#: Exact vectors that are read first for each query.
FIRST = 8
LONG = 2.0**63
EXACT = 2.0**52

FOUND_SQL = "query bigint, row bigint, lower double, upper double"
FOUND = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])
RESULT_SQL = "query_id bigint, rank int, vec_id bigint, score bigint"


class Grid:
    """Cells of one band: cell c of a dimension holds the integers from low + c * step up to, but not including, the next cell's."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low = low
        self.step = np.maximum(1.0, np.ceil((high - low + 1) / CELLS))
        self.most = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))

    def cells_of(self, exact: np.ndarray) -> np.ndarray:
        return np.clip((exact - self.low) // self.step, 0, CELLS - 1).astype(np.uint8)

    def exact_for(self, queries: np.ndarray) -> bool:
        """Whether cells are single values and scores have no rounding."""
        return bool((self.step == 1).all()) and queries.shape[1] * self.most * float(np.abs(queries).max(initial=0)) < EXACT

    def bounds(self, queries: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector, from cells alone, within 64 bits."""
        floor = self.low + cell.astype(np.float64) * self.step
        if self.exact_for(queries):
            score = queries @ floor.T
            return score, score.copy()
        with np.errstate(all="ignore"):
            middle, width = queries @ floor.T, self.step - 1
            slack = np.abs(queries).max(1) * (self.most * queries.shape[1] ** 2 * 2.0**-49)  # rounding
            lower, upper = middle + (np.minimum(queries, 0) @ width - slack)[:, None], middle + (np.maximum(queries, 0) @ width + slack)[:, None]
        return np.clip(np.nan_to_num(lower, nan=-LONG), -LONG, LONG), np.clip(np.nan_to_num(upper, nan=LONG), -LONG, LONG)


def scan_block(qrows: np.ndarray, queries: np.ndarray, rows: np.ndarray, cell: np.ndarray, grid: Grid, k: int) -> list[np.ndarray]:
    """Query, row, lower and upper bound of what may be among the best k of the block; rows in order of ties."""
    lower, upper = grid.bounds(queries, cell)
    own = qrows[:, None] == rows[None, :]
    lower[own] = upper[own] = -np.inf
    enough = (np.partition(lower, -k, 1)[:, -k] if len(rows) >= k else np.full(len(qrows), -np.inf))[:, None]
    if grid.exact_for(queries):
        equal = lower == enough
        some = (lower > enough) | equal & (np.cumsum(equal, 1) <= k)
    else:
        some = upper >= enough
    q, r = np.nonzero(some & ~own)
    return [qrows[q], rows[r], lower[q, r], upper[q, r]]


def score_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, kept within 64 bits."""
    with np.errstate(over="ignore"):
        size = x.shape[1] * np.abs(x).max(1, initial=0) * np.abs(y).max(1, initial=0)
    out = np.zeros(len(x), np.int64)
    small, wide = size < EXACT, size >= LONG / 2
    out[small] = np.einsum("ij,ij->i", x[small], y[small]).astype(np.int64)
    middle = ~small & ~wide
    out[middle] = np.einsum("ij,ij->i", x[middle].astype(np.int64), y[middle].astype(np.int64))
    for i in np.flatnonzero(wide):
        out[i] = min(max(sum(int(a) * int(b) for a, b in zip(x[i], y[i])), -(2**63)), 2**63 - 1)
    return out


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for batch in batches:
        if batch.num_rows:
            x, bands = _matrix(batch.column("vector"), batch.num_rows), batch.column("band").to_numpy()
            for band in np.unique(bands):
                own = x[bands == band]
                low, high, n = found.get(band, (own[0], own[0], 0))
                found[band] = np.minimum(low, own.min(0)), np.maximum(high, own.max(0)), n + len(own)
    rows = [(int(b), i, float(low[i]), float(high[i]), n) for b, (low, high, n) in found.items() for i in range(len(low))]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()))], names=["band", "dim", "low", "high", "n"])


def _to_cells(grids: dict[int, Grid]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, bands = _matrix(batch.column("vector"), batch.num_rows), batch.column("band").to_numpy()
            cell = np.zeros(x.shape, np.uint8)
            for band in np.unique(bands):
                cell[bands == band] = grids[int(band)].cells_of(x[bands == band])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("band", "vec_id", "row")), pa.array([c.tobytes() for c in cell], pa.binary())], names=["band", "vec_id", "row", "cells"])

    return run


def _pack(block: pa.Table) -> pa.Table:
    """One row a block: row numbers and cells in order of vec_id."""
    block = block.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    data = [block["row"].to_numpy().astype(np.int64).tobytes()], [b"".join(block["cells"].to_pylist())]
    return pa.Table.from_arrays([block["band"].slice(0, 1), block["block"].slice(0, 1), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary())], names=["band", "block", "rows", "cells"])


def _pack_queries(part: pa.Table) -> pa.Table:
    vectors = _matrix(part["vector"].combine_chunks(), part.num_rows).astype(np.float64).tobytes()
    return pa.Table.from_arrays([part["part"].slice(0, 1), pa.array([part["row"].to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([vectors], pa.binary())], names=["part", "qrows", "vectors"])


def _scan(grids: dict[int, Grid], k: int):
    def run(cells: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for band, rows, packed in zip(cells["band"].to_pylist(), cells["rows"].to_pylist(), cells["cells"].to_pylist()):
            rows = np.frombuffer(rows, np.int64)
            cell = np.frombuffer(packed, np.uint8).reshape(len(rows), -1)
            for qrows, vectors in zip(asked["qrows"].to_pylist(), asked["vectors"].to_pylist()):
                qrows = np.frombuffer(qrows, np.int64)
                exact = np.frombuffer(vectors, np.float64).reshape(len(qrows), -1)
                out += [scan_block(qrows[at : at + SLICE], exact[at : at + SLICE], rows, cell, grids[band], k) for at in range(0, len(qrows), SLICE)]
        return pa.Table.from_arrays([pa.array(np.concatenate([o[i] for o in out]) if out else [], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x, y = (_matrix(batch.column(c), batch.num_rows) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query", "row", "vec_id")), pa.array(score_pairs(x, y), pa.int64())], names=["query", "row", "vec_id", "score"])


def _scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """query, row, vec_id, score: exact vectors fetched by row number."""
    candidates = pairs.select("query", "row").join(rows.select("row", "vec_id", F.col("vector").alias("x")), "row")
    both = candidates.join(rows.select(F.col("row").alias("query"), F.col("vector").alias("y")), "query")
    return both.mapInArrow(_score, "query bigint, row bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` the ``k`` best other rows."""
    spark = vectors.sparkSession
    # integers as doubles; from 2**52 on every double is one
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite("embedding")
    given = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector")).where(finite("vector"))
    sizes = given.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes or sizes[0]["dim"] == 0:
        return spark.createDataFrame([], RESULT_SQL)
    band = F.floor(F.log2(F.greatest(F.lit(1.0), F.array_max(F.transform("vector", F.abs))))).cast("int")
    # row numbers have to stay the same in every pass
    rows = cut(given.where(F.size("vector") == sizes[0]["dim"]).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", band.alias("band")))
    edges = rows.mapInArrow(_extremes, "band int, dim int, low double, high double, n bigint").groupBy("band", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("band", "dim").collect()  # a row for each dimension of a band
    grids, blocks, first_block = {}, {}, {}
    for b in sorted({r["band"] for r in edges}):
        own = [r for r in edges if r["band"] == b]
        grids[b] = Grid(*(np.array([r[c] for r in own], np.float64) for c in ("low", "high")))
        first_block[b], blocks[b] = sum(blocks.values()), max(1, -(-own[0]["n"] // block_rows))
    asked = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // query_rows))
    of_band = lambda numbers: F.create_map(*(F.lit(x) for item in numbers.items() for x in item))[F.col("band")]
    cells = rows.mapInArrow(_to_cells(grids), "band int, vec_id bigint, row bigint, cells binary").withColumn("block", (of_band(first_block) + F.pmod(F.xxhash64("row"), of_band(blocks))).cast("int"))
    packed = cells.groupBy("block").applyInArrow(_pack, "band int, block int, rows binary, cells binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.select("row", "vector", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInArrow(_pack_queries, "part int, qrows binary, vectors binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(sum(blocks.values()) - 1))))
    found = cut(packed.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(_scan(grids, k), FOUND_SQL))
    order = W.partitionBy("query")
    bound = found.withColumn("n", F.row_number().over(order.orderBy(F.desc("lower")))).where(F.col("n") == k).select("query", F.col("lower").alias("bound"))
    left = found.join(bound, "query", "left").where(F.col("bound").isNull() | (F.col("upper") >= F.col("bound")))
    left = cut(left.withColumn("n", F.row_number().over(order.orderBy(F.desc("upper"), "row"))).select("query", "row", "upper", "n"))
    read = cut(_scores(left.where(F.col("n") <= max(first, k)), rows))
    certain = read.withColumn("n", F.row_number().over(order.orderBy(F.desc("score")))).where(F.col("n") == k).select("query", F.col("score").alias("kth"))
    more = left.where(F.col("n") > max(first, k)).join(certain, "query").where(F.col("upper") >= F.col("kth"))
    best = read.unionByName(_scores(more, rows)).withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)
    ids = rows.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return best.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with fine as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.rid as qid, q.vec_id as query_id, c.rid, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from fine q join fine c on q.rid <> c.rid where q.vec_id % {EVERY} = 0),
ranked as (select query_id, (row_number() over (partition by qid order by score desc, vec_id, rid))::int as rank, vec_id, score from scores)
select query_id, rank, vec_id, score from ranked where rank <= {K}
"""
