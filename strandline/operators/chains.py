"""Greedy decisions on chains: runs of neighbours that are close enough to influence each other.

A chain is short even where a video is long. Chains are dealt by (video, chain), sorted, and decided one after the other in a
stream of batches; only the chain at the end of a batch is held over, so memory is bounded by a batch and a chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_chains(df: DataFrame, opens: Column, order: str, keys: Sequence[str]) -> DataFrame:
    """Adds chain; ``opens`` says where one starts. Rows of equal order share a chain."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_opens", opens.cast("long")).withColumn("chain", F.sum("_opens").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_opens")


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def decide(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], rule: Callable[..., list], name: str, kind: str) -> DataFrame:
    """Adds ``name`` (of SQL type ``kind``): rule gets the lists of a chain's inputs, in order, and gives a list of results."""
    by = [*keys, "chain"]
    schema = df.withColumn(name, F.lit(None).cast(kind)).schema

    def settle(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns, out = [pdf[c].tolist() for c in inputs], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)]):
            out += rule(*[c[s:e] for c in columns])
        return pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype="boolean" if kind == "boolean" else "Int64" if kind in ("bigint", "int") else object)})

    def starts_of(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), bool)
        change[:1] = True
        for c in by:
            values = pdf[c].to_numpy()
            change[1:] |= (values[1:] != values[:-1]) & ~(pd.isna(values[1:]) & pd.isna(values[:-1]))
        return np.flatnonzero(change)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the pieces of the last chain, joined once when it ends
        for pdf in parts:
            if not len(pdf):
                continue
            starts = starts_of(pdf)
            if held:
                goes_on = all(_same(held[0][c].iloc[0], pdf[c].iloc[0]) for c in by)
                if goes_on and len(starts) == 1:
                    held.append(pdf)
                    continue
                if goes_on:
                    held.append(pdf.iloc[: starts[1]])
                    pdf, starts = pdf.iloc[starts[1] :], starts[1:] - starts[1]
                yield settle(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))
            if len(starts) > 1:
                yield settle(pdf.iloc[: starts[-1]].reset_index(drop=True), starts[:-1])
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield settle(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
