"""Extension points: resolvers and validators are parameters made of DataFrame functions and columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Registry:
    """Named functions from a DataFrame to (keys, value), kept in order."""

    def __init__(self) -> None:
        self._resolvers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, field: str, resolver: Callable[[DataFrame], DataFrame]) -> None:
        if field in self._resolvers:
            raise ValueError(f"field {field} has a resolver")
        self._resolvers[field] = resolver

    def resolve(self, context: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [f(context).withColumn("field", F.lit(name)) for name, f in self._resolvers.items()])


def validate_refs(df: DataFrame, valid: Column) -> DataFrame:
    """Adds verdict: what the injected condition says; null counts as rejected."""
    return df.withColumn("verdict", F.when(valid, "ok").otherwise("rejected"))
