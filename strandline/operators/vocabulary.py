"""Controlled vocabularies: a value is known as a whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import raw_value_state

SEPARATORS = " → ", "、"


def normalize(df: DataFrame, raw: str, vocabulary: Mapping[str, str], separator: str = "、") -> DataFrame:
    """Adds state (value, unmapped, unknown) and value. The parts of a chain or list are looked up one by one, exactly first and then in lower case; any miss leaves the whole unmapped.

    A field's vocabulary is a short fixed list, so it is a literal map in the plan rather than a join.
    """
    pairs = [F.lit(x) for k, v in vocabulary.items() for x in (k, v)]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    parts = F.transform(F.split(F.col(raw), separator), lambda p: F.coalesce(F.try_element_at(known, F.trim(p)), F.try_element_at(known, F.lower(F.trim(p)))))
    fine = F.forall(parts, lambda p: p.isNotNull())
    empty = F.trim(F.coalesce(F.col(raw), F.lit(""))).isin("") | (raw_value_state(raw) == "unknown")
    return df.withColumn("state", F.when(empty, "unknown").when(fine, "value").otherwise("unmapped")).withColumn("value", F.when(~empty & fine, F.array_join(parts, separator)))
