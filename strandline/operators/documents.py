"""JSON documents as tables: every path with its kind, evidence references wherever they stand, and pointers resolved against the paths.

Documents are VARIANT values, and their nodes are found level by level inside the row, as deep as the brackets of the text say; no Python runs. A text that is not JSON, or whose objects name
a key twice, or beyond the size or depth that VARIANT takes, counts as no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = r"[^.\[\]]+(\[[0-9]+\])*"
SEGMENTS = rf"^{_STEP}(\.{_STEP})*$"
_NODES = "array<struct<steps:array<string>,node:variant>>"


def _depth(text: Column) -> Column:
    """How many brackets of a JSON text are open at once at most. Escapes go first and texts in quotes next; what is left of the brackets is counted by one scan."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    opens = F.transform(F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), ""), lambda c: F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1))
    most = lambda a, c: F.struct((a["now"] + c).alias("now"), F.greatest(a["most"], a["now"] + c).alias("most"))
    return F.coalesce(F.aggregate(opens, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), most, lambda a: a["most"]), F.lit(0))


def _members(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def _entries(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def nodes(text: str) -> Column:
    """All nodes of a JSON text, the root first: steps (names, and places as [n]) and node (VARIANT, null if the text is no JSON)."""
    child = lambda parent, step, value: F.struct(F.concat(parent["steps"], F.array(step)).alias("steps"), value.alias("node"))

    def below(parent: Column) -> Column:
        named = F.transform(F.map_entries(_members(parent["node"])), lambda e: child(parent, e["key"], e["value"]))
        placed = F.transform(_entries(parent["node"]), lambda x, i: child(parent, F.concat(F.lit("["), i.cast("string"), F.lit("]")), x))
        return F.coalesce(named, placed, F.array().cast(_NODES))

    root = F.array(F.struct(F.array().cast("array<string>").alias("steps"), F.try_parse_json(text).alias("node")))
    start = F.struct(F.array().cast(_NODES).alias("done"), root.alias("level"))
    step = lambda s, _: F.struct(F.concat(s["done"], s["level"]).alias("done"), F.flatten(F.transform(s["level"], below)).alias("level"))
    return F.aggregate(F.sequence(F.lit(0), _depth(F.col(text))), start, step, lambda s: s["done"])


def kind_of(node: Column) -> Column:
    """object, array, string, boolean, number or null."""
    kind = F.schema_of_variant(node)
    scalar = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    return F.when(node.isNull(), "null").when(_members(node).isNotNull(), "object").when(_entries(node).isNotNull(), "array").otherwise(scalar)


def inventory(docs: DataFrame) -> DataFrame:
    """file, path (steps joined by /, the root is empty) and kind of every node. docs: file, doc (JSON; text that is none has no paths but a null root)."""
    rows = docs.select("file", F.explode(nodes("doc")).alias("n"))
    return rows.select("file", F.array_join("n.steps", "/").alias("path"), kind_of(F.col("n.node")).alias("kind"))


def references(docs: DataFrame, field: str = "evidenceRefs") -> DataFrame:
    """artifact, path, ref of every entry of a list named ``field``, at any depth; ref is null where the entry is no text. docs: artifact, doc."""
    lists = F.filter(nodes("doc"), lambda n: (F.try_element_at(n["steps"], F.lit(-1)) == field) & _entries(n["node"]).isNotNull())
    rows = docs.select(F.col("artifact").cast("string").alias("artifact"), F.explode(lists).alias("n")).select("artifact", "n.steps", F.posexplode(_entries(F.col("n.node"))).alias("i", "x"))
    path = F.array_join(F.concat("steps", F.array(F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]")))), "/")
    return rows.select("artifact", path.alias("path"), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string")).alias("ref"))


def resolve_pointers(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds error to refs (file, pointer like a.b[0].c): null if the pointer leads somewhere, else what stops it: bad segment, no document, missing key, wrong type or out of bounds. paths: an inventory.

    Each prefix of a pointer is looked up; the kind of what holds the first missing step tells the errors apart."""
    rows = refs.select("file", "pointer").distinct()
    steps = F.regexp_extract_all("pointer", F.lit(r"\[[0-9]+\]|[^.\[\]]+"), F.lit(0))
    each = rows.select("file", "pointer", steps.alias("_s")).select("file", "pointer", "_s", F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("k"))
    each = each.select("file", "pointer", "k", F.array_join(F.slice("_s", F.lit(1), F.col("k")), "/").alias("path"), F.get("_s", F.col("k")).startswith("[").alias("_place"))
    # the longest prefix that exists, and the step after it; an inventory is larger than Catalyst takes exploded nodes to be, and is not broadcast
    last = each.join(paths.hint("merge"), ["file", "path"]).groupBy("file", "pointer").agg(F.max(F.struct("k", "kind", "_place")).alias("l"))
    wrong = F.when(F.col("l._place").isNull(), None).when(F.col("l._place") & (F.col("l.kind") == "array"), "out of bounds").when(~F.col("l._place") & (F.col("l.kind") == "object"), "missing key").otherwise("wrong type")
    out = refs.join(last, ["file", "pointer"], "left")
    error = F.when(~F.col("pointer").rlike(SEGMENTS), "bad segment").when(F.col("l").isNull(), "no document").otherwise(wrong)
    return out.withColumn("error", error).drop("l")
