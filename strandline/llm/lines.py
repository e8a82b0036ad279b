"""Line dedup by site-relative frequency.

A line's key is the 64-bit hash of its text without outer spaces. Pages holding a key are counted per host
(partial sums before the shuffle, so a hot host or line costs one row a task), and a key on more than ``ratio`` of its host's
pages is boilerplate if at least ``LEAST`` pages have it (on fewer nothing repeats). A host has fewer than (mean lines a page) / ratio such
keys, whatever its size: the sum of all its keys' ratios is the mean number of distinct lines a page. So the keys travel back as one short array
for each host, broadcast while their number is small, which is checked, and else joined, with the pages of hot hosts dealt over salts.

Defined results: null and empty text stay as they are; null hosts form one host of their own; blank lines are never
boilerplate; repeated rows are pages of their own; other columns pass through unchanged, whatever their names; n_chars is recomputed where
the table has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

RATIO = 0.3
LEAST = 3
#: Most line keys (8 bytes each, and 8 more a host) that are broadcast; and beyond that, pages of a host that share a salt.
BROADCAST_KEYS = 500_000
SALT_PAGES = 1_000_000


def _keys(text: str | Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO) -> DataFrame:
    """site, drop (array of line keys), pages: for hosts that have boilerplate."""
    pages = docs.select(F.col(host).cast("string").alias("site"), F.col("text").cast("string").alias("text"))
    totals = pages.groupBy(F.col("site").alias("host")).agg(F.count("*").alias("pages"))
    lines = pages.select("site", F.explode(F.array_compact(F.array_distinct(_keys("text")))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n"))
    lines = lines.where(F.col("n") >= LEAST)
    found = lines.join(totals, F.col("site").eqNullSafe(F.col("host"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("site").agg(F.array_sort(F.collect_list("line")).alias("drop"), F.max("pages").alias("pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, counts: tuple[str, str] | None = None) -> DataFrame:
    """All columns of ``docs`` with text less its boilerplate lines; ``counts`` names two more, of the lines of a page and of those dropped."""
    names = docs.columns
    # numbered columns inside, so that no name of the table can clash
    page = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, of = F.col(f"c{names.index('text')}").cast("string"), F.col(f"c{names.index(host)}").cast("string")
    found = cut(boilerplate(docs, host, ratio))
    keys = found.agg(F.coalesce(F.sum(F.size("drop") + 8), F.lit(0))).first()[0]
    if keys <= BROADCAST_KEYS:
        rows = page.join(F.broadcast(found), of.eqNullSafe(F.col("site")), "left")
    else:
        # a hot host's pages go to several places; hot hosts are few: SALT_PAGES pages each
        hot = found.where(F.col("pages") > SALT_PAGES).select(F.col("site").alias("hot_site"), F.ceil(F.col("pages") / SALT_PAGES).cast("int").alias("salts"))
        page = page.join(F.broadcast(hot), of.eqNullSafe(F.col("hot_site")), "left").withColumn("at", F.pmod(F.xxhash64(text), F.coalesce("salts", F.lit(1))).cast("int"))
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / SALT_PAGES).cast("int") - 1)))
        rows = page.join(spread, of.eqNullSafe(F.col("site")) & (F.col("at") == F.col("salt")), "left")
    split = F.split(text, "\n", -1)
    left = F.filter(split, lambda x: ~F.coalesce(F.array_contains("drop", F.xxhash64(F.trim(x))) & (F.trim(x) != ""), F.lit(False)))
    rows = rows.withColumn("kept", F.when(F.col("drop").isNotNull() & text.isNotNull(), left))
    less = F.when(F.col("kept").isNotNull() & (F.size("kept") < F.size(split)), F.array_join("kept", "\n")).otherwise(text)
    out = [less if n == "text" else F.char_length(less).cast("long") if n == "n_chars" else F.col(f"c{i}") for i, n in enumerate(names)]
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.size(split))
        out += [n.cast("long"), F.coalesce(n - F.size("kept"), F.lit(0)).cast("long")]
    return rows.select(*[c.alias(n) for c, n in zip(out, [*names, *(counts or ())])])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs, counts=("n_lines", "n_dropped")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE = f"""
with lines as (
  select doc_id, source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) as line from documents),
totals as (select source, count(*) as pages from documents group by source),
found as (
  select l.source, line from lines l join totals t on l.source is not distinct from t.source
  group by l.source, line, pages having count(*) > {RATIO}::double * pages and count(*) >= {LEAST}),
drops as (select source, list(line) as dropped from found group by source),
kept as (
  select doc_id, text, string_split(text, chr(10)) as all_lines,
    case when dropped is null then string_split(text, chr(10)) else list_filter(string_split(text, chr(10)), lambda x: not list_contains(dropped, trim(x))) end as kept_lines
  from documents d left join drops s on d.source is not distinct from s.source)
select doc_id, case when text is null then null else array_to_string(kept_lines, chr(10)) end as text,
  coalesce(len(all_lines), 0)::bigint as n_lines, coalesce(len(all_lines) - len(kept_lines), 0)::bigint as n_dropped
from kept
"""
