"""URL filter with empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (a page is bad if its label says toxic or low quality) are counted per host. Each level of suffix, registered
domain and host gets a beta-binomial posterior whose prior mean is its parent's posterior mean and whose strength is
the method-of-moments estimate at that level. A host is blocked when the lower posterior bound of its bad rate
exceeds ``max_bad``; the bound is the normal approximation of the beta posterior, clipped to 0 and 1. The suffix of a host is its last
label, or its last two where a country's code follows one of the usual second levels (co.uk); its registered domain is one label more. Fixed rules (host, path prefix) take precedence; the longest rule that fits wins.

Defined results: a null url or one without '://' has empty host and path, and gets the verdict of the empty host;
pages without labels count for no rate; several labels of one page count once (bad if any is); a host without labelled
pages has its domain's prior; without any label every host is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MAX_BAD = 0.5
Z = 1.6448536269514722
#: Bounds of the intra-class correlation, so that strengths stay between 1 and 999.
RHO = (0.001, 0.5)
#: Second levels under which countries register domains (fixed values); as a regular expression, a suffix of two labels.
SECOND_LEVELS = "ac co com edu gob gouv gov govt gub ltd me mil ne net nom or org plc sch"
_TWO = rf"(?:{SECOND_LEVELS.replace(' ', '|')})\.[a-z][a-z]"
SUFFIX = rf"(?:^|\.)({_TWO})$"
DOMAIN_OF_TWO = rf"([^.]+\.{_TWO})$"
DOMAIN_OF_ONE = r"([^.]+\.[^.]+)$"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _level(counts: DataFrame, key: str, parent: str, means: DataFrame | None, overall: DataFrame) -> DataFrame:
    """Posterior a, b of each key: counts has key, parent, n, k; means has parent, mean."""
    lo, hi = RHO
    spread = counts.where("n > 0").agg(
        F.count("*").alias("_i"), F.sum("n").cast("double").alias("_n"), F.sum("k").cast("double").alias("_k"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("_kk"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("_nn"))
    p = F.col("_k") / F.col("_n")
    rho = ((F.col("_kk") - p * p * F.col("_n")) / (p * (1 - p)) - (F.col("_i") - 1)) / (F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_i") - 1))
    flat = (F.col("_i") < 2) | (F.col("_k") == 0) | (F.col("_k") == F.col("_n")) | (F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_i") - 1) <= 0)
    spread = spread.select((1 / F.when(F.coalesce(flat, F.lit(True)), lo).otherwise(F.least(F.greatest(rho, F.lit(lo)), F.lit(hi))) - 1).alias("_m"))
    # constants of a level are scalar subqueries
    rows = counts.join(means.select(F.col(parent), F.col("mean").alias("_prior")), parent) if means is not None else counts.withColumn("_prior", overall.scalar())
    rows = rows.withColumn("_m", spread.scalar())
    a = F.col("k") + F.col("_prior") * F.col("_m")
    b = F.col("n") - F.col("k") + (1 - F.col("_prior")) * F.col("_m")
    return rows.select(key, a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, k, mean, low: posterior mean and lower bound of the bad rate of every host."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    outcomes = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy(F.col("doc_id").cast("long").alias("_page")).agg(F.max(bad.cast("long")).alias("_bad"))
    seen = pages.select(F.col("page_id").cast("long").alias("_page"), host_of(F.col("url")).alias("host")).join(outcomes, "_page", "left")
    hosts = seen.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    two = F.regexp_extract("host", SUFFIX, 1)
    name = F.when(two != "", F.regexp_extract("host", DOMAIN_OF_TWO, 1)).otherwise(F.regexp_extract("host", DOMAIN_OF_ONE, 1))
    hosts = hosts.withColumn("domain", F.when(name == "", F.col("host")).otherwise(name)).withColumn("suffix", F.when(two != "", two).otherwise(F.regexp_extract("host", r"([^.]*)$", 1)))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = suffixes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("mean"))
    by_suffix = _level(suffixes, "suffix", "", None, overall)
    by_domain = _level(domains, "domain", "suffix", by_suffix, overall)
    by_host = _level(hosts, "host", "domain", by_domain, overall)
    total = F.col("a") + F.col("b")
    return by_host.withColumn("low", F.greatest(F.lit(0.0), F.col("mean") - Z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule, verdict, low (the host's lower bound). The join on host stays a plain one: it can be split where a host is hot, and is broadcast only below Spark's own threshold."""
    reputation = host_reputation(pages, labels).select(F.col("host").alias("_host"), "low")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return rows.join(reputation, rows["host"] == reputation["_host"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "low")


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    def level(key: str, parent: str, counts: str, means: str) -> str:
        up = f"join {means} m using ({parent})" if parent else f"cross join {means} m"
        return f"""
s_{key} as (select case when i < 2 or kk_ = 0 or kk_ = nn_ or nn_ - n2 / nn_ - (i - 1) <= 0 or i is null then {RHO[0]}::double
    else least(greatest(((k2 - (kk_/nn_)*(kk_/nn_)*nn_) / ((kk_/nn_)*(1-kk_/nn_)) - (i - 1)) / (nn_ - n2 / nn_ - (i - 1)), {RHO[0]}::double), {RHO[1]}::double) end as rho
  from (select count(*) i, sum(n)::double nn_, sum(k)::double kk_, sum(k * k / n::double) k2, sum((n * n)::double) n2 from {counts} where n > 0)),
p_{key} as (select {key}, k + mean * (1 / rho - 1) as a, n - k + (1 - mean) * (1 / rho - 1) as b from {counts} {up} cross join s_{key}),
m_{key} as (select {key}, a, b, a / (a + b) as mean from p_{key})"""

    name, verdict = "null", "null"
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        name, verdict = f"case when {fits} then '{h}{p}' else {name} end", f"case when {fits} then '{v}' else {verdict} end"
    return f"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
outcomes as (select doc_id, max(case when coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0 then 1 else 0 end) as bad
  from labels where doc_id is not null and (toxic is not null or quality is not null) group by doc_id),
c_host0 as (select host, count(bad) as n, coalesce(sum(bad), 0) as k from parts left join outcomes on page_id = doc_id group by host),
c_host1 as (select *, regexp_extract(host, '{SUFFIX}', 1) as two,
    case when regexp_extract(host, '{SUFFIX}', 1) <> '' then regexp_extract(host, '{DOMAIN_OF_TWO}', 1) else regexp_extract(host, '{DOMAIN_OF_ONE}', 1) end as name from c_host0),
c_host as (select host, n, k, case when name = '' then host else name end as domain, case when two <> '' then two else regexp_extract(host, '([^.]*)$', 1) end as suffix from c_host1),
c_domain as (select domain, suffix, sum(n) as n, sum(k) as k from c_host group by all),
c_suffix as (select suffix, sum(n) as n, sum(k) as k from c_domain group by all),
overall as (select coalesce(sum(k) / nullif(sum(n), 0)::double, 0) as mean from c_suffix),
{level("suffix", "", "c_suffix", "overall")},{level("domain", "suffix", "c_domain", "m_suffix")},{level("host", "domain", "c_host", "m_domain")},
bounds as (select host, greatest(0, mean - {Z}::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) as low from m_host)
select page_id, host, path, {name} as rule, coalesce({verdict}, case when low > {MAX_BAD} then 'block' else 'allow' end) as verdict
from parts join bounds using (host)
"""


ORACLE = _oracle()
