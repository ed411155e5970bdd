"""URL filters: rules first, then empirical-Bayes host reputation from labelled page outcomes.

Outcomes are shrunk through beta-binomial priors: all pages -> suffix -> registered domain -> host. Each level's
concentration is estimated from its children by moments. A host is blocked when the lower posterior bound of its
share of bad pages is above a threshold. Only DataFrame functions; host counts are combined before the shuffle, and
the saved host table is joined back, so that Spark may broadcast it or split a hot host.

Edge cases: a null url, or one without `://`, has an empty host and path and is judged by the empty host's outcomes;
null outcomes are not counted; hosts without outcomes take their domain's prior; no outcomes at all allow everything;
repeated rows are judged each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 10_000.0
THRESHOLD, Z = 0.035, 1.0

#: (verdict, rule): the rule's host and the start of the url's path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels. (No suffix list is used; the suffix is the last label.)"""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _concentration(children: DataFrame, parent: str) -> DataFrame:
    """One row: how strongly children (n, bad) keep to their parents' means, alpha + beta of the beta prior."""
    by = children.groupBy(parent).agg(F.sum("n").alias("np"), F.sum("bad").alias("bp"), F.count("*").alias("c"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    m = F.col("bp") / F.col("np")
    own = m * (1 - m)
    sums = by.agg(F.sum(F.col("q") - F.col("bp") * m).alias("a"), F.sum((F.col("c") - 1) * own).alias("b"), F.sum(own * (F.col("np") - F.col("nn") / F.col("np") - (F.col("c") - 1))).alias("d"))
    rho = (F.col("a") - F.col("b")) / F.col("d")
    return sums.select(F.when((F.col("d") > 0) & (F.col("a") > F.col("b")), F.least(F.greatest((1 - rho) / rho, F.lit(1.0)), F.lit(MOST))).otherwise(F.lit(MOST)).alias("k"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound_sd) of each host of outcomes (host, bad in 0/1)."""
    hosts = outcomes.where("bad IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    hosts = save(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("every", F.lit(0))
    # One row of three concentrations and the mean of all: numbers, not data, so they go into the plan as such.
    k_host, k_domain, k_suffix = (_concentration(t, p).first()["k"] for t, p in ((hosts, "domain"), (domains, "suffix"), (suffixes, "every")))
    total = suffixes.agg(*sums).first()
    mean = total["bad"] / total["n"] if total["n"] else 0.0
    s = suffixes.select("suffix", ((F.col("bad") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("m_suffix"))
    d = domains.join(s, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("m_suffix")) / (F.col("n") + k_domain)).alias("m_domain"))
    a = F.col("bad") + k_host * F.col("m_domain")
    b = F.col("n") - F.col("bad") + k_host * (1 - F.col("m_domain"))
    return save(hosts.join(save(d), "domain").select("host", "n", "bad", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict; outcomes (host, bad) are the labelled pages."""
    known = reputations(outcomes).select("host", F.when(F.col("mean") - z * F.col("sd") > threshold, "block").otherwise("allow").alias("by_host"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    joined = rows.join(known, "host", "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "by_host", F.lit("allow")).alias("verdict"))
