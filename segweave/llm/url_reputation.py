"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good: 1, bad: 0) are counted per host, ports and user names left out. Bad rates are shrunk through
beta-binomial priors from host to registered domain to suffix: each level's prior has the posterior mean of the level above
and a strength fitted by moments. A host's posterior is a beta distribution; the host is blocked if its quantile at TAIL,
the lower bound of its bad rate, lies above a threshold, that is if less than TAIL of the posterior lies below it.
Only counts per host are shuffled before the verdicts join the pages; a hot host is one row after the map side, and its
pages meet it in a join of plain tables, which adaptive execution splits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.mx", "co.za"]

#: (action, host, path) of the rules that the query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Share of a posterior that lies below its lower bound.
TAIL = 0.05

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    hit = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(hit)
    return hit


def bare_host(host: Column) -> Column:
    """A url's host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def beta_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of each beta distribution that lies below x, by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    front = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x) for p, q in zip(a, b, strict=True)])
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(p), 1 / safe(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 10_000):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    share = np.exp(front) * h / p
    return np.where(swap, 1 - share, share)


def _below(threshold: float):
    @F.pandas_udf("double")
    def below(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_below(threshold, a.to_numpy(), b.to_numpy()))

    return below


def with_levels(df: DataFrame) -> DataFrame:
    """Adds suffix and domain (registered) of the column host."""
    labels = F.split(F.regexp_replace("host", r"\.$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    two = last(2).isin(TWO_LABEL_SUFFIXES)
    return df.withColumn("suffix", F.when(two, last(2)).otherwise(last(1))).withColumn("domain", F.when(two, last(3)).otherwise(last(2)))


def _strength(units: DataFrame, by: list[str], floor: float, ceil: float) -> DataFrame:
    """Prior strength of a level by moments: 1/rho - 1 of the intra-unit correlation of units with n labels and k bad ones."""
    n, k = F.col("n"), F.col("k")
    m = units.where("n > 0").groupBy(*by).agg(
        F.count("*").alias("units"), F.sum(n).alias("sn"), F.sum(k).alias("sk"),
        F.sum(n * n).alias("sn2"), F.sum(k * k / n).alias("skn"))
    # try_divide: where a quotient has no sense the level has no spread
    between = F.try_divide(F.col("skn") - F.try_divide(F.col("sk") * F.col("sk"), F.col("sn")), F.col("units") - 1)
    within = F.try_divide(F.col("sk") - F.col("skn"), F.col("sn") - F.col("units"))
    n0 = F.try_divide(F.col("sn") - F.try_divide(F.col("sn2"), F.col("sn")), F.col("units") - 1)
    rho = F.try_divide(between - within, between + (n0 - 1) * within)
    ok = (F.col("units") > 1) & (F.col("sn") > F.col("units")) & (F.col("sk") > 0) & (F.col("sk") < F.col("sn"))
    return m.select(*by, F.when(ok, F.least(F.greatest(F.try_divide(F.lit(1.0), rho) - 1, F.lit(floor)), F.lit(ceil))).otherwise(F.lit(ceil)).alias("s0"), F.when(ok & (rho > 0), F.lit(True)).otherwise(F.lit(False)).alias("spread"))


def host_reputation(outcomes: DataFrame, floor: float = 1.0, ceil: float = 200.0) -> DataFrame:
    """host, n, k, a, b, mean for each host of outcomes(host, good); good null: an unlabelled page, which only names the host.

    The host's bad rate has the posterior beta(a, b).

    Where labels show no spread between units, the strength is ceil: hosts then keep close to their domain's rate.
    """
    bad = F.when(F.col("good") == 0, 1).when(F.col("good") == 1, 0)
    counted = outcomes.groupBy("host").agg(F.count(bad).cast("double").alias("n"), F.coalesce(F.sum(bad), F.lit(0)).cast("double").alias("k"))
    hosts = Scratch(outcomes.sparkSession).write(with_levels(counted))  # read by every level
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("tn"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("tk"))
    strength = lambda units, name: _strength(units, [], floor, ceil).select(F.when(F.col("spread"), F.col("s0")).otherwise(F.lit(ceil)).alias(name))
    # One row of four numbers: the labelled rate of all pages and a strength for each level.
    top = total.crossJoin(strength(suffixes, "s_suffix")).crossJoin(strength(domains, "s_domain")).crossJoin(strength(hosts, "s_host"))
    rate = lambda k, n, mean, s: (k + mean * s) / (n + s)
    every = (F.col("tk") + 1) / (F.col("tn") + 2)
    suffix_mean = suffixes.crossJoin(F.broadcast(top)).select("suffix", rate(F.col("k"), F.col("n"), every, F.col("s_suffix")).alias("suffix_mean"), "s_domain", "s_host")
    domain_mean = domains.join(suffix_mean, "suffix").select("domain", "suffix", rate(F.col("k"), F.col("n"), F.col("suffix_mean"), F.col("s_domain")).alias("domain_mean"), "s_host")
    a = F.col("k") + F.col("domain_mean") * F.col("s_host")
    total = F.col("n") + F.col("s_host")
    return hosts.join(domain_mean, ["suffix", "domain"]).select("host", "n", "k", a.alias("a"), (total - a).alias("b"), (a / total).alias("mean"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = 0.5, tail: float = TAIL) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate (the posterior mean of the host's) for each row of pages.

    labels(doc_id, quality): the outcome of the page of that id; several outcomes of one id count by their minimum.
    Null urls have empty host and path and take the verdict of the method; repeated rows stay repeated.
    """
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("bare", bare_host(F.col("host")))
    outcome = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("good"))
    reputation = host_reputation(seen.select("page_id", F.col("bare").alias("host")).join(outcome, "page_id", "left").select("host", "good"))
    judged_hosts = reputation.select(F.col("host").alias("bare"), F.round("mean", 6).alias("bad_rate"), (_below(threshold)("a", "b") < tail).alias("bad"))
    judged_hosts = Scratch(pages.sparkSession).write(judged_hosts)
    hit = matching_rule(F.col("host"), F.col("path"), rules)
    judged = seen.withColumn("hit", hit).join(judged_hosts, "bare", "left")
    verdict = F.coalesce(F.col("hit.action"), F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "bad_rate")
