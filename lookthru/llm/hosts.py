"""URL filter: rules, and beside them the empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host. Rates are drawn towards the level above, from suffix to registered domain
to host: at each level the children's rates give a beta prior (mean and strength by moments), and a child's
posterior is that prior with its own counts added. A host whose bad rate is above ``BAD_RATE`` even at the lower
posterior bound is blocked; a host without labels takes the posterior of its domain, that one of its suffix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BAD_RATE = 0.5
CONFIDENCE = 0.95
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: Second-level suffixes: fixed values, common public ones.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the start of the path, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    """The last label, or the last two where they are like co.uk; an address of digits is its own suffix."""
    second = r"(?:^|\.)((?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2})$"
    last = F.regexp_extract(host, r"([^.]*)$", 1)
    return F.when(host.rlike(r"^[0-9.]+$|:"), host).when(host.rlike(second), F.regexp_extract(host, second, 1)).otherwise(last)


def registered(host: Column, suffix_: Column) -> Column:
    """The suffix and the label before it; the host itself if there is none."""
    rest = F.expr("substring(host, 1, length(host) - length(suffix) - 1)")
    label = F.regexp_extract(rest, r"([^.]*)$", 1)
    return F.when((host == suffix_) | (label == ""), host).otherwise(F.concat(label, F.lit("."), suffix_))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    import math

    gamma = np.frompyfunc(math.lgamma, 1, 1)
    return (gamma(a) + gamma(b) - gamma(a + b)).astype(float)


def _beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) / p
    out = np.clip(front * h, 0, 1)
    return np.where(turn, 1 - out, out)


def lower_bound(a: np.ndarray, b: np.ndarray, confidence: float = CONFIDENCE) -> np.ndarray:
    """The value that a beta variable exceeds with the given probability."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (low + high) / 2
        below = _beta_cdf(mid, a, b) < 1 - confidence
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


def _strength(counts: DataFrame, parent: str) -> DataFrame:
    """Strength of the beta prior that the children of each parent share: from their spread beyond binomial noise."""
    rate, n = F.col("bad") / F.col("n"), F.col("n")
    sums = counts.filter("n > 0").groupBy(parent).agg(
        F.sum("n").alias("tn"), F.sum("bad").alias("tb"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), F.sum(n * rate * rate).alias("rr"))
    mean = F.col("tb") / F.col("tn")
    noise = mean * (1 - mean)
    spread = F.col("rr") - F.col("tn") * mean * mean                     # weighted squares about the mean
    weight = F.col("tn") - F.col("nn") / F.col("tn")
    between = F.when((F.col("k") > 1) & (weight > 0), (spread - (F.col("k") - 1) * noise) / weight)
    strength = F.when(between > 0, noise / between - 1).otherwise(F.lit(MOST_STRENGTH))
    return sums.select(parent, F.greatest(F.least(F.coalesce(strength, F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)).alias("strength"))


def _level(children: DataFrame, parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Posterior (a, b) of each child: its counts on top of the parent's mean at the strength its children share."""
    prior = parents.join(_strength(children, parent), parent, "left").select(
        parent, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), F.coalesce("strength", F.lit(LEAST_STRENGTH)).alias("strength"))
    joined = children.join(prior, parent)
    return joined.select(child, parent, (F.col("mean") * F.col("strength") + F.col("bad")).alias("a"),
                         ((1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("bad")).alias("b"))


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, a, b, bound) of each host from (host, suffix, domain, n, bad): posterior and its lower bound."""
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("root", F.lit(1))
    root = suffixes.groupBy("root").agg((F.sum("bad") + 1.0).alias("a"), (F.sum("n") - F.sum("bad") + 1.0).alias("b"))
    of_suffix = _level(suffixes, root, "suffix", "root")
    of_domain = _level(domains, of_suffix.drop("root"), "domain", "suffix")
    of_host = _level(hosts.select("host", "domain", "n", "bad"), of_domain.drop("suffix"), "host", "domain")

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(lower_bound(a.to_numpy(), b.to_numpy()))

    return of_host.select("host", "a", "b", bound("a", "b").alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, id_column: str = "page_id", url_column: str = "url",
          outcome_id: str = "page_id", bad_column: str = "bad", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null where none fits), verdict, bound.

    ``outcomes`` has an id and bad (true or 1 for a bad page; null counts as unlabelled). Several outcomes of a page
    all count. A null url, or one without ://, has an empty host and path, fits no rule and is judged like a
    host. Repeated pages each give a row; with no labelled page at all the method allows. Empty tables give empty tables.
    """
    parsed = pages.select(F.col(id_column).alias("id"), url_host(F.col(url_column)).alias("host"), url_path(F.col(url_column)).alias("path"))
    labels = outcomes.select(F.col(outcome_id).alias("oid"), F.col(bad_column).cast("int").alias("bad")).filter("bad is not null and oid is not null")
    per_page = labels.groupBy("oid").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = (parsed.join(per_page, F.col("id") == F.col("oid"), "left").groupBy("host")
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    counts = counts.withColumn("suffix", suffix(F.col("host"))).withColumn("domain", registered(F.col("host"), F.col("suffix")))
    found = reputation(counts).select("host", "bound")
    return (parsed.join(found, "host", "left").withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
            .select("id", "host", "path", F.col("m.rule").alias("rule"),
                    F.coalesce("m.verdict", F.when(F.col("bound") > BAD_RATE, "block").otherwise("allow")).alias("verdict"), "bound"))


def op3_hosts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages are the labels of the same number: quality 0 is bad."""
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(pages, outcomes).withColumnRenamed("id", "page_id").withColumn("bound", F.round("bound", 6))
