"""URL filters: rules by host and path, and host reputation by empirical Bayes.

Labelled outcomes of pages are counted by host. A host's share of bad pages is
shrunk to its registered domain's, that to its suffix's, and that to the whole:
each level's mean is the prior mean of the next, with a weight (in pages) found
by the method of moments from how much the children differ. A host is blocked
when the lower bound of its posterior share is above the limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import lowered, text_of
from corpuslens.operators.storage import materialised

LIMIT = 0.5
LOW_SHARE = 0.05  # of the posterior lies below its lower bound
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0
HOSTS_SENT = 20_000  # rows of a host table, some hundred bytes each, that are broadcast
# Some suffixes of more than one label, for callers without a table of public suffixes.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tails(host: Column) -> Column:
    """A host and all that follows one of its dots."""
    steps = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps) - i + 1), "."))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``suffix`` and registered ``domain`` (the suffix and one label more) to rows with ``host``.

    ``suffixes`` is a table of public suffixes, column ``suffix``; of those that end a
    host the longest counts, and where none does the last label. A host that is a
    suffix itself is its own domain. Nulls and repeats in the table change nothing.
    """
    if suffixes is None:
        suffixes = hosts.sparkSession.createDataFrame([(s,) for s in LONG_SUFFIXES], "suffix string")
    known = suffixes.where(F.col("suffix").isNotNull()).select(lowered(F.col("suffix")).alias("tail")).distinct()
    names = hosts.select("host").distinct()
    few = known.count() <= HOSTS_SENT
    longest = (
        names.select("host", F.explode(_tails(F.col("host"))).alias("tail"))
        .join(F.broadcast(known) if few else known, "tail")
        .groupBy(F.col("host").alias("_host")).agg(F.max_by("tail", F.length("tail")).alias("_tail"))
    )
    suffix = F.coalesce("_tail", F.substring_index("host", ".", -1))
    labels = F.size(F.split("suffix", r"\.", -1)) + 1
    return (
        hosts.join(longest, F.col("host") == F.col("_host"), "left")
        .withColumn("suffix", suffix)
        .withColumn("domain", F.when(F.col("host") == F.col("suffix"), F.col("host")).otherwise(
            F.array_join(F.slice(F.split("host", r"\.", -1), F.greatest(F.lit(1), F.size(F.split("host", r"\.", -1)) - labels + 1), labels), ".")
        ))
        .drop("_host", "_tail")
    )


def _beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of a beta distribution lies below ``x``: its continued fraction, from the side where it is short."""
    gamma = np.vectorize(math.lgamma, otypes=[float])
    turned = x > (a + 1) / (a + b + 2)
    p, q, at = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    at = np.clip(at, 1e-300, 1 - 1e-16)
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(at) + q * np.log1p(-at)) / p
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    upper, lower = np.ones_like(at), 1 / safe(1 - (p + q) * at / (p + 1))
    total = lower.copy()
    for m in range(1, 400):
        even = m * (q - m) * at / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * at / ((p + 2 * m) * (p + 2 * m + 1))
        before = total.copy()
        for term in (even, odd):
            lower = 1 / safe(1 + term * lower)
            upper = safe(1 + term / upper)
            total = total * lower * upper
        if np.allclose(total, before, rtol=1e-13, atol=0):
            break
    return np.where(turned, 1 - front * total, front * total)


def beta_low(a: np.ndarray, b: np.ndarray, share: float = LOW_SHARE) -> np.ndarray:
    """The value below which ``share`` of the beta distribution lies, by halving."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60 if len(a) else 0):
        middle = (low + high) / 2
        under = _beta_share(middle, a, b) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low


def _with_low(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low = beta_low(batch["a"].to_numpy(float), batch["b"].to_numpy(float))
            yield batch[["host", "mean"]].assign(low=low)

    return rows.select("host", "mean", "a", "b").mapInPandas(run, "host string, mean double, low double")


def _weight() -> Column:
    """Pages that a prior counts for: p(1-p) over what the children differ by, less one.

    The spread of the children's shares has a part that chance alone gives, which
    is taken off. The moments are pooled over the level.
    """
    n = F.sum("n")
    p = F.try_divide(F.sum("bad"), n)
    between = F.try_divide(F.sum(F.col("n") * F.when(F.col("n") > 0, F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0))).otherwise(0.0)), n)
    chance = F.try_divide(F.sum(F.when(F.col("n") > 0, F.col("prior") * (1 - F.col("prior"))).otherwise(0.0)), n)
    excess = F.greatest(between - chance, F.lit(1e-9))
    return F.when(n == 0, F.lit(LEAST_WEIGHT)).otherwise(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), p * (1 - p) / excess - 1))).alias("weight")


def _level(rows: DataFrame, parents: DataFrame, up: str | None = None) -> DataFrame:
    """Posterior means of a level, ``mean``, with ``a`` and ``b``, given its parents' means.

    The weight of the level is one number; without ``up`` so is the mean above it.
    """
    if up:
        few = parents.count() <= HOSTS_SENT
        rows = rows.join(F.broadcast(parents) if few else parents, up)
    else:
        rows = rows.withColumn("parent_mean", F.lit(parents.first()[0]))
    with_prior = rows.withColumn("prior", F.col("parent_mean"))
    weight = F.lit(with_prior.agg(_weight()).first()[0] or LEAST_WEIGHT)
    a = F.col("bad") + weight * F.col("prior")
    b = F.col("n") - F.col("bad") + weight * (1 - F.col("prior"))
    return with_prior.withColumns({"a": a, "b": b}).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """The posterior of every host: ``host``, ``mean``, ``low``.

    ``outcomes`` has ``host`` and ``bad`` (0 or 1), a row for each labelled page;
    null outcomes are left out. ``hosts`` lists the hosts to be judged, once
    each; ``suffixes`` as for :func:`with_domains`. ``low`` is the value that the
    share of bad pages is above with 95 % of its beta posterior. A host without
    outcomes has its domain's posterior as its prior, and so on upwards; without any
    outcome at all every mean is a half, and no bound is above it. An empty table of
    hosts gives no rows. The hosts are counted before they are shuffled, so a host
    with a third of all pages is one row.
    """
    counted = outcomes.where("bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad")
    )
    spread = materialised(
        with_domains(hosts.select("host"), suffixes).join(counted, "host", "left").select(
            "host",
            "domain",
            "suffix",
            F.coalesce("n", F.lit(0)).cast("double").alias("n"),
            F.coalesce("bad", F.lit(0)).cast("double").alias("bad"),
        )
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialised(spread.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 1.0)).alias("parent_mean"))
    by_suffix = materialised(_level(suffixes, whole).select("suffix", F.col("mean").alias("parent_mean")))
    by_domain = materialised(_level(domains, by_suffix, "suffix").select("domain", F.col("mean").alias("parent_mean")))
    by_host = _level(spread, by_domain, "domain")
    return _with_low(by_host)


def judge_urls(
    pages: DataFrame, rules: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None, limit: float = LIMIT
) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``low``.

    Needs ``page_id`` and ``url``. ``rules`` has ``host``, ``path``, ``verdict``;
    ``outcomes`` has ``url`` and ``bad``. A rule fits its host and all its
    subdomains if the path starts with the rule's; the longest rule wins, of
    equal ones the first in the alphabet. Without a rule the verdict is the
    reputation's. A null url, or one without ``://``, has an empty host and path
    and is judged as the host ''. Repeated rows are judged each, alike.
    """
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = materialised(located.groupBy("host").agg(F.count("*").alias("pages")))
    labels = outcomes.select(host_of(F.col("url")).alias("host"), "bad")
    known = reputation(labels, hosts, suffixes)
    # Rules reach a host by way of its suffixes; those of one host are a short list.
    r = rules.select(
        F.col("host").alias("tail"),
        F.struct(
            (-F.length(F.concat("host", "path"))).alias("short"), F.concat("host", "path").alias("rule"),
            F.col("path").alias("path"), F.col("verdict").alias("verdict"),
        ).alias("r"),
    )
    few = r.count() <= HOSTS_SENT
    fitting = (
        hosts.select("host", F.explode(_tails(F.col("host"))).alias("tail"))
        .join(F.broadcast(r) if few else r, "tail")
        .groupBy("host").agg(F.sort_array(F.collect_list("r")).alias("rules"))
    )
    judged = materialised(known.join(fitting, "host", "left").select("host", "low", "rules"))
    side = judged if judged.count() > HOSTS_SENT else F.broadcast(judged)
    best = F.get(F.filter("rules", lambda x: F.col("path").startswith(x["path"])), F.lit(0))
    return (
        located.join(side, "host", "left")
        .withColumn("best", best)
        .select(
            "page_id", "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
            "low",
        )
    )
