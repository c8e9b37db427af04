"""Operator 5, URL filters by empirical-Bayes host reputation.

Page outcomes (good or bad) are counted by host, registered domain and suffix.
Each level's good rate is a beta-binomial whose prior is the posterior of the
level above; the strength of each prior is fitted to how much the groups of the
level differ.  A host without outcomes inherits its domain's rate, and so on up.
A url is blocked where even the upper bound of its host's rate is low, unless a
rule for its host and path says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules (host and path start, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A url is blocked where its host's good rate is below this with the certainty of BOUND_SD standard deviations.
LEAST_GOOD = 0.5
BOUND_SD = 1.645
#: Strength of a prior, in pages, where the groups of a level are too few or too even to tell.
PRIOR_PAGES = 20.0
MOST_PRIOR_PAGES = 1e6
#: Second-level labels below which a domain is registered one label deeper (fixed values).
SHARED_SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Public suffix by shape: the last label, or the last two where the second is a shared one below a country's."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    return F.when((F.length(last) == 2) & second.isin(*SHARED_SECOND_LEVELS), F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """Suffix and the label before it; the suffix alone where no label is before it."""
    bare, suffix = F.regexp_replace(host, r":\d*$", ""), suffix_of(host)
    before = F.substring_index(F.left(bare, F.greatest(F.length(bare) - F.length(suffix) - 1, F.lit(0))), ".", -1)
    return F.when(before != "", F.concat_ws(".", before, suffix)).otherwise(suffix)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path the url's path begins with; else null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _strength(groups: DataFrame) -> float:
    """Prior pages by moments: how much more the groups' rates differ from their priors' means than chance makes them.

    ``groups`` has n, good and mean (the prior's).  Only four sums reach the driver.
    """
    p = F.col("mean")
    spread = F.pow(F.col("good") - F.col("n") * p, 2)
    chance = F.col("n") * p * (1 - p)
    x = groups.where("n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum(spread).alias("spread"), F.sum(chance).alias("chance"), F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("pairs")).first()
    if x["k"] < 3 or not x["pairs"]:
        return PRIOR_PAGES
    # For a beta-binomial, E spread = chance + pairs * rho, with rho = 1 / (pages + 1).
    rho = (x["spread"] - x["chance"]) / x["pairs"]
    return MOST_PRIOR_PAGES if rho <= 1 / (MOST_PRIOR_PAGES + 1) else max(1 / min(rho, 0.99) - 1, 0.01)


def reputations(outcomes: DataFrame) -> DataFrame:
    """From host, good (1 or 0, null where unlabelled): host, domain, suffix, n, alpha and beta of the host's good rate.

    Hosts are pre-aggregated before any shuffle; the joins go by domain and suffix of distinct hosts only.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    up = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    all_n, all_good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    overall = ((all_good or 0) + 0.5) / ((all_n or 0) + 1.0)

    def shrunk(groups: DataFrame) -> DataFrame:
        pages = _strength(groups)
        return groups.withColumn("alpha", F.lit(pages) * F.col("mean") + F.col("good")).withColumn("beta", F.lit(pages) * (1 - F.col("mean")) + F.col("n") - F.col("good"))

    rate = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")
    by_suffix = shrunk(suffixes.withColumn("mean", F.lit(overall)))
    by_domain = shrunk(domains.join(by_suffix.select("suffix", rate), "suffix"))
    return shrunk(hosts.join(by_domain.select("domain", "suffix", rate), ["domain", "suffix"])).select("host", "domain", "suffix", "n", "alpha", "beta")


def judge(pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", outcome_id: str = "doc_id", outcome: str = "quality", rules: Sequence[tuple[str, str]] = RULES, least_good: float = LEAST_GOOD, bound_sd: float = BOUND_SD) -> DataFrame:
    """A verdict for every row of ``pages``: page_id, host, path, rule, verdict, good_rate, upper_bound.

    ``outcomes`` labels some pages by id (1 good, 0 bad; null and other values
    are no outcome, several rows for an id count as their mean, rounded).

    A null url and one without ``://`` have an empty host and path and are judged
    like any other host, the empty one.  A null id is kept and has no outcome.
    Repeated rows are judged each for itself.  An empty table gives an empty
    result; without outcomes every rate is one half.  Other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labels = outcomes.where(F.col(outcome).isin(0, 1) & F.col(outcome_id).isNotNull()).groupBy(F.col(outcome_id).cast("long").alias("page_id")).agg(F.round(F.avg(outcome)).cast("int").alias("good"))
    rates = reputations(rows.select("page_id", "host").join(labels, "page_id", "left"))
    a, b = F.col("alpha"), F.col("beta")
    mean, sd = a / (a + b), F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    rates = rates.select("host", mean.alias("good_rate"), (mean + F.lit(bound_sd) * sd).alias("upper_bound"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("rule")) if rules else F.lit(None).cast("string")
    return (
        rows.join(rates, "host")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("upper_bound") < least_good, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "good_rate", "upper_bound")
    )
