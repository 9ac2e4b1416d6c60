"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (blocked or not) are totalled per host, registered domain and suffix. How much
the units of one level differ is estimated from the data by the method of moments of the beta-binomial
distribution; that gives the strength of the prior with which a host is shrunk towards its domain, a
domain towards its suffix, and a suffix towards the whole. A page without a rule is blocked if the
posterior bound of its host's rate of blocked pages, mean less ``z`` standard deviations, exceeds
``block_above``. A unit without outcomes has its parent's mean and the prior's width.

Defined cases: a null url, or one without ``://``, has an empty host and path, which is a host of its
own without a domain; repeated rows count as often as they occur; without any outcome every page
without a rule is allowed; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.frames import lower_ascii

ALLOW, BLOCK = "allow", "block"

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "ne.jp", "com.au", "net.au", "org.au", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr"]


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, if the path starts with the rule's path."""

    site: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.site.partition("/")
        here = (host == name) | host.endswith(f".{name}")
        return here & path.startswith(f"/{rest}")


@dataclass(frozen=True)
class Reputation:
    z: float = 1.0
    block_above: float = 0.5
    min_strength: float = 1.0
    max_strength: float = 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The part under which names are registered; for a one-label host the host itself."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def with_rule(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``pages`` plus ``host``, ``path`` and the longest ``rule`` that fits with its ``rule_verdict``."""
    url = F.col(f"`{url_col}`")
    host, path = host_of(url), path_of(url)
    by_length = sorted(rules, key=lambda rule: (-len(rule.site), rule.site))
    site, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(by_length):
        fits = rule.fits(F.col("host"), F.col("path"))
        site = F.when(fits, rule.site).otherwise(site)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    kept = [F.col(f"`{name}`") for name in pages.columns if name not in ("host", "path", "rule", "rule_verdict")]
    placed = pages.select(*kept, host.alias("host"), path.alias("path"))
    return placed.select("*", site.alias("rule"), verdict.alias("rule_verdict"))


def _strength(settings: Reputation) -> Column:
    """Prior strength from the spread of the rates of one level's units.

    Reads the level's sums: n and k of outcomes, s of k*k/n, n2 of n*n, and i units.
    """
    n, k, s, n2, i = (F.col(name) for name in ("n", "k", "s", "n2", "i"))
    rate = k / n
    inside = rate * (1 - rate)
    spread = (s - k * k / n) - inside * (i - 1)
    rho = spread / (inside * (n - n2 / n - (i - 1)))
    strength = 1 / rho - 1
    low, high = F.lit(settings.min_strength), F.lit(settings.max_strength)
    usable = (inside > 0) & (n - n2 / n - (i - 1) > 0)
    return F.when(~usable, low).when(spread <= 0, high).otherwise(F.greatest(low, F.least(high, strength)))


def strengths(outcomes: DataFrame, settings: Reputation = Reputation()) -> dict[str, float]:
    """Overall rate and the prior strengths per level: one small row per level reaches the driver."""
    found = {"rate": 0.0}
    for level in ("suffix", "domain", "host"):
        units = outcomes.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        n, k = F.col("n").cast("double"), F.col("k").cast("double")
        row = (
            units.agg(
                F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("s"), F.sum(n * n).alias("n2"),
                F.count("*").cast("double").alias("i"),
            )
            .select((F.col("k") / F.col("n")).alias("rate"), _strength(settings).alias("strength"))
            .first()
        )
        found["rate"] = row["rate"] if row["rate"] is not None else 0.0
        found[level] = row["strength"] if row["rate"] is not None else settings.min_strength
    return found


def host_totals(outcomes: DataFrame) -> DataFrame:
    """Outcomes (host, blocked) totalled per host, with the domain and suffix of each."""
    totals = outcomes.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("blocked").cast("bigint")).alias("k")
    )
    return totals.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k")


def reputations(hosts: DataFrame, totals: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """For each distinct host: ``rate`` and ``bound``, shrunk host to domain to suffix to whole."""
    prior = strengths(totals, settings)

    def shrunk(n: Column, k: Column, level: str, parent: Column) -> Column:
        s = F.lit(prior[level])
        return (F.coalesce(k, F.lit(0)) + s * parent) / (F.coalesce(n, F.lit(0)) + s)

    named = hosts.select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")
    )
    joined = named.join(totals.select("host", F.col("n").alias("_hn"), F.col("k").alias("_hk")), "host", "left")
    for level, short in (("domain", "d"), ("suffix", "s")):
        units = totals.groupBy(level).agg(F.sum("n").alias(f"_{short}n"), F.sum("k").alias(f"_{short}k"))
        joined = joined.join(units, level, "left")
    suffix = shrunk(F.col("_sn"), F.col("_sk"), "suffix", F.lit(prior["rate"]))
    domain = shrunk(F.col("_dn"), F.col("_dk"), "domain", F.col("_suffix_rate"))
    rate = shrunk(F.col("_hn"), F.col("_hk"), "host", F.col("_domain_rate"))
    size = F.coalesce(F.col("_hn"), F.lit(0)) + F.lit(prior["host"])
    width = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return (
        joined.withColumn("_suffix_rate", suffix)
        .withColumn("_domain_rate", domain)
        .withColumn("rate", rate)
        .select("host", "rate", (F.col("rate") - settings.z * width).alias("bound"))
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule], outcomes: DataFrame | None = None, url_col: str = "url",
    settings: Reputation = Reputation(),
) -> DataFrame:
    """``pages`` plus host, path, rule, verdict, rate and bound.

    ``outcomes`` holds (host, blocked) per labelled page; without it, the pages that a rule judges are
    the labelled ones.
    """
    ruled = with_rule(pages, rules, url_col)
    if outcomes is None:
        known = ruled.where(F.col("rule").isNotNull())
        outcomes = known.select("host", (F.col("rule_verdict") == BLOCK).alias("blocked"))
    known = reputations(ruled.select("host").distinct(), host_totals(outcomes), settings)
    method = F.when(F.col("bound") > settings.block_above, BLOCK).otherwise(ALLOW)
    return (
        ruled.join(known, "host", "left")
        .withColumn("verdict", F.coalesce("rule_verdict", method))
        .drop("rule_verdict")
    )
