"""URL verdicts from rules and from host reputation.

Labelled outcomes of pages (good or bad) are counted per host, registered domain and suffix. The
rate of bad pages of a suffix is shrunk towards that of all pages, a domain's towards its suffix's
and a host's towards its domain's, each by a beta prior whose strength is estimated from how much
the rates of that level vary beyond binomial chance. A host is blocked when a lower bound of its
posterior rate lies above the limit. Hosts without labelled pages rest on their domain.

Counts are taken per host first; domains and suffixes sum up hosts. Pages are joined with blocked
hosts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.staging import stage
from cohortry.llm.native import fold_ascii

#: Bad rate that a host may have.
LIMIT = 0.5
#: Standard deviations below the posterior mean at which the bound lies.
DEVIATIONS = 1.0
#: Range of a prior's strength, in pages.
STRENGTH = (1.0, 1000.0)
# Suffixes of two labels below which domains are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "org.uk"]

Rules = list[tuple[str, str]]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return fold_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. `rules` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels of a host without user and port, three below a two-label suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    """What follows the first dot of a registered domain; of a single label, the label."""
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _strength(groups: DataFrame) -> DataFrame:
    """One row: strength of the prior of groups with n pages, k of them bad, by moments."""
    totals = groups.filter("n > 0").agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kkn"),
    )
    rate = F.try_divide(F.col("k").cast("double"), F.col("n"))
    binomial = rate * (1 - rate)
    spread = F.col("kkn") - F.col("n") * rate * rate
    free = F.col("g") - 1
    share = F.try_divide(
        spread - binomial * free, binomial * (F.col("n") - F.col("nn") / F.col("n") - free)
    )
    low, high = STRENGTH
    between = F.least(F.greatest(F.try_divide(1 - share, share), F.lit(low)), F.lit(high))
    return totals.select(F.when(share > 0, between).otherwise(high).alias("strength"))


def _shrunk(groups: DataFrame, key: str, above: DataFrame, parent: str) -> DataFrame:
    """Groups with the prior rate of their parent and their own posterior rate."""
    strength = _strength(groups).first()["strength"]
    return (
        groups.join(above.select(F.col(key).alias(parent), F.col("rate").alias("prior")), parent, "left")
        .withColumn("strength", F.lit(strength))
        .withColumn(
            "rate",
            (F.col("strength") * F.col("prior") + F.col("k")) / (F.col("strength") + F.col("n")),
        )
    )


def reputation(hosts: DataFrame) -> DataFrame:
    """(host, n, k, rate, bound) from (host, n, k): labelled pages of each host, and bad ones."""
    named = stage(
        hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn(
            "suffix", suffix_of(F.col("domain"))
        ),
        "hosts",
    )
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = named.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("rate")).first()["rate"]
    top = suffixes.select("suffix", F.lit(overall).alias("rate"))
    of_suffix = _shrunk(suffixes, "suffix", top, "suffix")
    of_domain = _shrunk(domains, "suffix", of_suffix, "suffix")
    of_host = _shrunk(named, "domain", of_domain, "domain")
    weight = F.col("strength") + F.col("n")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return of_host.select(
        "host", "n", "k", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("bound")
    )


def url_verdicts(
    pages: DataFrame, outcomes: DataFrame, rules: Rules, limit: float = LIMIT
) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule and verdict (allow or block).

    `outcomes` has page_id and bad (boolean); a page is bad if any of its outcomes is. Urls that are
    null or without :// have an empty host and path; they share the reputation of the empty host.
    Pages without id have no outcome. Repeated pages count each time in the reputation, and keep
    their rows. Without outcomes every rate is even, and so above the limit only by its bound: no
    page is blocked but by rules. Other columns of the inputs are not read.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = (
        outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull())
        .groupBy("page_id")
        .agg(F.max("bad").alias("bad"))
    )
    hosts = (
        parsed.join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    )
    blocked = stage(reputation(hosts).filter(F.col("bound") > limit).select("host"), "blocked")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(blocked.withColumn("bad_host", F.lit(True)), "host", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
    )
