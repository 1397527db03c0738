"""URL filter: fixed rules, then the reputation of the host by empirical Bayes.

Labelled pages of a host, of its registered domain and of its suffix are counted. Each level
gets a beta prior around the rate of the level above, as strong as the spread of the rates on
that level suggests (method of moments of the beta-binomial). A host is blocked if the lower
bound of its posterior rate of bad pages is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from migraspark.llm.common import kept_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """A verdict for a host with its subdomains and a prefix of the path."""

    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

# The suffixes of more than one label that the default knows; others are the last label. A table
# (suffix string) in the notation of the public suffix list can take their place.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
LIMIT = 0.5
DEVIATIONS = 1.645
WEAKEST, STRONGEST = 0.001, 0.999


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, NULL if none does: one CASE expression."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: len(r.host + r.path))
    for rule in ordered:  # each wraps the shorter ones
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


def with_domain(hosts: DataFrame, suffixes: DataFrame | Sequence[str] = SUFFIXES) -> DataFrame:
    """``hosts`` (host, ...) with their registered domain and public suffix; ports do not count.

    The longest fitting rule gives the suffix: "co.nz" fits its hosts, "*.ck" takes any label in
    place of the star, and "!www.ck" exempts from it. Without one it is the last label. The domain
    is the suffix and one label more.
    """
    if not isinstance(suffixes, DataFrame):
        listed = F.array(*[F.lit(s) for s in suffixes]).cast("array<string>")
        suffixes = hosts.sparkSession.range(1).select(F.explode(listed).alias("suffix"))
    rules = suffixes.select(F.translate(F.trim("suffix"), UPPER, LOWER).alias("rule")).distinct()
    named = hosts.withColumn("name", F.regexp_replace("host", ":[0-9]*$", ""))
    tails = named.selectExpr("host", "name", "explode(sequence(1, size(split(name, '[.]')))) AS k")
    fitting = tails.select(
        "host",
        F.inline(
            F.expr(
                "array(struct(substring_index(name, '.', -k) AS rule, 0 AS exempt, k AS labels), "
                "struct(concat('*.', substring_index(name, '.', 1 - k)) AS rule, 0 AS exempt, k AS labels), "
                "struct(concat('!', substring_index(name, '.', -k)) AS rule, 1 AS exempt, k - 1 AS labels))"
            )
        ),
    )
    sizes = (
        fitting.join(rules, "rule")
        .groupBy("host")
        .agg(F.max(F.struct("exempt", "labels"))["labels"].alias("labels"))
    )
    labels = "coalesce(labels, 1)"
    return (
        named.join(sizes, "host", "left")
        .withColumn("domain", F.expr(f"substring_index(name, '.', -{labels} - 1)"))
        .withColumn("suffix", F.expr(f"substring_index(name, '.', -{labels})"))
        .select(*hosts.columns, "domain", "suffix")
    )


def _strength(counts: DataFrame) -> float:
    """The weight of the prior in pages, from (n, bad, prior) per group."""
    variance = F.col("prior") * (1 - F.col("prior"))
    row = counts.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2),
        F.sum(F.col("n") * variance),
        F.sum(F.col("n") * F.col("n") * variance),
    ).first()
    seen, alone, together = (float(x or 0) for x in row)
    share = (seen - alone) / (together - alone) if together > alone else 0.0
    return 1 / min(max(share, WEAKEST), STRONGEST) - 1


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | Sequence[str] = SUFFIXES
) -> DataFrame:
    """host, n and bad (labelled pages), and the posterior beta (alpha, beta) per host of ``pages``.

    ``outcomes`` has (page_id, bad boolean); rows with NULLs are ignored and a page labelled
    several times is bad if any label says so. Three numbers per level come to the driver.
    """
    labelled = (
        outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL")
        .groupBy("page_id")
        .agg(F.max(F.col("bad").cast("int")).cast("long").alias("bad"))
    )
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(
        labelled, "page_id", "left"
    )
    counted = kept_table(
        seen.groupBy("host").agg(
            F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
        ),
        "host-counts",
    )
    hosts = kept_table(with_domain(counted, suffixes), "hosts")
    totals = hosts.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((totals[1] or 0) + 0.5) / ((totals[0] or 0) + 1.0)

    def shrunk(counts: DataFrame) -> DataFrame:
        strength = _strength(counts)
        return counts.withColumn(
            "rate", (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)
        ).withColumn("strength", F.lit(strength))

    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffix = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall)))
    above = suffix.select("suffix", F.col("rate").alias("prior"))
    domain = shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix"))
    above = domain.select("domain", F.col("rate").alias("prior"))
    host = shrunk(hosts.join(above, "domain"))
    return host.select(
        "host",
        "n",
        "bad",
        (F.col("bad") + F.col("strength") * F.col("prior")).alias("alpha"),
        (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))).alias("beta"),
    )


def lower_bound(alpha: Column, beta: Column, deviations: float = DEVIATIONS) -> Column:
    """Mean less so many standard deviations of a beta distribution."""
    total = alpha + beta
    return alpha / total - deviations * F.sqrt(alpha * beta / (total * total * (total + 1)))


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[UrlRule] = RULES,
    suffixes: DataFrame | Sequence[str] = SUFFIXES,
    limit: float = LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's labelled and bad pages, for every row.

    A NULL url or one without "://" has an empty host and path, which form a host of their own.
    The verdict is the longest fitting rule's, else by the host's reputation; a host without
    labelled pages has its domain's prior. Repeated rows and ids are all judged; other columns
    are ignored; empty tables give an empty result or no reputation but the prior. Rules become
    one expression, so they should number some hundreds at most.
    """
    reputation = kept_table(host_reputation(pages, outcomes, suffixes), "host-reputation")
    judged = reputation.select(
        "host",
        F.col("n").alias("host_labelled"),
        F.col("bad").alias("host_bad"),
        (lower_bound(F.col("alpha"), F.col("beta")) > limit).alias("bad_host"),
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")
    ).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(judged, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_host).alias("verdict"),
        "host_labelled",
        "host_bad",
    )
