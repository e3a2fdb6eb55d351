"""Expected-answer signatures and the interference reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ip import format_ip, is_reserved
from ..schema import EMPTY
from ..session import materialize
from .joins import attach_ip_metadata, country_of_asn, lpm_join, observations_by_country
from .ranking import cumulative_cliff, heaviest

__all__ = [
    "anomaly_summary",
    "asn_diversity_outliers",
    "block_page_candidates",
    "block_page_ips",
    "country_anomalies",
    "domain_signatures",
    "drop_ubiquitous_anomalies",
    "local_resolutions",
    "resolution_underflow",
]


def _evidence(per_ip: DataFrame, group: list[str], prefixes, ptrs, servers) -> DataFrame:
    """Rows ``group, method, value, n``: what each answer looks like to every method."""
    known = attach_ip_metadata(per_ip, "answer_ip", prefixes, ptrs, servers)

    def seen(method: str, value) -> F.Column:
        return F.struct(F.lit(method).alias("method"), value.cast("string").alias("value"))

    methods = F.array(
        seen("ASN", F.col("asn")), seen("PTR", F.col("ptr")), seen("SERVER", F.col("server"))
    )
    return known.select(*group, F.inline(methods), "n")


def domain_signatures(
    obs: DataFrame, prefixes: DataFrame, ptrs: DataFrame, servers: DataFrame, share: float = 0.75
) -> DataFrame:
    """Evidence of a correct answer per domain: ``domain, method, value array``.

    IP: the few addresses making up most answers; ASN, PTR, SERVER: the one value behind
    more than ``share`` of them. Empty answers count in the total and can be an IP value.
    """
    per_ip = (
        obs.filter(F.col("resolver_asn") != 0)
        .groupBy("domain", "answer_ip")
        .agg(F.sum("n").alias("n"))
    )
    totals = per_ip.groupBy("domain").agg(F.sum("n").alias("total"))
    head = cumulative_cliff(per_ip, "domain", "answer_ip", "n", share)
    ranked = F.sort_array(
        F.collect_list(
            F.struct("rank", F.coalesce(format_ip("answer_ip"), F.lit(EMPTY)).alias("v"))
        )
    )
    by_ip = head.groupBy("domain").agg(ranked.alias("r")).select(
        "domain", F.lit("IP").alias("method"), F.col("r.v").alias("value")
    )
    evidence = _evidence(per_ip, ["domain"], prefixes, ptrs, servers).filter("value is not null")
    counts = evidence.groupBy("domain", "method", "value").agg(F.sum("n").alias("n"))
    dominant = (
        counts.groupBy("domain", "method")
        .agg(heaviest("value", "n").alias("top"))
        .join(totals, "domain")
        .filter(F.col("top.n") > F.col("total") * F.lit(share))
    )
    return by_ip.unionByName(
        dominant.select("domain", "method", F.array("top.value").alias("value"))
    )


def country_anomalies(
    obs: DataFrame,
    asn_country: DataFrame,
    signatures: DataFrame,
    prefixes: DataFrame,
    ptrs: DataFrame,
    servers: DataFrame,
    min_total: int = 20,
) -> DataFrame:
    """Domains that no signature explains in a country:
    ``country, domain, total, checks array<struct<method, expected, good, top, top_n>>``.

    Reported with more than ``min_total`` answers when every method of the domain matches at
    most a quarter of them. Answers are summed per address before metadata is joined.
    """
    answers = observations_by_country(obs.filter("answer_ip is not null"), asn_country)
    per_ip = answers.groupBy("country", "domain", "answer_ip").agg(F.sum("n").alias("n"))
    per_ip = materialize(
        per_ip.join(signatures.select("domain"), "domain", "left_semi"), "country-answers"
    )
    totals = per_ip.groupBy("country", "domain").agg(F.sum("n").alias("total"))
    totals = totals.filter(F.col("total") > min_total)
    group = ["country", "domain"]
    other = _evidence(per_ip, group, prefixes, ptrs, servers).filter(
        "value is not null or method = 'ASN'"
    )
    by_ip = per_ip.select(*group, F.lit("IP").alias("method"), format_ip("answer_ip").alias("value"), "n")
    counts = (
        by_ip.unionByName(other).groupBy(*group, "method", "value").agg(F.sum("n").alias("n"))
    )
    wanted = signatures.select("domain", "method", F.col("value").alias("expected"))
    # Every expected method is listed for every reported domain, matched or not.
    due = totals.join(wanted, "domain")
    good = F.sum(F.when(F.array_contains("expected", F.col("value")), F.col("n")).otherwise(0))
    matched = (
        counts.join(wanted, ["domain", "method"])
        .groupBy(*group, "method")
        .agg(good.alias("good"), heaviest("value", "n").alias("top"))
    )
    check = F.struct(
        "method",
        "expected",
        F.coalesce("good", F.lit(0)).alias("good"),
        F.col("top.value").alias("top"),
        F.col("top.n").alias("top_n"),
    )
    checked = due.join(matched, [*group, "method"], "left")
    per_domain = checked.groupBy(*group, "total").agg(
        F.sort_array(F.collect_list(check)).alias("checks")
    )
    unexplained = F.forall("checks", lambda c: c["good"] * 4 <= F.col("total"))
    expects_empty = F.exists(
        "checks", lambda c: (c["method"] == "IP") & (F.element_at(c["expected"], 1) == EMPTY)
    )
    return per_domain.filter(unexplained & ~expects_empty).select("country", "domain", "total", "checks")


def _ubiquitous(anomalies: DataFrame) -> DataFrame:
    half = anomalies.agg((F.count_distinct("country") / 2).alias("half")).scalar()
    return anomalies.groupBy("domain").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > half)


def drop_ubiquitous_anomalies(anomalies: DataFrame) -> DataFrame:
    """Remove domains anomalous in more than half of the countries that have anomalies."""
    return anomalies.join(_ubiquitous(anomalies), "domain", "left_anti")


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Anomalies per country, how many stay, and how many domains drop as ubiquitous."""
    gone = _ubiquitous(anomalies)
    dropped = gone.agg(F.count(F.lit(1)).alias("c")).scalar()
    marked = anomalies.select("country", "domain").join(gone, "domain", "left")
    return marked.groupBy("country").agg(
        F.count(F.lit(1)).alias("anomalies"), F.count_if(F.col("k").isNull()).alias("kept")
    ).withColumn("dropped_domains", dropped)


def block_page_candidates(
    obs: DataFrame, prefixes: DataFrame, asn_country: DataFrame
) -> DataFrame:
    """Addresses a country sees far more often than the world does: ``country, ip, domain``.

    At least a tenth of the country's answers, over-represented beyond the domain's usual
    spread, and not a public host known to be in another country.
    """
    answers = obs.filter("answer_ip is not null")
    world = answers.groupBy("domain", "answer_ip").agg(F.sum("n").alias("g"))
    spread = world.groupBy("domain").agg(F.max("g").alias("g_max"))
    local = observations_by_country(answers, asn_country)
    local = local.groupBy("country", "domain", "answer_ip").agg(F.sum("n").alias("c"))
    totals = local.groupBy("country", "domain").agg(F.sum("c").alias("c_total"))
    # c/g > (g_total/g_max) * (c_total/g_total), kept in whole numbers too wide to overflow.
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("c", "c_total", "g", "g_max")}
    head = F.col("c") * 10 >= F.col("c_total")
    over = wide["c"] * wide["g_max"] > wide["g"] * wide["c_total"]
    suspects = (
        local.join(totals, ["country", "domain"])
        .filter(head)
        .join(world, ["domain", "answer_ip"])
        .join(spread, "domain")
        .filter(over)
        .select("country", "domain", "answer_ip")
    )
    hosted = country_of_asn(
        lpm_join(suspects, prefixes, "answer_ip", "host_asn"), asn_country, "host_asn", "host"
    )
    abroad = ~is_reserved("answer_ip") & F.col("host").isNotNull() & (F.col("host") != F.col("country"))
    return hosted.filter(~F.coalesce(abroad, F.lit(False))).select(
        "country", F.col("answer_ip").alias("ip"), "domain"
    )


def block_page_ips(candidates: DataFrame, obs: DataFrame, min_domains: int = 5) -> DataFrame:
    """Candidates used for many otherwise unrelated domains: ``country, ip, domains``.

    Domains count as related when the same address is most frequent for both; there must
    be fewer related pairs than domains. Pairs are counted per shared address, not listed.
    """
    world = (
        obs.filter("answer_ip is not null")
        .groupBy("domain", "answer_ip")
        .agg(F.sum("n").alias("g"))
    )
    usual = world.groupBy("domain").agg(heaviest("answer_ip", "g").alias("top"))
    usual = usual.select("domain", F.col("top.value").alias("top_ip"))
    per_top = (
        candidates.join(usual, "domain")
        .groupBy("country", "ip", "top_ip")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    k = F.col("k")
    return (
        per_top.groupBy("country", "ip")
        .agg(F.sum("k").alias("domains"), F.sum((k * (k - 1) / 2).cast("bigint")).alias("pairs"))
        .filter((F.col("domains") > min_domains) & (F.col("pairs") < F.col("domains")))
        .select("country", "ip", "domains")
    )


def local_resolutions(obs: DataFrame, asn_country: DataFrame, country: str) -> DataFrame:
    """Domains a country mostly answers with reserved addresses: ``domain, public, reserved``."""
    listed = asn_country.filter(F.col("country") == country).select(
        F.col("asn").alias("resolver_asn")
    )
    inside = obs.filter("answer_ip is not null").join(listed.distinct(), "resolver_asn", "left_semi")
    reserved = is_reserved("answer_ip")
    sums = inside.groupBy("domain").agg(
        F.sum(F.when(reserved, 0).otherwise(F.col("n"))).alias("public"),
        F.sum(F.when(reserved, F.col("n")).otherwise(0)).alias("reserved"),
    )
    return sums.filter(F.col("reserved") * 4 > F.col("public"))


def resolution_underflow(obs: DataFrame, asn_country: DataFrame, domains: DataFrame) -> DataFrame:
    """Domains a country answers mostly empty and less often than its average domain.

    The average runs over all ``domains`` of the run, also those that nobody answered for. A
    domain a country never saw adds nothing to it and cannot be reported, so only the seen
    ones are held.
    """
    domains = domains.agg(F.count_distinct("domain").alias("d")).scalar()
    empty = F.col("answer_ip").isNull()
    sums = (
        observations_by_country(obs, asn_country)
        .groupBy("country", "domain")
        .agg(
            F.sum(F.when(empty, 0).otherwise(F.col("n"))).alias("answered"),
            F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("empty"),
        )
    )
    mean = (F.sum(F.col("answered") + F.col("empty")) / domains).alias("average")
    averages = sums.groupBy("country").agg(mean)
    return (
        sums.filter("empty > answered")
        .join(averages, "country")
        .filter("answered < average")
        .select("country", "domain", "answered", "empty", "average")
    )


def asn_diversity_outliers(
    obs: DataFrame, prefixes: DataFrame, min_answers: int = 20, sigmas: float = 3.0
) -> DataFrame:
    """Resolver ASNs whose distinct answers for a domain spread unusually over answer ASNs.

    ``ratio`` is distinct answers over those in the commonest answer ASN; outliers lie more
    than ``sigmas`` population deviations above the domain's mean.
    """
    answers = lpm_join(obs.filter("answer_ip is not null"), prefixes, "answer_ip", "answer_asn")
    sizes = answers.groupBy("domain", "resolver_asn", "answer_asn").agg(
        F.count(F.lit(1)).alias("k")
    )
    ratios = sizes.groupBy("domain", "resolver_asn").agg(
        F.sum("k").alias("total"), (F.sum("k") / F.max("k")).alias("ratio")
    )
    usual = ratios.groupBy("domain").agg(
        F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("deviation")
    )
    return (
        ratios.filter(F.col("total") >= min_answers)
        .join(usual, "domain")
        .filter(F.col("ratio") > F.col("mean") + sigmas * F.col("deviation"))
        .select("domain", "resolver_asn", "total", "ratio")
    )
