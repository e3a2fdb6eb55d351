"""Scores of how plausible an answer is, given how similar co-hosted domains are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import is_reserved
from .pairs import Tiling, neighbour_mass

# Possessive, so that a text that does not fit is refused in one pass.
_ALLOWED = re.compile(r"(?:\s|\d++(?:\.\d++)?+|\bn\b|\bm\b|[-+*/%(),])*+")


def user_threshold_expression(text: str) -> Column:
    """Arithmetic over ``n`` and ``m`` given by a user, e.g. ``n / 2`` or ``(n + m) * 0.1``."""
    if not text.strip() or not _ALLOWED.fullmatch(text):
        raise ValueError(f"only numbers, n, m, + - * / % and parentheses are allowed: {text!r}")
    return F.expr(text)


def score_resolutions(
    ip_domain: DataFrame, sim: DataFrame, tiling: Tiling = Tiling()
) -> DataFrame:
    """Score of each (domain, address): its count times the count-weighted mean similarity
    of all domains on that address, the domain itself included with similarity 1."""
    public = ip_domain.filter(~is_reserved("ip"))
    cells = public.select("domain", F.col("ip").alias("e"), F.col("n").cast("double").alias("y"))
    mass = neighbour_mass(cells, sim, "product", tiling).select("domain", F.col("e").alias("ip"), "num")
    totals = public.groupBy("ip").agg(F.sum("n").alias("total"))
    near = F.coalesce("num", F.lit(0.0)) + F.col("n")
    return (
        public.join(totals, "ip")
        .join(mass, ["domain", "ip"], "left")
        .select("domain", "ip", (near / F.col("total") * F.col("n")).alias("score"))
    )


def score_with_diversity(ip_domain: DataFrame, scores: DataFrame) -> DataFrame:
    """Lift scores of addresses that make up a large part of a domain's answers."""
    totals = ip_domain.groupBy("domain").agg(F.sum("n").alias("total"))
    joined = ip_domain.join(totals, "domain").join(scores, ["domain", "ip"])
    w = F.pow(F.col("n") / F.col("total"), F.lit(1.0) / F.lit(3.0))
    return joined.select("domain", "ip", (w + (1 - w) * (F.col("score") + 1) / 2).alias("score"))


def _score_answers(counts: DataFrame, group: str, scores: DataFrame, threshold: float) -> DataFrame:
    answered = counts.filter("ip is not null").join(scores, ["domain", "ip"], "left")
    per_domain = (
        answered.groupBy(group, "domain")
        .agg(
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("score"),
            F.sum("n").alias("total"),
            F.count_if(F.col("score").isNull()).alias("unscored"),
        )
        .filter((F.col("unscored") == 0) & (F.col("score") <= threshold))
        .drop("unscored")
    )
    detail = answered.select(group, "domain", "ip", "n", F.col("score").alias("ip_score"))
    return per_domain.join(detail, [group, "domain"])


def score_asn_domains(asn_domain_ip: DataFrame, scores: DataFrame, threshold: float = 1.0):
    """Mean answer score per (ASN, domain), kept up to ``threshold``.

    One row per answer: ``resolver_asn, domain, score, total, ip, n, ip_score``. A domain
    with an unscored answer is left out.
    """
    counts = asn_domain_ip.withColumnRenamed("answer_ip", "ip")
    return _score_answers(counts, "resolver_asn", scores, threshold)


def score_country_domains(country_domain_ip: DataFrame, scores: DataFrame, threshold: float = 1.0):
    """The same per country."""
    counts = country_domain_ip.withColumnRenamed("answer_ip", "ip")
    return _score_answers(counts, "country", scores, threshold)


def score_asn_ips(
    asn_ip_domain: DataFrame, sim: DataFrame, threshold: float = 1.0, tiling: Tiling = Tiling()
) -> DataFrame:
    """Overlap-weighted mean similarity of the domains one address serves to one ASN.

    Only scores up to ``threshold`` are kept; an address with a single domain has no score
    and is kept.
    """
    packed = F.shiftleft(F.col("resolver_asn"), 32).bitwiseOR(F.col("answer_ip"))
    cells = asn_ip_domain.select("domain", packed.alias("e"), F.col("n").cast("double").alias("y"))
    mass = neighbour_mass(cells, sim, "overlap", tiling)
    mass = mass.groupBy("e").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    per_ip = asn_ip_domain.groupBy("resolver_asn", "answer_ip", packed.alias("e")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("domains")
    )
    score = F.when(F.col("den") > 0, F.col("num") / F.col("den"))
    return (
        per_ip.join(mass, "e", "left")
        .select("resolver_asn", F.col("answer_ip").alias("ip"), score.alias("score"), "total", "domains")
        .filter(F.col("score").isNull() | (F.col("score") <= threshold))
    )


def score_country_asn_ips(asn_ips: DataFrame, asn_country: DataFrame) -> DataFrame:
    """Address scores grouped under the countries their ASN is listed in."""
    return asn_ips.join(asn_country.distinct().withColumnRenamed("asn", "resolver_asn"), "resolver_asn")


__all__ = [
    "score_asn_domains",
    "score_asn_ips",
    "score_country_asn_ips",
    "score_country_domains",
    "score_resolutions",
    "score_with_diversity",
    "user_threshold_expression",
]
