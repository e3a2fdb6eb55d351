"""Selecting answers and resolvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ip import class_c


def usable_answers(obs: DataFrame) -> DataFrame:
    """Observations with a known resolver ASN and an address."""
    return obs.filter(F.col("resolver_asn").isNotNull() & F.col("answer_ip").isNotNull())


def _recursive() -> Column:
    return F.col("ok") & (F.col("qr") == 1) & (F.col("ra") == 1)


def _answered() -> Column:
    return _recursive() & (F.col("ancount") > 0)


def _valid(expected_ip: int) -> Column:
    return _answered() & F.array_contains("a_records", F.lit(expected_ip).cast("bigint"))


def select_resolvers(decoded: DataFrame, expected_ip: int, seq: str = "seq") -> DataFrame:
    """Working recursive resolvers: the first valid responder of every /24.

    ``decoded`` holds ``ip``, ``seq`` and the fields of ``schema.DECODED``.
    """
    valid = decoded.filter(_valid(expected_ip)).withColumn("net", class_c("ip"))
    return valid.groupBy("net").agg(F.min_by("ip", seq).alias("ip"))


def resolver_funnel(decoded: DataFrame, expected_ip: int) -> DataFrame:
    """How many responders pass each successive test of ``select_resolvers``."""
    valid = _valid(expected_ip)
    return decoded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_recursive()).alias("recursive"),
        F.count_if(_answered()).alias("answered"),
        F.count_if(valid).alias("valid"),
        F.count_distinct(F.when(valid, class_c("ip"))).alias("networks"),
    )


def collapse_hosts(ips: DataFrame, buckets: int, seed: int = 0, ip: str = "ip") -> DataFrame:
    """One host (the lowest) per /24, spread over ``buckets`` by a seeded hash."""
    hosts = ips.groupBy(class_c(ip).alias("net")).agg(F.min(ip).alias("ip"))
    digest = F.md5(F.concat_ws(":", F.col("ip").cast("string"), F.lit(str(seed))))
    spread = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets
    return hosts.withColumn("bucket", spread)


def asns_above_threshold(resolvers: DataFrame, threshold: int, asn: str = "asn") -> DataFrame:
    """ASNs with more than ``threshold`` resolvers."""
    counts = resolvers.filter(F.col(asn).isNotNull()).groupBy(asn).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > threshold)
