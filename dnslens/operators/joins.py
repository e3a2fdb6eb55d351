"""Joins: routing, country, resolver lists and address metadata.

No broadcast is forced anywhere: the planner broadcasts a side when its measured size is
below its threshold and otherwise shuffles, with adaptive skew splitting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ip import class_c, prefix
from ..functions.text import ptr_base_domain
from ..session import materialize


def lpm_table(
    ips: DataFrame, prefixes: DataFrame, ip: str = "ip", min_len: int = 9, max_len: int = 24
) -> DataFrame:
    """Longest-prefix match per ``/max_len`` network seen in ``ips``: ``_net, asn``.

    The answer only depends on the leading ``max_len`` bits, so the match runs on distinct
    networks (at most 2**24 by default) and is an equi-join on (length, base).
    """
    nets = ips.select(prefix(ip, max_len).alias("_net")).filter("_net is not null").distinct()
    routes = prefixes.filter(F.col("prefix_len").between(min_len, max_len)).select(
        "network", "prefix_len", "asn"
    )
    # Only lengths that occur are tried.
    lengths = routes.agg(F.array_sort(F.collect_set("prefix_len")).alias("l")).scalar()
    size = F.lit(2).cast("bigint") ** (32 - F.col("prefix_len"))
    candidates = nets.select("_net", F.explode(lengths).alias("prefix_len")).withColumn(
        "network", F.col("_net") - F.col("_net") % size.cast("bigint")
    )
    # Length and 32-bit ASN packed into one bigint keep this a hash aggregation.
    best = F.max(F.shiftleft(F.col("prefix_len").cast("bigint"), 32).bitwiseOR(F.col("asn")))
    return (
        candidates.join(routes, ["prefix_len", "network"])
        .groupBy("_net")
        .agg(best.alias("_best"))
        .select("_net", F.col("_best").bitwiseAND(F.lit(0xFFFFFFFF)).alias("asn"))
    )


def lpm_join(
    df: DataFrame,
    prefixes: DataFrame,
    ip: str = "ip",
    out: str = "asn",
    min_len: int = 9,
    max_len: int = 24,
) -> DataFrame:
    """Add the ASN announcing ``ip``; NULL where no prefix covers it.

    Rows without an address match nothing; they get negative keys that spread them out.
    """
    table = lpm_table(df, prefixes, ip, min_len, max_len).withColumnRenamed("asn", out)
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    keyed = df.withColumn("_net", F.coalesce(prefix(ip, max_len), nowhere))
    return keyed.join(table, "_net", "left").drop("_net")


def country_of_asn(
    df: DataFrame, asn_country: DataFrame, asn: str = "asn", out: str = "country", how: str = "left"
) -> DataFrame:
    """Add one country per ASN; an ASN listed under several gets the last by name."""
    one = asn_country.groupBy(F.col("asn").alias("_asn")).agg(F.max("country").alias(out))
    return df.join(one, F.col(asn) == F.col("_asn"), how).drop("_asn")


def observations_by_country(obs: DataFrame, asn_country: DataFrame) -> DataFrame:
    """Observations under every country their resolver's ASN is listed in."""
    listed = asn_country.distinct().withColumnRenamed("asn", "resolver_asn")
    return obs.join(listed, "resolver_asn")


def whitelist_semi(scan: DataFrame, resolvers: DataFrame, key: str = "resolver_ip") -> DataFrame:
    return scan.join(resolvers.select(key), key, "left_semi")


def misdirected_resolvers(probe: DataFrame, expected_ip: int, recursive_only: bool) -> DataFrame:
    """Resolvers whose first answer is not the expected address."""
    wrong = (F.col("ancount") > 0) & ~F.col("first_a").eqNullSafe(F.lit(expected_ip))
    if recursive_only:
        wrong = wrong & (F.col("ra") == 1)
    return probe.filter(wrong).select("resolver_ip").distinct()


def blacklist_anti(scan: DataFrame, probe: DataFrame, expected_ip: int) -> DataFrame:
    """Scan rows from resolvers not caught answering the probe wrongly."""
    return scan.join(misdirected_resolvers(probe, expected_ip, True), "resolver_ip", "left_anti")


def surviving_resolvers(servers: DataFrame, probe: DataFrame, expected_ip: int) -> DataFrame:
    """Listed servers that did not answer the probe wrongly; silent ones survive."""
    return servers.join(misdirected_resolvers(probe, expected_ip, False), "resolver_ip", "left_anti")


def network_bitmaps(hosts: DataFrame, ip: str = "ip") -> DataFrame:
    """The /24 networks of some hosts as ``bucket, bits``: at most 512 rows of 4 KB, whatever the hosts.

    Stored, so that the planner knows this size.
    """
    net = F.shiftright(ip, 8)
    marked = hosts.filter(F.col(ip).isNotNull()).select(
        F.bitmap_bucket_number(net).alias("bucket"), F.bitmap_bit_position(net).alias("at")
    )
    return materialize(marked.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "networks")


def _seen_before(now: DataFrame, before: DataFrame, ip: str) -> DataFrame:
    """``now`` with ``_old``: whether a host's /24 is in the older run. Only bitmaps of the older run move."""
    net = F.shiftright(ip, 8)
    at = F.bitmap_bit_position(net)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, (at % 8).cast("int")) == 1
    joined = now.withColumn("_bucket", F.bitmap_bucket_number(net)).join(
        network_bitmaps(before, ip).withColumnRenamed("bucket", "_bucket"), "_bucket", "left"
    )
    return joined.withColumn("_old", F.coalesce(bit, F.lit(False))).select(*now.columns, "_old")


def historic_intersection(now: DataFrame, before: DataFrame, ip: str = "ip") -> DataFrame:
    """Hosts whose /24 already appeared in an older run."""
    return _seen_before(now, before, ip).filter("_old").drop("_old")


def historic_share(now: DataFrame, before: DataFrame, ip: str = "ip") -> DataFrame:
    """How many hosts there are, how many are kept, and the share, in one pass."""
    return _seen_before(now, before, ip).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_old").alias("kept")
    ).withColumn("share", F.col("kept") / F.col("total"))


def usable_headers(servers: DataFrame) -> DataFrame:
    return servers.filter((F.col("status") < 500) & (F.length("server") > 0)).select("ip", "server")


def address_facts(
    ptrs: DataFrame | None = None, servers: DataFrame | None = None, whois: DataFrame | None = None
) -> DataFrame | None:
    """One row an address, ``ip`` and those of ``ptr, server, org`` that are asked for.

    The sources are put under each other and added up by address, so none of them is joined. Of several
    values for an address the last by name counts.
    """
    sides = {}
    if ptrs is not None:
        sides["ptr"] = ptrs.select("ip", ptr_base_domain(F.try_element_at("names", F.lit(1))).alias("ptr"))
    if servers is not None:
        sides["server"] = usable_headers(servers)
    if whois is not None:
        sides["org"] = whois.select("ip", "org")
    if not sides:
        return None
    parts = [s.filter(F.col(c).isNotNull()).withColumn("_fact", F.lit(c)).withColumnRenamed(c, "_value") for c, s in sides.items()]
    facts = reduce(DataFrame.unionByName, parts).groupBy("ip")
    return facts.agg(*[F.max(F.when(F.col("_fact") == c, F.col("_value"))).alias(c) for c in sides])


def attach_ip_metadata(
    df: DataFrame,
    ip: str,
    prefixes: DataFrame | None = None,
    ptrs: DataFrame | None = None,
    servers: DataFrame | None = None,
    whois: DataFrame | None = None,
) -> DataFrame:
    """Add what is known of an address: ``asn``, ``ptr``, ``server``, ``org``.

    All of it is looked up for distinct addresses and joined once, so rows of ``df`` move at most once. Rows
    without an address get keys that spread them out.
    """
    known = df.select(F.col(ip).alias("ip")).filter("ip is not null").distinct()
    if prefixes is not None:
        known = lpm_join(known, prefixes, "ip", "asn")
    facts = address_facts(ptrs, servers, whois)
    if facts is not None:
        known = known.join(facts, "ip", "left")
    if len(known.columns) == 1:
        return df
    # Addresses are not negative.
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    keyed = df.withColumn("_ip", F.coalesce(F.col(ip).cast("bigint"), nowhere))
    return keyed.join(known.withColumnRenamed("ip", "_ip"), "_ip", "left").drop("_ip")


def new_network_redirects(redirects: DataFrame, domain_ips: DataFrame) -> DataFrame:
    """(domain, host) redirects that lead to a /24 the domain itself does not use."""
    nets = domain_ips.select("domain", class_c("ip").alias("net")).distinct()
    host_nets = nets.select(F.col("domain").alias("host"), "net")
    return (
        redirects.select("domain", "host")
        .distinct()
        .join(nets.select("domain"), "domain", "left_semi")
        .join(host_nets, "host")
        .join(nets, ["domain", "net"], "left_anti")
        .select("domain", "host")
        .distinct()
    )
