"""Aggregation of responses and roll-ups of the observation table.

All of these are group-bys with map-side partial aggregation; a hot key shrinks to one
row per input partition before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dns import decode_dns_responses
from ..functions.ip import class_c, ip_to_long
from ..session import materialize
from .filters import usable_answers
from .joins import country_of_asn, lpm_join

_GROUPS_PER_SALT = 64
_BROADCAST_RESOLVERS = 4_000_000  # two bigints each, some 100 MB as a hash table


def with_resolver_asn(scan: DataFrame, prefixes: DataFrame, whitelist: DataFrame | None = None):
    """Add the ASN of ``resolver_ip`` (dotted text), keeping listed resolvers (``ip``) only."""
    parsed = scan.withColumn("_resolver", ip_to_long("resolver_ip"))
    if whitelist is None:
        return lpm_join(parsed, prefixes, "_resolver", "resolver_asn").drop("_resolver")
    return parsed.join(_listed(prefixes, whitelist), "_resolver").drop("_resolver")


def _listed(prefixes: DataFrame, whitelist: DataFrame) -> DataFrame:
    listed = lpm_join(whitelist.select("ip").distinct(), prefixes, "ip", "resolver_asn")
    return listed.select(F.col("ip").alias("_resolver"), "resolver_asn")


def _decoded(scan: DataFrame, origin: str) -> DataFrame:
    """Packets to ``shard, failed, domain, <origin>, answer_ip``, a row for each answer.

    Every A record counts once for the name in the packet; a response without A records counts
    as empty; an undecodable one as failed for the asked domain.
    """
    d = scan.withColumn("d", decode_dns_responses("data_hex"))
    bad = ~F.col("d.ok") | F.col("d.qname").isNull()
    return d.select(
        "shard",
        bad.alias("failed"),
        F.when(bad, F.lower("domain")).otherwise(F.col("d.qname")).alias("domain"),
        origin,
        F.explode_outer(F.when(~bad, F.col("d.a_records"))).alias("answer_ip"),
    )


def _of_shards(rows: DataFrame, shard_domains: DataFrame) -> DataFrame:
    names = shard_domains.select("shard", F.lower("domain").alias("domain")).distinct()
    return rows.join(names, ["shard", "domain"], "left_semi").drop("shard")


def _counted(rows: DataFrame, n: Column) -> DataFrame:
    asn = F.when(~F.col("failed"), F.col("resolver_asn")).alias("resolver_asn")
    return rows.groupBy("failed", "domain", asn, "answer_ip").agg(n.alias("n"))


def aggregate_responses(scan: DataFrame, shard_domains: DataFrame) -> DataFrame:
    """Responses to counts: ``failed, domain, resolver_asn, answer_ip, n``.

    ``scan`` holds ``shard, domain (asked), resolver_asn, data_hex``. Names outside the
    shard's list fall away. Decoding and counting happen once for both kinds of row.
    """
    keys = ["shard", "failed", "domain", "resolver_asn", "answer_ip"]
    counts = _decoded(scan, "resolver_asn").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _counted(_of_shards(counts, shard_domains), F.sum("n"))


def aggregate_listed_responses(
    scan: DataFrame, shard_domains: DataFrame, prefixes: DataFrame, whitelist: DataFrame
) -> DataFrame:
    """``aggregate_responses`` over the responses of listed resolvers (``ip``, uint32).

    Packets never move. A list of proven size is broadcast with its ASNs, two numbers a
    resolver, and filters the scan before anything is decoded. Beyond that size the packets are decoded
    where they lie, and their names and answers meet the list; a resolver has few equal ones to add up before.
    """
    listed = materialize(_listed(prefixes, whitelist), "listed")
    keyed = scan.withColumn("_resolver", ip_to_long("resolver_ip"))
    if listed.count() <= _BROADCAST_RESOLVERS:
        return aggregate_responses(keyed.join(F.broadcast(listed), "_resolver"), shard_domains)
    answers = _of_shards(_decoded(keyed, "_resolver"), shard_domains)
    return _counted(answers.join(listed, "_resolver"), F.count(F.lit(1)))


def observations_of(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.col("failed")).drop("failed")


def failures_of(counts: DataFrame) -> DataFrame:
    return counts.filter("failed").groupBy("domain").agg(F.sum("n").alias("failed"))


def aggregate_responses_per_file(scan: DataFrame) -> DataFrame:
    """One-domain-per-file variant: exactly one question, and it must be the file's domain.

    ``scan`` holds ``domain, resolver_asn, data_hex``.
    """
    d = scan.withColumn("d", decode_dns_responses("data_hex"))
    bad = ~F.col("d.ok")
    kept = d.filter(bad | ((F.col("d.qdcount") == 1) & (F.col("d.qname") == F.lower("domain"))))
    rows = kept.select(
        bad.alias("failed"),
        "domain",
        F.when(~bad, F.col("resolver_asn")).alias("resolver_asn"),
        F.explode_outer(F.when(~bad, F.col("d.a_records"))).alias("answer_ip"),
    )
    return rows.groupBy("failed", "domain", "resolver_asn", "answer_ip").agg(
        F.count(F.lit(1)).alias("n")
    )


def ip_domain_counts(obs: DataFrame) -> DataFrame:
    return (
        usable_answers(obs)
        .groupBy(F.col("answer_ip").alias("ip"), "domain")
        .agg(F.sum("n").alias("n"))
    )


def network_domain_counts(obs: DataFrame) -> DataFrame:
    return (
        usable_answers(obs)
        .groupBy(class_c("answer_ip").alias("net"), "domain")
        .agg(F.sum("n").alias("n"))
    )


def country_flow(obs: DataFrame, prefixes: DataFrame, asn_country: DataFrame) -> DataFrame:
    """Resolutions per domain from resolver country to answer country.

    Resolvers without a country drop out; answers without one (or empty) count under NULL.
    """
    per_ip = country_of_asn(obs, asn_country, "resolver_asn", "resolver_country", "inner")
    per_ip = per_ip.groupBy("domain", "resolver_country", "answer_ip").agg(F.sum("n").alias("n"))
    placed = country_of_asn(
        lpm_join(per_ip, prefixes, "answer_ip", "answer_asn"), asn_country, "answer_asn", "answer_country"
    )
    return placed.groupBy("domain", "resolver_country", "answer_country").agg(F.sum("n").alias("n"))


def asn_flow(
    obs: DataFrame, prefixes: DataFrame, clusters: DataFrame, footprint: DataFrame, share: float = 0.01
) -> DataFrame:
    """Share of a domain's answers, per resolver ASN, landing in each ASN of its footprint.

    The total counts all answers, also empty ones; shares up to ``share`` and addresses
    without an ASN are left out. Domains without a footprint do not appear.
    """
    known = obs.filter("resolver_asn is not null").join(
        clusters.join(footprint.select("cluster_id").distinct(), "cluster_id", "left_semi"), "domain"
    )
    inside = footprint.select("cluster_id", F.col("net").alias("_foot")).distinct()
    marked = lpm_join(known, prefixes, "answer_ip", "answer_asn").withColumn(
        "_c24", class_c("answer_ip")
    )
    right = inside.withColumnRenamed("cluster_id", "_cid")
    marked = marked.join(
        right, (F.col("cluster_id") == F.col("_cid")) & (F.col("_c24") == F.col("_foot")), "left"
    )
    target = F.when(F.col("_foot").isNotNull(), F.col("answer_asn"))
    sums = marked.groupBy("domain", "resolver_asn", target.alias("answer_asn")).agg(
        F.sum("n").alias("n")
    )
    totals = sums.groupBy("domain", "resolver_asn").agg(F.sum("n").alias("total"))
    return (
        sums.filter("answer_asn is not null")
        .join(totals, ["domain", "resolver_asn"])
        .filter(F.col("n") > F.lit(share) * F.col("total"))
        .select("domain", "resolver_asn", "answer_asn", (F.col("n") / F.col("total")).alias("share"))
    )


def domains_without_footprint(obs: DataFrame, clusters: DataFrame, footprint: DataFrame) -> DataFrame:
    covered = clusters.join(footprint.select("cluster_id").distinct(), "cluster_id", "left_semi")
    missing = obs.select("domain").distinct().join(covered, "domain", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("domains"))


def pivot_asn_ip_domain(obs: DataFrame) -> DataFrame:
    """Counts addressed as resolver ASN, address, domain; empty answers left out."""
    return (
        usable_answers(obs)
        .groupBy("resolver_asn", "answer_ip", "domain")
        .agg(F.sum("n").alias("n"))
    )


def pivot_asn_domain_ip(obs: DataFrame) -> DataFrame:
    """Counts addressed as resolver ASN, domain, address; empty answers kept."""
    return (
        obs.filter("resolver_asn is not null")
        .groupBy("resolver_asn", "domain", "answer_ip")
        .agg(F.sum("n").alias("n"))
    )


def pivot_country_domain_ip(obs: DataFrame, asn_country: DataFrame) -> DataFrame:
    """Counts addressed as resolver country, domain, address; empty answers kept."""
    placed = country_of_asn(obs, asn_country, "resolver_asn", "country", "inner")
    return placed.groupBy("country", "domain", "answer_ip").agg(F.sum("n").alias("n"))


def ips_per_asn(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Addresses per ASN; NULL collects those without one."""
    return lpm_join(ips, prefixes, "ip", "asn").groupBy("asn").agg(F.count(F.lit(1)).alias("n"))


def reduce_by_country(
    df: DataFrame, asn_country: DataFrame, *aggregates: Column, asn: str = "asn"
) -> DataFrame:
    """Apply aggregate columns to ASN-keyed rows per country; ASNs without one drop out."""
    return country_of_asn(df, asn_country, asn, "country", "inner").groupBy("country").agg(*aggregates)


def asn_to_country_rollup(
    df: DataFrame, asn_country: DataFrame, measures: list[str], asn: str = "asn"
) -> DataFrame:
    """Sum every measure column per country."""
    return reduce_by_country(df, asn_country, *[F.sum(m).alias(m) for m in measures], asn=asn)


def underrepresented_countries(base: DataFrame, test: DataFrame) -> DataFrame:
    """Countries whose test count is missing or below half of the base count."""
    joined = base.select("country", F.col("n").alias("base")).join(
        test.select("country", F.col("n").alias("test")), "country", "left"
    )
    few = F.coalesce("test", F.lit(0))
    return joined.filter((few == 0) | (2 * few < F.col("base"))).select(
        "country", "base", few.alias("test")
    )


def expected_query_counts(resolvers: DataFrame, shard_domains: DataFrame, group: str) -> DataFrame:
    """``size, idx, <group>, n``: queries per shard size and position; resolver ``r`` asks ``r mod size``.

    This is the compact form: domains of equal position share a row. Shard sizes are few (their
    sum is the number of domains), so they ride along as one array instead of a join.
    """
    sizes = shard_domains.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    every_size = sizes.agg(F.collect_set("size").alias("sizes")).scalar()
    spread = resolvers.select(group, "ip", F.explode(every_size).alias("size"))
    return spread.groupBy("size", (F.col("ip") % F.col("size")).alias("idx"), group).agg(
        F.count(F.lit(1)).alias("n")
    )


def expand_expected(counts: DataFrame, shard_domains: DataFrame, group: str) -> DataFrame:
    """The compact counts for every domain of a shard, to be written out.

    There are only as many (size, idx) keys as positions in a shard; they are salted by group, with as many
    salts as keep about ``_GROUPS_PER_SALT`` groups together.
    """
    sizes = shard_domains.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    counts = materialize(counts, "expected")
    groups = counts.agg(F.count_distinct(group).alias("n")).first().n
    salts = max(1, -(-groups // _GROUPS_PER_SALT))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    placed = shard_domains.join(sizes, "shard").select("*", salt)
    asked = counts.withColumn("salt", F.pmod(F.xxhash64(group), F.lit(salts)).cast("int"))
    return placed.join(asked, ["size", "idx", "salt"])


def _expected_queries(resolvers: DataFrame, shard_domains: DataFrame, group: str) -> DataFrame:
    return expand_expected(expected_query_counts(resolvers, shard_domains, group), shard_domains, group)


def expected_queries_by_asn(resolvers: DataFrame, shard_domains: DataFrame) -> DataFrame:
    """How many queries each domain should have received from each ASN.

    ``resolvers`` holds ``ip, asn``; a domain in several shards has one row per shard.
    """
    return _expected_queries(resolvers, shard_domains, "asn").select("shard", "domain", "asn", "n")


def expected_queries_by_country(resolvers: DataFrame, shard_domains: DataFrame) -> DataFrame:
    """The same per country; a domain in several shards counts in the last one."""
    last = shard_domains.groupBy("domain").agg(F.max("shard").alias("shard"))
    asked = _expected_queries(resolvers.filter("country is not null"), shard_domains, "country")
    return asked.join(last, ["shard", "domain"]).select("domain", "country", "n")


def signature_type_counts(domains: DataFrame, signatures: DataFrame) -> DataFrame:
    """Domains per signature method; UNKNOWN are the domains without one."""
    joined = domains.select("domain").distinct().join(
        signatures.select("domain", "method").distinct(), "domain", "left"
    )
    return joined.groupBy(F.coalesce("method", F.lit("UNKNOWN")).alias("method")).agg(
        F.count(F.lit(1)).alias("domains")
    )


def http_scan_stats(
    scans: DataFrame, prefixes: DataFrame, pairs: list[tuple[tuple[int, str], tuple[int, str]]]
) -> DataFrame:
    """Per ASN and scan pair: addresses only in the first, in both, only in the second.

    One pass over all scans counts each address per scan; the pairs are then compared
    inside that row, so no scan is joined to another. Repeats match one for one.
    """
    wanted = sorted({scan for pair in pairs for scan in pair})
    label = {scan: f"s{i}" for i, scan in enumerate(wanted)}
    present = [
        F.count_if((F.col("port") == port) & (F.col("mode") == mode)).alias(label[(port, mode)])
        for port, mode in wanted
    ]
    per_ip = lpm_join(scans.groupBy("ip").agg(*present), prefixes, "ip", "asn")
    sides = []
    for first, second in pairs:
        a, b = F.col(label[first]), F.col(label[second])
        sides.append(
            F.struct(
                F.lit(f"{first[0]}-{first[1]}/{second[0]}-{second[1]}").alias("pair"),
                F.greatest(a - b, F.lit(0)).alias("only_first"),
                F.least(a, b).alias("both"),
                F.greatest(b - a, F.lit(0)).alias("only_second"),
            )
        )
    compared = per_ip.select("asn", F.inline(F.array(*sides)))
    measures = ["only_first", "both", "only_second"]
    return (
        compared.filter("asn is not null")
        .groupBy("asn", "pair")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
