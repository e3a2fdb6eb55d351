"""Comparing address lists, assembling and sharding domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import lpm_join
from .ranking import row_numbers


def ip_list_diff(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Multiset comparison of two lists: ``keys, side, n`` with side ``both``, ``a-b``, ``b-a``.

    Repeats match one for one; ``n`` is the multiplicity on that side.
    """
    keys = keys or ["ip"]
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = tagged.groupBy(*keys).agg(F.sum("_a").alias("ca"), F.sum("_b").alias("cb"))
    ca, cb = F.col("ca"), F.col("cb")

    def side(name: str, n) -> F.Column:
        return F.struct(F.lit(name).alias("side"), n.alias("n"))

    sides = F.array(side("both", F.least(ca, cb)), side("a-b", ca - cb), side("b-a", cb - ca))
    return counts.select(*keys, F.inline(sides)).filter("n > 0")


def ip_list_diff_by_asn(a: DataFrame, b: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The same per ASN; addresses without an ASN are compared under NULL."""
    diff = ip_list_diff(a, b)
    return lpm_join(diff, prefixes, "ip", "asn").select("asn", "ip", "side", "n")


def append_domains(
    ranked: DataFrame, extra: DataFrame, redirect_hosts: DataFrame, top: int = 10_000
) -> DataFrame:
    """The ``top`` ranked domains, then extra ones, then redirect hosts; repeats stay."""
    head = ranked.orderBy("rank").limit(top).select("domain")
    return head.unionByName(extra.select("domain")).unionByName(
        redirect_hosts.select(F.col("host").alias("domain"))
    )


def shard_domains(domains: DataFrame, per_shard: int = 10, order: str = "rank") -> DataFrame:
    """Cut an ordered domain list into shards: ``shard, idx, domain``.

    A path behind a domain and blank entries are dropped; a shard is named by the MD5 of
    its comma-joined domains.
    """
    name = F.split_part("domain", F.lit("/"), F.lit(1))
    clean = domains.filter(F.length("domain") > 0).select(order, name.alias("domain"))
    numbered = row_numbers(clean, order)
    pos = F.col("rn") - 1
    groups = numbered.groupBy(F.floor(pos / per_shard).alias("_shard")).agg(
        F.sort_array(F.collect_list(F.struct("rn", "domain"))).alias("members")
    )
    names = F.col("members.domain")
    shard = F.md5(F.array_join(names, ",")).alias("shard")
    return groups.select(shard, F.posexplode(names).alias("idx", "domain"))
