"""DNS measurement tables derived from the order tables the driver provides.

Every line item stands for one DNS response: its part's brand is the domain, its customer
the resolver's network, a hash of its keys the answer. ``plans/oracles.py`` holds the same
derivation in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ip import format_ip
from ..operators.rollups import ip_domain_counts, network_domain_counts
from ..operators.setops import shard_domains
from ..session import materialize, scratch_path, unsorted_partitions

# Fixed values of the derivation: first public address used, planted answers, expected probe answer.
FIRST_PUBLIC = 184549376
FIRST_HOSTED = 1207959552
PLANTED_RESERVED = 168436258
PLANTED_LOCAL = 1007353857
EXPECTED_IP = PLANTED_LOCAL

HTTP_SCANS = [(80, "tcp_synscan"), (80, "tcp_ackscan"), (443, "tcp_synscan"), (443, "tcp_ackscan")]


def _domain(k: Column) -> Column:
    return F.concat(F.lit("d"), k.cast("string"), F.lit(".example"))


def _answer() -> Column:
    k, nat, r = F.col("k"), F.col("nat"), F.col("r")
    return (
        F.when((nat == 5) & (k % 4 == 0) & (r < 70), None)
        .when(r < 3, None)
        .when((nat == 3) & (k % 2 == 0) & (r < 80), F.lit(PLANTED_RESERVED))
        .when((nat == 11) & (k % 3 == 0) & (r < 80), F.lit(PLANTED_LOCAL))
        .when(r >= 97, 1174405120 + nat * 65536 + k)
        .when(k % 4 == 0, 335544320 + k * 65536 + 10)
        .when(k % 4 == 1, 503316480 + k * 65536 + (r % 8) * 256 + r % 16)
        .when(k % 4 == 2, 671088640 + (k % 3) * 65536 + (r % 4) * 256 + 1)
        .otherwise(838860800 + (r % 5) * 16777216 + k * 65536 + r % 7)
        .cast("bigint")
    )


class Inputs:
    """The derived tables for one data folder; the shared ones are stored once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Spread an input with fewer splits than cores evenly; a large one is left as it is."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def obs_raw(self) -> DataFrame:
        line = self._spread(self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        part = self.table("part").select("p_partkey", "p_brand")
        joined = (
            line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
        )
        key, num = F.col("l_orderkey"), F.col("l_linenumber")
        base = joined.select(
            ((key * 8 + num) * 1048576 + F.col("l_partkey") % 1048576).alias("seq"),
            F.substring("p_brand", 7, 9).cast("bigint").alias("k"),
            F.col("c_nationkey").cast("bigint").alias("nat"),
            ((key * 31 + num * 17 + F.col("l_partkey") * 7) % 100).alias("r"),
            # key * 2654435761 modulo 2**32, with factors small enough for any key.
            F.pmod(
                (key % 4294967296) * F.lit(2654435761 - 4294967296) + num, F.lit(4294967296)
            ).alias("resolver_ip"),
            "c_custkey",
        )
        asn = F.when(F.col("c_custkey") % 50 == 0, None).otherwise(
            100 + F.col("nat") * 2 + F.col("c_custkey") % 2
        )
        return base.select(
            "seq",
            _domain(F.col("k")).alias("domain"),
            "k",
            "nat",
            "r",
            "resolver_ip",
            asn.alias("resolver_asn"),
            _answer().alias("answer_ip"),
        )

    def store_raw(self) -> None:
        """For queries that read the responses several times: the joins run once."""
        self.obs_raw = materialize(self.obs_raw, "raw")

    @property
    def observations(self) -> DataFrame:
        """The central table as one plan from the order tables; for single use."""
        return self.obs_raw.groupBy("domain", "resolver_asn", "answer_ip").agg(
            F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def obs(self) -> DataFrame:
        """The central table, written once and read by every branch of a query."""
        return materialize(self.observations, "observations")

    @cached_property
    def answers(self) -> DataFrame:
        return self.obs.filter("answer_ip is not null").select("answer_ip").distinct()

    @cached_property
    def prefixes(self) -> DataFrame:
        ip = F.col("answer_ip")
        high = F.shiftright(ip, 16)
        public = self.answers.filter(ip >= FIRST_PUBLIC)
        wide = public.select(
            (ip - ip % 65536).alias("network"), F.lit(16).alias("prefix_len"), (1000 + high).alias("asn")
        )
        narrow = public.filter(F.shiftright(ip, 8) % 7 == 3).select(
            (ip - ip % 256).alias("network"), F.lit(24).alias("prefix_len"), (100000 + high).alias("asn")
        )
        return wide.distinct().unionByName(narrow.distinct())

    @cached_property
    def asn_country(self) -> DataFrame:
        known = self.prefixes.select("asn").unionByName(
            self.obs.filter("resolver_asn is not null").select(F.col("resolver_asn").alias("asn"))
        )
        asn = F.col("asn")
        number = (
            F.when(asn < 1000, F.floor((asn - 100) / 2.0))
            .when(asn.isin(16371, 115371), F.lit(11))
            .otherwise(asn % 25)
        )
        return known.distinct().select("asn", F.concat(F.lit("NATION_"), number.cast("string")).alias("country"))

    def _hosts(self) -> DataFrame:
        return self.answers.filter(F.col("answer_ip") >= FIRST_PUBLIC).select(
            F.col("answer_ip").alias("ip"), (F.shiftright("answer_ip", 16) % 256).alias("site")
        )

    @cached_property
    def ptrs(self) -> DataFrame:
        ip, site = F.col("ip"), F.col("site").cast("string")
        suffix = F.when(ip % 2 == 0, ".net").otherwise(".co.uk")
        name = F.concat(F.lit("host"), (ip % 256).cast("string"), F.lit(".cdn"), site, suffix)
        names = F.when(ip % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(name))
        return self._hosts().select("ip", names.alias("names"))

    @cached_property
    def servers(self) -> DataFrame:
        down = F.col("ip") % 13 == 0
        return self._hosts().select(
            "ip",
            F.when(down, 504).otherwise(200).alias("status"),
            F.when(down, "").otherwise(F.concat(F.lit("edge/"), F.col("site").cast("string"))).alias("server"),
        )

    @cached_property
    def whois_text(self) -> DataFrame:
        ip = F.col("ip")
        net = F.concat(F.lit("netname:  NET-"), F.shiftright("ip", 16).cast("string"), F.lit("\n"))
        noc = F.concat(F.lit("OrgNOCName: NOC "), (ip % 10).cast("string"), F.lit("\n"))
        text = F.concat(
            F.lit("inetnum: 1\n"),
            F.when(ip % 7 != 0, net).otherwise(""),
            F.when(ip % 3 == 0, noc).otherwise(""),
            F.lit("country: X"),
        )
        return self._hosts().select("ip", text.alias("text"))

    @cached_property
    def ip_domain(self) -> DataFrame:
        return ip_domain_counts(self.obs)

    @cached_property
    def net_domain(self) -> DataFrame:
        return network_domain_counts(self.obs)

    def hosted(self, sites: int) -> DataFrame:
        """Cells of many domains, ``sites`` for each brand: small groups on networks of their own, hosters
        with many domains, for some of which they carry most, and two networks that all domains are on."""
        site = F.col("seq") % 1048576 % sites
        name = F.concat(F.lit("d"), F.col("k").cast("string"), F.lit("s"), site.cast("string"), F.lit(".example"))
        place, r = F.col("k") * sites + site, F.col("r")
        index = (
            F.when(r < F.when(place % 5 == 0, 75).otherwise(25), 100000 + site % 40)
            .when(r < 90, F.floor(place / 3))
            .otherwise(200000 + r % 2)
        )
        net = F.when(r >= 97, F.lit(PLANTED_RESERVED - PLANTED_RESERVED % 256)).otherwise(FIRST_HOSTED + index * 256)
        cells = self.obs_raw.select(name.alias("domain"), net.cast("bigint").alias("net"))
        return materialize(cells.groupBy("domain", "net").agg(F.count(F.lit(1)).alias("n")), "hosted")

    @cached_property
    def domain_keys(self) -> DataFrame:
        k = F.regexp_extract("domain", r"^d(\d+)", 1).cast("bigint")
        return self.obs.select("domain", k.alias("k")).distinct()

    @cached_property
    def clusters(self) -> DataFrame:
        """Shared-hosting domains grouped by their planted network, the others alone."""
        k = F.col("k")
        group = F.when(k % 4 == 2, k % 3).otherwise(100 + k).cast("int")
        return self.domain_keys.select("domain", group.alias("cluster_id"))

    @cached_property
    def shards(self) -> DataFrame:
        return materialize(
            shard_domains(self.domain_keys.withColumnRenamed("k", "rank"), 10), "shards"
        )

    @cached_property
    def resolvers(self) -> DataFrame:
        return self.obs_raw.select(F.col("resolver_ip").alias("ip")).distinct()

    @cached_property
    def stored_resolvers(self) -> DataFrame:
        return materialize(self.resolvers, "resolvers")

    @cached_property
    def resolver_prefixes(self) -> DataFrame:
        """Routes for the resolvers: /12 blocks, a third of them missing."""
        ip = F.col("ip")
        block = F.shiftright(ip, 20)
        return (
            self.stored_resolvers.select((ip - ip % 1048576).alias("network"), block.alias("block"))
            .distinct()
            .filter("block % 3 <> 0")
            .select("network", F.lit(12).alias("prefix_len"), (100 + F.col("block") % 50).alias("asn"))
        )

    @cached_property
    def responses(self) -> DataFrame:
        """Each observation as a DNS response packet in hex, some of them damaged."""
        r, k, ip = F.col("r"), F.col("k"), F.col("answer_ip")
        asked_k = F.when(r == 42, F.lit(0).cast("bigint")).when(r == 43, k - k % 10 + 1).otherwise(k)
        label = F.col("label")
        # Values used several times become columns of their own, so they are computed once.
        named = (
            self.obs_raw.withColumn("label", F.concat(F.lit("d"), asked_k.cast("string")))
            .withColumn(
                "name",
                F.concat(F.lpad(F.hex(F.length(label)), 2, "0"), F.hex(label), F.lit("076578616d706c6500")),
            )
            .withColumn("owner", F.when(r % 2 == 1, F.col("name")).otherwise("c00c"))
            .withColumn("rr", F.concat("owner", F.lit("000100010000003c0004")))
        )
        records = F.when(ip.isNull(), 0).otherwise(
            1 + (r % 10 == 4).cast("int") + (k % 4 == 1).cast("int")
        )
        flags = F.when(r == 9, 0x0180).when(r == 7, 0x8100).otherwise(0x8180)
        packet = F.concat(
            F.lpad(F.hex(F.col("seq") % 65536), 4, "0"),
            F.lpad(F.hex(flags + F.when(ip.isNull(), 3).otherwise(0)), 4, "0"),
            F.lit("0001"),
            F.lpad(F.hex(records), 4, "0"),
            F.lit("00000000"),
            F.col("name"),
            F.lit("00010001"),
            F.when(ip.isNotNull() & (k % 4 == 1), F.concat("owner", F.lit("000500010000003c0002c00c"))).otherwise(""),
            F.when(ip.isNotNull(), F.concat("rr", F.lpad(F.hex(ip), 8, "0"))).otherwise(""),
            F.when(
                ip.isNotNull() & (r % 10 == 4), F.concat("rr", F.lpad(F.hex(ip + 1), 8, "0"))
            ).otherwise(""),
        )
        whole = named.withColumn("packet", packet)
        size = F.length("packet")
        sent = (
            F.when(r == 5, F.substring("packet", F.lit(1), size - 4))
            .when(r == 6, F.substring("packet", F.lit(1), size - 1))
            .when(r == 8, F.substring("packet", 1, 10))
            .otherwise(F.col("packet"))
        )
        return whole.select(
            "seq", "domain", "r", "resolver_ip", "resolver_asn", sent.alias("data_hex")
        )

    def probe_scan_files(self) -> str:
        """Probe replies as CSV text; rows with r = 1 carry a field too many."""
        path = self.scratch("probe-scan")
        line = F.concat_ws(
            ",",
            format_ip("resolver_ip"),
            F.col("seq").cast("string"),
            F.when(F.col("r") == 1, "x"),
            F.col("data_hex"),
        )
        self.responses.select(line.alias("value")).write.text(path)
        return path

    def domain_scan_files(self) -> tuple[str, str]:
        """Domain scan as one folder per shard, and the domain lists beside it."""
        scans, lists = self.scratch("domain-scan"), self.scratch("shard-domains")
        shards = self.shards
        rows = self.responses.join(shards, "domain")
        probe = F.when(F.col("r") == 44, F.lit(99)).otherwise(F.col("idx"))
        line = F.concat_ws(
            ",",
            format_ip("resolver_ip"),
            F.when(F.col("r") != 45, probe.cast("string")),
            F.col("seq").cast("string"),
            F.col("data_hex"),
        )
        with unsorted_partitions(self.spark):
            rows.select("shard", line.alias("value")).write.partitionBy("shard").text(scans)
        names = F.transform(F.sort_array(F.collect_list(F.struct("idx", "domain"))), lambda s: s["domain"])
        shards.groupBy("shard").agg(F.to_json(names).alias("value")).write.partitionBy("shard").text(lists)
        return scans, lists

    @cached_property
    def favicons(self) -> DataFrame:
        """Icon fetches: one per address and domain, some refused, missing or wrong."""
        ip, k = F.col("ip"), F.col("k")
        failed = (-1 - ip % 5).cast("int")
        status = F.when((ip + k) % 17 == 0, failed).when((ip + k) % 19 == 0, 404).otherwise(200)
        served = F.when(ip % 5 == 0, F.concat(F.lit("x"), F.col("host"))).otherwise(F.col("host"))
        pairs = self.obs.filter("answer_ip is not null").select(
            F.col("answer_ip").alias("ip"), F.col("domain").alias("host")
        )
        keyed = pairs.distinct().join(self.domain_keys.withColumnRenamed("domain", "host"), "host")
        return keyed.select(
            "ip",
            "host",
            status.alias("status"),
            (1000 + k).alias("length"),
            F.when(status == 200, F.md5(served)).otherwise("").alias("hash"),
            F.lit("image/x-icon").alias("ctype"),
            k.alias("seq"),
        )

    @cached_property
    def favicon_fetches(self) -> DataFrame:
        """Icons fetched from the sites themselves; one site in seven has none."""
        return self.domain_keys.select(
            F.col("domain").alias("host"),
            F.when(F.col("k") % 7 == 0, 404).otherwise(200).alias("status"),
            F.md5("domain").alias("hash"),
            F.col("k").alias("seq"),
        )

    @cached_property
    def http_scans(self) -> DataFrame:
        """Four liveness scans; an address repeats once per domain it answered for."""
        pairs = self.obs.filter("answer_ip is not null").select(F.col("answer_ip").alias("ip"), "domain")
        ip = F.col("ip")
        hit = [ip % 3 != 0, ip % 4 != 0, ip % 5 != 0, ip % 7 != 1]
        found = [
            F.when(h, F.struct(F.lit(port).alias("port"), F.lit(mode).alias("mode")))
            for h, (port, mode) in zip(hit, HTTP_SCANS)
        ]
        rows = pairs.distinct().select("ip", F.explode(F.array(*found)).alias("s"))
        return rows.filter("s is not null").select("s.port", "s.mode", "ip")

    @cached_property
    def redirects(self) -> DataFrame:
        """First HTTP reply of each domain: two thirds redirect to a sibling."""
        k = F.col("k")
        target = k - k % 10 + (k % 10) % 5 + 1
        location = F.concat(F.lit("https://"), _domain(target), F.lit("/start"))
        return self.domain_keys.select(
            "domain",
            F.when(k % 3 != 0, 301).otherwise(200).alias("status"),
            location.alias("location"),
        )
