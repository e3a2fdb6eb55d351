"""Readers for the file formats a measurement run leaves behind.

Readers take lines, or the pieces between closing braces, so files split across tasks. Malformed lines are
dropped; a two-level object that doesn't parse is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dns import response_fields
from ..functions.ip import class_c, ip_to_long
from ..functions.text import asn_or_unknown
from ..schema import EMPTY

# Patterns of the two routing sources.
ORIGIN_PREFIX = r'IN TXT\s+"(\d+)" "(\d+\.\d+\.\d+\.\d+)" "(\d+)"'
ASN_REPORT = r"\d+.*AS(\d+).*,([A-Z]{2})"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with ``seq``, which grows with the position inside a file."""
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def _csv_fields(df: DataFrame, names: list[str]) -> DataFrame:
    parts = F.split("value", ",", -1)
    kept = df.filter(F.size(parts) == len(names))
    return kept.select(
        *[parts.getItem(i).alias(n) for i, n in enumerate(names)],
        *[c for c in df.columns if c != "value"],
    )


def read_probe_scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Probe-scan lines with exactly three fields, still undecoded."""
    return _csv_fields(_lines(spark, path), ["resolver_ip", "ts", "data_hex"])


def read_probe_scan(spark: SparkSession, path: str) -> DataFrame:
    """Decodable probe responses with their header fields and addresses."""
    raw = read_probe_scan_raw(spark, path)
    return response_fields(raw).filter("ok").drop("ok")


def _file_or_folder(marker: str) -> tuple[Column, Column]:
    """Name of a line's file, and the value of its ``marker=value`` folder or NULL.

    Runs for every line, so it keeps to plain substring operations.
    """
    path = F.col("_metadata.file_path")
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    value = F.when(folder.startswith(f"{marker}="), F.substring(folder, len(marker) + 2, 1 << 20))
    return F.substring_index(path, "/", -1), value


def _shard_name(extension: str) -> Column:
    file, folder = _file_or_folder("shard")
    in_name = F.substring(file, F.lit(1), F.length(file) - len(extension) - 1)
    return F.coalesce(F.substring_index(folder, ".", 1), in_name)


def read_shard_domains(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Domain list of every shard: one JSON array per ``<shard>.json``, names in lower case."""
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path)
        .select(_shard_name("json").alias("shard"), F.from_json("value", "array<string>").alias("d"))
    )
    listed = text.select("shard", F.posexplode("d").alias("idx", "domain"))
    return listed.withColumn("domain", F.lower("domain"))


def read_domain_scan(
    spark: SparkSession,
    scans: str,
    shards: str | None = None,
    pattern: str = "*.csv",
    shard_pattern: str = "*.json",
) -> DataFrame:
    """Responses of a domain scan with the domain each probe asked for.

    Files are ``<shard>.csv`` with a ``<shard>.json`` beside them, or part files in
    ``shard=<shard>`` folders. Files without a domain list and probes outside it fall away
    in the join.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(scans)
    return domain_scan_rows(text, read_shard_domains(spark, shards or scans, shard_pattern))


def domain_scan_rows(text: DataFrame, shard_domains: DataFrame) -> DataFrame:
    """Parse scan lines of a text source and attach the asked domain."""
    return asked_domains(scan_fields(text), shard_domains)


def scan_fields(text: DataFrame) -> DataFrame:
    """``shard, resolver_ip, probe, ts, data_hex`` of the scan lines of a batch or streaming text source."""
    lines = text.select("value", _shard_name("csv").alias("shard"))
    rows = _csv_fields(lines, ["resolver_ip", "probe", "ts", "data_hex"])
    return rows.withColumn("probe", F.col("probe").try_cast("int"))


def asked_domains(rows: DataFrame, shard_domains: DataFrame) -> DataFrame:
    return rows.join(shard_domains.withColumnRenamed("idx", "probe"), ["shard", "probe"]).select(
        "shard", "resolver_ip", "probe", "ts", "domain", "data_hex"
    )


def _observation_entries(spark: SparkSession, path: str) -> DataFrame:
    fields = F.from_json("value", "map<string,string>")
    entry = spark.read.text(path).select(fields.alias("e")).filter(F.col("e.name").isNotNull())
    return entry.select(F.col("e.name").alias("domain"), F.explode("e").alias("key", "body"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """``{name, failed, asn: {ip: n}}`` lines to ``domain, resolver_asn, answer_ip, n``."""
    entries = _observation_entries(spark, path).filter(~F.col("key").isin("name", "failed"))
    answers = entries.select(
        "domain",
        asn_or_unknown("key").alias("resolver_asn"),
        F.explode(F.from_json("body", "map<string,bigint>")).alias("answer", "n"),
    )
    ip = ip_to_long("answer")
    return (
        answers.withColumn("answer_ip", ip)
        .filter((F.col("answer") == EMPTY) | F.col("answer_ip").isNotNull())
        .groupBy("domain", "resolver_asn", "answer_ip")
        .agg(F.sum("n").alias("n"))
    )


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failed responses per domain; a domain listed without failures has 0."""
    entries = _observation_entries(spark, path)
    failed = F.when(F.col("key") == "failed", F.col("body").try_cast("bigint"))
    return entries.groupBy("domain").agg(F.coalesce(F.sum(failed), F.lit(0)).alias("failed"))


# A key and the start of its object, after what closes and separates the objects before it.
_OBJECT = r'^[\s,{]*("(?:[^"\\]|\\.)*+")\s*:\s*\{([\s\S]*)$'


def read_count_map(
    spark: SparkSession,
    path: str,
    cols: tuple[str, str, str],
    value_type: str = "bigint",
    malformed: str = "fail",
) -> DataFrame:
    """Two-level JSON objects, one or many per file, formatted or not, to ``(k1, k2, value)`` rows.

    Files are cut at closing braces, not at lines: a task of any byte range goes on at the next inner
    object, so one large object is read by many tasks, each holding one inner object at a time. Text that
    doesn't parse ends the query, or with ``malformed="drop"`` is left out. A brace inside a string
    must be escaped (``\\u007d``), as ``write_count_map`` does it.
    """
    if malformed not in ("fail", "drop"):
        raise ValueError(f"malformed is fail or drop, not {malformed!r}")
    k1, k2, value = cols
    pieces = spark.read.text(path, lineSep="}")
    body = F.regexp_extract("value", _OBJECT, 2)
    key = F.from_json(F.concat(F.lit("["), F.regexp_extract("value", _OBJECT, 1), F.lit("]")), "array<string>")
    inner = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"map<string,{value_type}>")
    found = pieces.select("value", F.get(key, F.lit(0)).alias(k1), F.when(F.col("value").rlike(_OBJECT), inner).alias("m"))
    if malformed == "fail":
        said = F.concat(F.lit("not a two-level object: "), F.substring("value", 1, 200))
        checked = F.coalesce("m", F.raise_error(said).cast(f"map<string,{value_type}>"))
        found = found.withColumn("m", F.when(~F.col("value").rlike(r"^[\s,{]*$"), checked))
    return found.select(k1, F.explode("m").alias(k2, value))


def distinct_keys(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


# Layout of one line per kind: position 0 is the address, the rest as given here.
_KEYED = {
    "ptrs": [("names", "array<string>")],
    "servers": [("status", "int"), ("server", "string")],
    "whois": [("org", "string")],
}


def read_keyed_jsonlines(
    spark: SparkSession, path: str, kind: str, by_network: bool = False
) -> DataFrame:
    """JSON-array lines keyed by address (or its /24); the last line of a key wins."""
    lines = _lines(spark, path).withColumn("a", F.from_json("value", "array<string>"))
    text = F.try_element_at("a", F.lit(1))
    address = F.coalesce(ip_to_long(text), text.try_cast("bigint"))
    key, name = (class_c(address), "net") if by_network else (address, "ip")
    payload = []
    for i, (col, dtype) in enumerate(_KEYED[kind]):
        raw = F.try_element_at("a", F.lit(i + 2))
        payload.append((F.from_json(raw, dtype) if dtype.startswith("array") else raw.try_cast(dtype)).alias(col))
    rows = lines.select(key.alias(name), F.struct(*payload).alias("p"), "seq")
    last = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.max_by("p", "seq").alias("p"))
    return last.select(name, "p.*")


def read_favicons(spark: SparkSession, path: str) -> DataFrame:
    """``[ip, {host: [status, length, hash, type]}]`` lines, last line of an address wins."""
    lines = _lines(spark, path).withColumn("a", F.from_json("value", "array<string>"))
    rows = lines.select(
        ip_to_long(F.try_element_at("a", F.lit(1))).alias("ip"),
        F.from_json(F.try_element_at("a", F.lit(2)), "map<string,array<string>>").alias("hosts"),
        "seq",
    ).filter("ip is not null and hosts is not null")
    # Keyed by (ip, host): the hosts of one address stay spread out, then older lines go.
    newest = rows.groupBy("ip").agg(F.max("seq").alias("seq"))
    hosts = rows.select("ip", "seq", F.explode("hosts").alias("host", "r"))
    item = [F.try_element_at("r", F.lit(i)) for i in (1, 2, 3, 4)]
    return hosts.join(newest, ["ip", "seq"]).select(
        "ip",
        "host",
        item[0].try_cast("int").alias("status"),
        item[1].try_cast("bigint").alias("length"),
        item[2].alias("hash"),
        item[3].alias("ctype"),
    )


def read_origin_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """BGP origin zone lines to the prefix table; a repeated prefix keeps its last line.

    A base inside a /24 stands for that /24.
    """
    part = [F.regexp_extract("value", ORIGIN_PREFIX, i) for i in (1, 2, 3)]
    rows = _lines(spark, path).select(
        class_c(ip_to_long(part[1])).alias("network"),
        part[2].try_cast("int").alias("prefix_len"),
        part[0].try_cast("bigint").alias("asn"),
        "seq",
    )
    return (
        rows.filter("network is not null and asn is not null")
        .groupBy("network", "prefix_len")
        .agg(F.max_by("asn", "seq").alias("asn"))
    )


def read_prefix_map(spark: SparkSession, path: str) -> DataFrame:
    """Stored prefix table ``{start: {length: asn}}``; starts written as signed are unwrapped."""
    rows = read_count_map(spark, path, ("network", "prefix_len", "asn"))
    return rows.select(
        F.pmod(F.col("network").try_cast("bigint"), F.lit(4294967296)).alias("network"),
        F.col("prefix_len").try_cast("int").alias("prefix_len"),
        "asn",
    ).filter("network is not null and prefix_len is not null")


def read_country_asns(spark: SparkSession, path: str) -> DataFrame:
    """``{country: [asn]}`` to ``asn, country``; an ASN may be listed under several countries."""
    lists = spark.read.text(path).select(
        F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("country", "asns")
    )
    return lists.select(F.explode("asns").alias("asn"), "country").distinct()


def read_asn_country_report(spark: SparkSession, path: str) -> DataFrame:
    """AS report lines ending in a country code; the last line of an AS wins."""
    rows = _lines(spark, path).select(
        F.regexp_extract("value", ASN_REPORT, 1).try_cast("bigint").alias("asn"),
        F.regexp_extract("value", ASN_REPORT, 2).alias("country"),
        "seq",
    )
    return rows.filter("asn is not null").groupBy("asn").agg(F.max_by("country", "seq").alias("country"))


def read_resolver_list(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """``ip/32`` lines, or with ``fmt="json"`` objects ``{ip: true}``; other keys are dropped."""
    lines = spark.read.text(path)
    if fmt == "json":
        lines = lines.select(F.explode(F.from_json("value", "map<string,boolean>")).alias("value", "listed"))
        lines = lines.filter("listed")
    ip = ip_to_long(F.split_part("value", F.lit("/"), F.lit(1)))
    return lines.select(ip.alias("ip")).filter("ip is not null")


def read_expected_ip(spark: SparkSession, path: str) -> int | None:
    """Address a probe should be answered with, from the one-line file beside its scan."""
    row = spark.read.text(path).select(ip_to_long("value").alias("ip")).filter("ip is not null").first()
    return row and row["ip"]


class HttpScans:
    """Liveness scans listed in a manifest ``[{name, port, mode}]``, read in one pass."""

    def __init__(self, spark: SparkSession, manifest: str, base: str):
        self.manifest = (
            spark.read.schema("name string, port int, mode string")
            .option("multiLine", True)
            .json(manifest)
        )
        base_name = F.regexp_extract("name", r"([^/]+)$", 1)
        scan = F.coalesce(*reversed(_file_or_folder("scan")))
        rows = spark.read.option("recursiveFileLookup", True).text(base).select(
            scan.alias("scan"), ip_to_long("value").alias("ip")
        )
        listed = self.manifest.select(base_name.alias("scan"), "port", "mode")
        self.rows = rows.filter("ip is not null").join(listed, "scan").select("port", "mode", "ip")

    def ports(self) -> DataFrame:
        return self.manifest.select("port").distinct()

    def modes(self) -> DataFrame:
        return self.manifest.select("mode").distinct()

    def with_port(self, port: int) -> DataFrame:
        return self.rows.filter(F.col("port") == port)

    def with_mode(self, mode: str) -> DataFrame:
        return self.rows.filter(F.col("mode") == mode)


def read_http_scans(spark: SparkSession, manifest: str, base: str) -> HttpScans:
    return HttpScans(spark, manifest, base)
