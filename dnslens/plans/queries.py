"""Registered queries: every operator over the whole derived tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dns, ip, text
from ..operators import (
    clusters,
    filters,
    interference,
    joins,
    pairs,
    ranking,
    rollups,
    scoring,
    setops,
    similarity,
    validation,
)
from ..session import materialize
from ..sources import readers, sinks
from .adapter import EXPECTED_IP, HTTP_SCANS, Inputs
from .oracles import dotted, hosted, reserved, with_common

Query = Callable[[Inputs], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SCORE_CUT = 5.0
SIMILARITY_ROUNDS = 6
# Domains derived for each brand, for the queries over many domains; SQL replays VOTE one domain at a time.
SITES, VOTED_SITES = 128, 8
SCAN_PAIRS = [
    (HTTP_SCANS[0], HTTP_SCANS[1]),
    (HTTP_SCANS[2], HTTP_SCANS[3]),
    (HTTP_SCANS[0], HTTP_SCANS[2]),
    (HTTP_SCANS[1], HTTP_SCANS[3]),
]
REPORT_META = {
    "software_name": "dnslens",
    "software_version": "1.0",
    "probe_asn": "AS0",
    "probe_cc": "ZZ",
    "probe_ip": "127.0.0.1",
    "report_id": "run",
}


def query(name: str, sql: str | None = None, rounds: int = 0, extra: str = ""):
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_common(sql, rounds, extra)
        return fn

    return register


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r6(c) -> F.Column:
    return F.round(c, 6)


def _joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- sources and sinks -----------------------------------------------------------------

_FIELDS = ["qr", "ra", "rcode", "qdcount", "ancount", "qname"]
_RESPONSE_SQL = (
    "qr, ra, rcode, 1 AS qdcount, ancount, qname, array_to_string(a_records, ',') AS answers, first_a"
)


@query(
    "read_probe_scan",
    f"SELECT {dotted('resolver_ip')} AS resolver_ip, CAST(seq AS VARCHAR) AS ts, {_RESPONSE_SQL} FROM responses WHERE r <> 1 AND ok",
)
def _(i: Inputs):
    scan = readers.read_probe_scan(i.spark, i.probe_scan_files())
    return scan.select("resolver_ip", "ts", *_FIELDS, _joined("a_records").alias("answers"), "first_a")


def _domain_scan(i: Inputs) -> DataFrame:
    i.store_raw()
    scans, lists = i.domain_scan_files()
    return readers.read_domain_scan(i.spark, scans, lists, "*.txt", "*.txt")


@query(
    "read_domain_scan",
    f"SELECT shard, {dotted('resolver_ip')} AS resolver_ip, idx AS probe, CAST(seq AS VARCHAR) AS ts, domain "
    "FROM responses JOIN shards USING (domain) WHERE r NOT IN (44, 45)",
)
def _(i: Inputs):
    return _domain_scan(i).drop("data_hex")


def _observation_files(i: Inputs) -> str:
    path = i.scratch("observation-lines")
    failures = i.domain_keys.select("domain", F.col("k").alias("failed"))
    domains = i.domain_keys.select("domain").unionByName(
        i.domain_keys.select(F.concat(F.lit("silent-"), "domain").alias("domain"))
    )
    sinks.write_observations(i.obs, failures, domains, path)
    return path


@query("read_observations", "SELECT domain, resolver_asn, answer_ip, n FROM observations")
def _(i: Inputs):
    return readers.read_observations(i.spark, _observation_files(i))


@query(
    "write_observations",
    "SELECT domain, k AS failed FROM domain_keys UNION ALL SELECT 'silent-' || domain, 0 FROM domain_keys",
)
def _(i: Inputs):
    return readers.read_failures(i.spark, _observation_files(i))


@query("read_count_map", "SELECT ip, domain, n FROM ip_domain")
def _(i: Inputs):
    path = i.scratch("ip-domain")
    sinks.write_count_map(i.ip_domain, "ip", "domain", "n", path)
    rows = readers.read_count_map(i.spark, path, ("ip", "domain", "n"))
    return rows.withColumn("ip", F.col("ip").cast("bigint"))


@query("write_count_map", "SELECT net, domain, n FROM net_domain")
def _(i: Inputs):
    path = i.scratch("domain-net")
    sinks.write_count_map(i.net_domain, "domain", "net", "n", path)
    rows = readers.read_count_map(i.spark, path, ("domain", "net", "n"))
    return rows.withColumn("net", F.col("net").cast("bigint"))


@query("read_keyed_jsonlines", "SELECT ip, status, server FROM servers")
def _(i: Inputs):
    path = i.scratch("servers")
    lines = i.servers.select(
        "ip", F.explode(F.array(F.lit(0), F.lit(1))).alias("try"), "status", "server"
    )
    text_line = F.concat(
        F.lit('["'), ip.format_ip("ip"), F.lit('",'),
        F.when(F.col("try") == 0, F.lit('500,"old"]')).otherwise(
            F.concat(F.col("status").cast("string"), F.lit(',"'), "server", F.lit('"]'))
        ),
    )
    ordered = lines.repartition("ip").sortWithinPartitions("ip", "try")
    ordered.select(text_line.alias("value")).write.text(path)
    return readers.read_keyed_jsonlines(i.spark, path, "servers")


@query("read_favicons", "SELECT ip, host, status, length, hash, ctype FROM favicons")
def _(i: Inputs):
    path = i.scratch("favicons")
    values = F.array(F.col("status").cast("string"), F.col("length").cast("string"), "hash", "ctype")
    hosts = i.favicons.groupBy("ip").agg(F.map_from_entries(F.collect_list(F.struct("host", values))).alias("m"))
    hosts.select(
        F.concat(F.lit('["'), ip.format_ip("ip"), F.lit('",'), F.to_json("m"), F.lit("]")).alias("value")
    ).write.text(path)
    return readers.read_favicons(i.spark, path)


@query("read_origin_prefixes", "SELECT network, prefix_len, asn FROM prefixes")
def _(i: Inputs):
    path = i.scratch("origins")
    rows = i.prefixes.select("network", "prefix_len", "asn", F.explode(F.array(F.lit(1), F.lit(0))).alias("old"))
    line = F.concat(
        F.lit('x IN TXT  "'), (F.col("asn") + F.col("old")).cast("string"), F.lit('" "'),
        ip.format_ip(F.col("network") + F.col("asn") % 256), F.lit('" "'), F.col("prefix_len").cast("string"), F.lit('"'),
    )
    ordered = rows.repartition("network", "prefix_len").sortWithinPartitions(
        "network", "prefix_len", F.desc("old")
    )
    ordered.select(F.explode(F.array(line, F.lit("x IN A 1.2.3.4"))).alias("value")).write.text(path)
    return readers.read_origin_prefixes(i.spark, path)


@query(
    "read_asn_country_report",
    "SELECT asn, chr(CAST(65 + asn % 26 AS INTEGER)) || chr(CAST(65 + asn % 7 AS INTEGER)) AS country FROM asn_country WHERE asn % 5 <> 0",
)
def _(i: Inputs):
    path = i.scratch("asn-report")
    asn = F.col("asn")
    code = F.concat(F.char(65 + asn % 26), F.char(65 + asn % 7))
    entry = F.concat(F.lit("1 AS"), asn.cast("string"), F.lit(" EXAMPLE"))
    line = F.when(asn % 5 == 0, entry).otherwise(F.concat(entry, F.lit(","), code))
    i.asn_country.select(line.alias("value")).write.text(path)
    return readers.read_asn_country_report(i.spark, path)


@query("read_resolver_list", "SELECT ip FROM resolvers")
def _(i: Inputs):
    path = i.scratch("resolvers")
    sinks.write_resolver_list(i.resolvers, path)
    return readers.read_resolver_list(i.spark, path)


@query("write_resolver_list", "SELECT ip FROM resolvers")
def _(i: Inputs):
    path = i.scratch("resolvers-json")
    sinks.write_resolver_list(i.resolvers, path, fmt="json")
    return readers.read_resolver_list(i.spark, path, fmt="json")


@query(
    "read_http_scans",
    "SELECT 'port' AS side, port, mode, count(*) AS n, count(DISTINCT ip) AS ips FROM http_scans GROUP BY 1, 2, 3 "
    "UNION ALL SELECT 'mode', port, mode, count(*), count(DISTINCT ip) FROM http_scans GROUP BY 1, 2, 3",
)
def _(i: Inputs):
    base, manifest = i.scratch("http"), i.scratch("manifest")
    name = F.concat(F.col("port").cast("string"), F.lit("-"), "mode", F.lit(".csv"))
    scans = i.http_scans
    scans.select(name.alias("scan"), ip.format_ip("ip").alias("value")).write.partitionBy("scan").text(base)
    listed = scans.select(F.concat(F.lit("run/"), name).alias("name"), "port", "mode").distinct()
    listed.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(manifest)
    found = readers.read_http_scans(i.spark, manifest, base)
    ports = sorted({port for port, _ in HTTP_SCANS})
    modes = sorted({mode for _, mode in HTTP_SCANS})
    sides = [found.with_port(p).withColumn("side", F.lit("port")) for p in ports]
    sides += [found.with_mode(m).withColumn("side", F.lit("mode")) for m in modes]
    return reduce(DataFrame.unionByName, sides).groupBy("side", "port", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ip").alias("ips")
    )


@query(
    "ooni_records",
    "SELECT record_type, input, CAST(chunk AS BIGINT) AS chunk, CAST(n AS INTEGER) AS queries, first_resolver, addrs, asked, CAST(start AS DOUBLE) AS start_time, "
    "'dns' AS test_name, '1.0.0' AS test_version, 'dnslens' AS software_name, '1.0' AS software_version, 'AS0' AS probe_asn, 'ZZ' AS probe_cc, "
    "'127.0.0.1' AS probe_ip, 'run' AS report_id FROM ("
    "SELECT 'entry' AS record_type, d.domain AS input, d.chunk, any_value(t.start) AS start, count(q.seq) AS n, min(CASE WHEN q.seq IS NOT NULL THEN '53 A [Query(''<' || d.domain || '>'',1,1)]' END) AS asked, min(q.rs) AS first_resolver, string_agg(q.addrs, ';' ORDER BY q.seq) AS addrs "
    "FROM (SELECT domain, unnest(generate_series(0, CAST(floor(count(x.seq) / 10001) AS BIGINT))) AS chunk FROM shards LEFT JOIN x USING (domain) GROUP BY domain) d "
    "LEFT JOIN x q ON q.domain = d.domain AND floor((q.rn - 1) / 10001) = d.chunk JOIN starts t ON t.domain = d.domain GROUP BY 1, 2, 3 "
    "UNION ALL SELECT 'header', NULL, NULL, 0, NULL, NULL, NULL, NULL UNION ALL SELECT 'footer', NULL, NULL, 1, NULL, NULL, NULL, NULL) t",
    extra=f"x AS (SELECT seq, domain, {dotted('resolver_ip')} AS rs, array_to_string(a_records, ',') AS addrs, "
    "row_number() OVER (PARTITION BY domain ORDER BY seq) AS rn FROM responses WHERE ok AND len(a_records) > 0 AND qname = domain), "
    "starts AS (SELECT domain, 1000 + min(k) OVER (PARTITION BY shard) AS start FROM shards JOIN domain_keys USING (domain))",
)
def _(i: Inputs):
    i.store_raw()
    decoded = dns.response_fields(i.responses)
    mine = decoded.filter((F.size("a_records") > 0) & (F.col("qname") == F.col("domain")))
    mine = mine.join(i.shards.select("shard", "domain"), "domain").select(
        "shard", "domain", "seq", ip.format_ip("resolver_ip").alias("resolver_ip"), "a_records"
    )
    addrs = F.transform("a_records", lambda x: x.cast("string"))
    rows = materialize(mine.withColumn("addrs", addrs).drop("a_records"), "answered")
    starts = i.shards.join(i.domain_keys, "domain").groupBy("shard").agg((1000 + F.min("k")).alias("start_time"))
    records = sinks.ooni_records(rows, i.shards, REPORT_META, run_time=0.0, scan_time=starts, now=1.0)
    per_query = F.transform("queries", lambda q: F.array_join(q["addrs"], ","))
    asked = lambda q: F.concat_ws(" ", q["resolver_port"], q["query_type"], q["query"])
    count = F.when(F.col("record_type") == "entry", F.coalesce(F.size("queries"), F.lit(0)))
    return records.select(
        "record_type",
        "input",
        "chunk",
        F.when(count < 0, 0).otherwise(count).alias("queries"),
        F.array_min(F.col("queries.resolver_ip")).alias("first_resolver"),
        F.array_join(per_query, ";").alias("addrs"),
        F.array_join(F.array_distinct(F.transform("queries", asked)), ";").alias("asked"),
        "start_time",
        "test_name",
        "test_version",
        *REPORT_META,
    )


@query("split_by_asn", "SELECT ip, CAST(asn AS INTEGER) AS asn FROM lpm")
def _(i: Inputs):
    path = i.scratch("by-asn")
    sinks.split_by_asn(i.answers.withColumnRenamed("answer_ip", "ip"), i.prefixes, path)
    return i.spark.read.schema("ip bigint, asn int").parquet(path)


@query("distinct_keys", "SELECT DISTINCT ip FROM ip_domain")
def _(i: Inputs):
    return readers.distinct_keys(rollups.ip_domain_counts(i.observations), "ip")


# --- scalar functions ------------------------------------------------------------------


@query(
    "decode_dns_responses",
    "SELECT seq, ok, CASE WHEN NOT headless THEN qr END AS qr, CASE WHEN NOT headless THEN ra END AS ra, "
    "CASE WHEN NOT headless THEN rcode END AS rcode, CASE WHEN NOT headless THEN 1 END AS qdcount, "
    "CASE WHEN NOT headless THEN ancount END AS ancount, CASE WHEN ok THEN qname END AS qname, "
    "CASE WHEN ok THEN array_to_string(a_records, ',') ELSE '' END AS answers, CASE WHEN ok THEN first_a END AS first_a FROM responses",
)
def _(i: Inputs):
    return dns.response_fields(i.responses).select(
        "seq", "ok", *_FIELDS, _joined("a_records").alias("answers"), "first_a"
    )


_ALL_IPS = "(SELECT DISTINCT resolver_ip AS ip FROM obs_raw) t"


@query("ip_to_long", f"SELECT {dotted('ip')} AS text, ip FROM {_ALL_IPS}")
def _(i: Inputs):
    dotted_text = i.resolvers.select(ip.format_ip("ip").alias("text"))
    return dotted_text.select("text", ip.ip_to_long("text").alias("ip"))


@query("format_ip", f"SELECT ip, {dotted('ip')} AS text FROM {_ALL_IPS}")
def _(i: Inputs):
    return i.resolvers.select("ip", ip.format_ip("ip").alias("text"))


@query(
    "class_c",
    f"SELECT ip - ip % 256 AS net, min(ip - ip % 65536) AS wide, count(*) AS n FROM {_ALL_IPS} GROUP BY 1",
)
def _(i: Inputs):
    nets = i.resolvers.select(ip.class_c("ip").alias("net"), ip.prefix("ip", 16).alias("wide"))
    return nets.groupBy("net").agg(F.min("wide").alias("wide"), F.count(F.lit(1)).alias("n"))


@query("is_reserved", f"SELECT ip, {reserved('ip')} AS reserved FROM {_ALL_IPS}")
def _(i: Inputs):
    return i.resolvers.select("ip", ip.is_reserved("ip").alias("reserved"))


@query("ptr_base_domain", "SELECT ip, ptr FROM ptr_label")
def _(i: Inputs):
    name = F.try_element_at("names", F.lit(1))
    return i.ptrs.select("ip", text.ptr_base_domain(name).alias("ptr"))


@query(
    "clean_metadata_tag",
    "SELECT ip, CASE WHEN len(p) > 2 AND length(p[1]) > 5 THEN array_to_string(p[2:], '.') ELSE lower(name) END AS tag "
    "FROM (SELECT ip, name, string_split(lower(name), '.') AS p FROM ptrs) t",
)
def _(i: Inputs):
    name = F.concat(F.lit(" "), F.upper(F.try_element_at("names", F.lit(1))), F.lit(" "))
    return i.ptrs.select("ip", text.clean_metadata_tag(name).alias("tag"))


@query("whois_org", "SELECT ip, org FROM whois")
def _(i: Inputs):
    return i.whois_text.select("ip", text.whois_org("text").alias("org"))


@query(
    "redirect_host",
    "SELECT status, host, count(*) AS n FROM (SELECT 200 + 100 * (r % 3) AS status, "
    "CASE WHEN r % 3 = 1 AND r % 5 <> 0 THEN domain END AS host FROM obs_raw) t GROUP BY 1, 2",
)
def _(i: Inputs):
    r = F.col("r")
    location = F.when(r % 5 == 0, "/relative").otherwise(F.concat(F.lit("https://"), "domain", F.lit("/x")))
    replies = i.obs_raw.select((200 + 100 * (r % 3)).alias("status"), location.alias("location"))
    return (
        replies.withColumn("host", text.redirect_host("status", "location"))
        .groupBy("status", "host")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("asn_or_unknown", "SELECT resolver_asn AS asn, count(*) AS n FROM obs_raw GROUP BY 1")
def _(i: Inputs):
    marked = F.coalesce(F.col("resolver_asn").cast("string"), F.lit("ZZ"))
    return i.obs_raw.groupBy(text.asn_or_unknown(marked).alias("asn")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "favicon_status_label",
    "SELECT status, CASE status WHEN -1 THEN 'Could not connect to the server' WHEN -2 THEN 'Server refused the connection' "
    "WHEN -3 THEN 'Connection was reset by peer' WHEN -4 THEN 'Response is not valid HTTP' WHEN -5 THEN 'Unknown error occured' END AS label, count(*) AS n FROM favicons GROUP BY 1, 2",
)
def _(i: Inputs):
    return (
        i.favicons.withColumn("label", text.favicon_status_label("status"))
        .groupBy("status", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- filters ---------------------------------------------------------------------------


@query(
    "usable_answers",
    "SELECT * FROM observations WHERE resolver_asn IS NOT NULL AND answer_ip IS NOT NULL",
)
def _(i: Inputs):
    return filters.usable_answers(i.observations)


def _decoded_probe(i: Inputs) -> DataFrame:
    return dns.response_fields(i.responses).withColumnRenamed("resolver_ip", "ip")


_VALID = f"ok AND qr = 1 AND ra = 1 AND ancount > 0 AND list_contains(a_records, {EXPECTED_IP})"


@query(
    "select_resolvers",
    f"SELECT resolver_ip - resolver_ip % 256 AS net, arg_min(resolver_ip, seq) AS ip FROM responses WHERE r <> 1 AND {_VALID} GROUP BY 1",
)
def _(i: Inputs):
    # Only responses whose header can pass are decoded at all.
    raw = readers.read_probe_scan_raw(i.spark, i.probe_scan_files())
    possible = raw.filter(dns.answered_recursively("data_hex")).select(
        ip.ip_to_long("resolver_ip").alias("ip"), F.col("ts").cast("bigint").alias("seq"), "data_hex"
    )
    return filters.select_resolvers(dns.response_fields(possible), EXPECTED_IP)


@query(
    "resolver_funnel",
    "SELECT count(*) AS total, count(*) FILTER (ok AND qr = 1 AND ra = 1) AS recursive, "
    "count(*) FILTER (ok AND qr = 1 AND ra = 1 AND ancount > 0) AS answered, "
    f"count(*) FILTER ({_VALID}) AS valid, count(DISTINCT resolver_ip - resolver_ip % 256) FILTER ({_VALID}) AS networks FROM responses",
)
def _(i: Inputs):
    return filters.resolver_funnel(_decoded_probe(i), EXPECTED_IP)


@query(
    "collapse_hosts",
    "SELECT net, ip, CAST('0x' || substr(md5(CAST(ip AS VARCHAR) || ':7'), 1, 8) AS BIGINT) % 16 AS bucket "
    "FROM (SELECT ip - ip % 256 AS net, min(ip) AS ip FROM resolvers GROUP BY 1) t",
)
def _(i: Inputs):
    return filters.collapse_hosts(i.resolvers, 16, seed=7)


@query(
    "asns_above_threshold",
    "SELECT resolver_asn AS asn, count(*) AS n FROM (SELECT DISTINCT resolver_ip, resolver_asn FROM obs_raw) t "
    "WHERE resolver_asn IS NOT NULL GROUP BY 1 HAVING count(*) > 50",
)
def _(i: Inputs):
    known = i.obs_raw.select("resolver_ip", F.col("resolver_asn").alias("asn")).distinct()
    return filters.asns_above_threshold(known, 50)


# --- joins -----------------------------------------------------------------------------


@query("lpm_join", "SELECT DISTINCT answer_ip AS ip, asn FROM observations LEFT JOIN lpm ON ip = answer_ip WHERE answer_ip IS NOT NULL")
def _(i: Inputs):
    return joins.lpm_join(i.answers.withColumnRenamed("answer_ip", "ip"), i.prefixes)


@query(
    "country_of_asn",
    "SELECT o.resolver_asn, c.country, CAST(sum(n) AS BIGINT) AS n FROM observations o LEFT JOIN country1 c ON c.asn = o.resolver_asn GROUP BY 1, 2",
)
def _(i: Inputs):
    placed = joins.country_of_asn(i.obs, i.asn_country, "resolver_asn")
    return placed.groupBy("resolver_asn", "country").agg(F.sum("n").alias("n"))


@query("observations_by_country", "SELECT country, domain, resolver_asn, answer_ip, n FROM by_country")
def _(i: Inputs):
    return joins.observations_by_country(i.obs, i.asn_country).select(
        "country", "domain", "resolver_asn", "answer_ip", "n"
    )


@query(
    "whitelist_semi",
    "SELECT domain, count(*) AS n FROM obs_raw WHERE resolver_ip IN (SELECT resolver_ip FROM responses WHERE ok AND ancount > 0) GROUP BY 1",
)
def _(i: Inputs):
    good = dns.response_fields(i.responses).filter("ok and ancount > 0")
    kept = joins.whitelist_semi(i.obs_raw.select("domain", "resolver_ip"), good)
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


_FIRST_WRONG = f"ok AND ancount > 0 AND first_a IS DISTINCT FROM {EXPECTED_IP}"


def _misdirected_probe(i: Inputs) -> DataFrame:
    return dns.response_fields(i.responses).filter("ok")


@query(
    "blacklist_anti",
    f"SELECT domain, resolver_ip FROM obs_raw WHERE resolver_ip NOT IN (SELECT resolver_ip FROM responses WHERE {_FIRST_WRONG} AND ra = 1)",
)
def _(i: Inputs):
    scan = i.obs_raw.select("domain", "resolver_ip")
    return joins.blacklist_anti(scan, _misdirected_probe(i), EXPECTED_IP).select("domain", "resolver_ip")


@query(
    "surviving_resolvers",
    f"SELECT ip AS resolver_ip FROM resolvers WHERE ip NOT IN (SELECT resolver_ip FROM responses WHERE {_FIRST_WRONG})",
)
def _(i: Inputs):
    servers = i.resolvers.withColumnRenamed("ip", "resolver_ip")
    return joins.surviving_resolvers(servers, _misdirected_probe(i), EXPECTED_IP)


_OLD = "(SELECT ip - ip % 256 FROM (SELECT DISTINCT resolver_ip + 1 AS ip FROM obs_raw WHERE r < 40) t)"


def _older_run(i: Inputs) -> DataFrame:
    return i.obs_raw.filter("r < 40").select((F.col("resolver_ip") + 1).alias("ip"))


@query("historic_intersection", f"SELECT ip FROM resolvers WHERE ip - ip % 256 IN {_OLD}")
def _(i: Inputs):
    return joins.historic_intersection(i.resolvers, _older_run(i))


@query(
    "historic_share",
    f"SELECT count(*) AS total, count(*) FILTER (ip - ip % 256 IN {_OLD}) AS kept, "
    f"round(count(*) FILTER (ip - ip % 256 IN {_OLD}) / count(*), 6) AS share FROM resolvers",
)
def _(i: Inputs):
    return joins.historic_share(i.resolvers, _older_run(i)).withColumn("share", _r6("share"))


@query(
    "attach_ip_metadata",
    "SELECT p.ip, p.domain, p.n, l.asn, t.ptr, s.server, w.org FROM ip_domain p LEFT JOIN lpm l ON l.ip = p.ip "
    "LEFT JOIN ptr_label t ON t.ip = p.ip LEFT JOIN servers s ON s.ip = p.ip AND s.status < 500 AND s.server <> '' "
    "LEFT JOIN whois w ON w.ip = p.ip",
)
def _(i: Inputs):
    whois = i.whois_text.select("ip", text.whois_org("text").alias("org"))
    return joins.attach_ip_metadata(i.ip_domain, "ip", i.prefixes, i.ptrs, i.servers, whois)


@query(
    "self_pair_join",
    "SELECT a.domain AS a, b.domain AS b, count(*) AS shared FROM cells a JOIN cells b ON a.net = b.net AND a.domain < b.domain GROUP BY 1, 2",
)
def _(i: Inputs):
    return pairs.self_pair_join(materialize(i.net_domain, "cells"))


@query(
    "new_network_redirects",
    "SELECT DISTINCT r.domain, r.host FROM redirects r JOIN net_domain h ON h.domain = r.host "
    "WHERE r.status = 301 AND r.domain IN (SELECT domain FROM net_domain) "
    "AND NOT EXISTS (SELECT 1 FROM net_domain o WHERE o.domain = r.domain AND o.net = h.net)",
)
def _(i: Inputs):
    hosts = i.redirects.withColumn("host", text.redirect_host("status", "location"))
    return joins.new_network_redirects(hosts.filter("host is not null"), i.ip_domain.select("domain", "ip"))


# --- roll-ups --------------------------------------------------------------------------


@query(
    "aggregate_responses",
    "SELECT failed, domain, resolver_asn, answer_ip, count(*) AS n FROM ("
    "SELECT NOT e.ok AS failed, CASE WHEN e.ok THEN e.qname ELSE e.domain END AS domain, "
    "CASE WHEN e.ok THEN e.asn END AS resolver_asn, CASE WHEN e.ok THEN unnest(CASE WHEN len(a_records) = 0 THEN [NULL] ELSE a_records END) END AS answer_ip, s.shard "
    "FROM (SELECT p.*, v.asn FROM responses p JOIN resolver_asn v ON v.ip = p.resolver_ip WHERE r NOT IN (44, 45) AND p.resolver_ip % 5 <> 0 AND ok) e JOIN shards s ON s.domain = e.domain "
    "UNION ALL SELECT true, domain, NULL, NULL, NULL FROM responses WHERE NOT ok AND r NOT IN (44, 45) AND resolver_ip % 5 <> 0) t "
    "WHERE failed OR (shard, domain) IN (SELECT shard, domain FROM shards) GROUP BY 1, 2, 3, 4",
)
def _(i: Inputs):
    scan = _domain_scan(i)
    whitelist = i.stored_resolvers.filter("ip % 5 <> 0")
    return rollups.aggregate_listed_responses(scan, i.shards, i.resolver_prefixes, whitelist)


@query(
    "aggregate_responses_per_file",
    "SELECT failed, domain, resolver_asn, answer_ip, count(*) AS n FROM ("
    "SELECT false AS failed, domain, resolver_asn, unnest(CASE WHEN len(a_records) = 0 THEN [NULL] ELSE a_records END) AS answer_ip FROM responses WHERE ok AND qname = domain "
    "UNION ALL SELECT true, domain, NULL, NULL FROM responses WHERE NOT ok) t GROUP BY 1, 2, 3, 4",
)
def _(i: Inputs):
    return rollups.aggregate_responses_per_file(i.responses)


@query("ip_domain_counts", "SELECT ip, domain, n FROM ip_domain")
def _(i: Inputs):
    return rollups.ip_domain_counts(i.observations)


@query("network_domain_counts", "SELECT net, domain, n FROM net_domain")
def _(i: Inputs):
    return rollups.network_domain_counts(i.observations)


@query(
    "country_flow",
    "SELECT o.domain, rc.country AS resolver_country, ac.country AS answer_country, CAST(sum(o.n) AS BIGINT) AS n "
    "FROM observations o JOIN country1 rc ON rc.asn = o.resolver_asn LEFT JOIN lpm ON lpm.ip = o.answer_ip "
    "LEFT JOIN country1 ac ON ac.asn = lpm.asn GROUP BY 1, 2, 3",
)
def _(i: Inputs):
    return rollups.country_flow(i.obs, i.prefixes, i.asn_country)


@query(
    "asn_flow",
    "SELECT domain, resolver_asn, answer_asn, round(n / total, 6) AS share FROM ("
    "SELECT o.domain, o.resolver_asn, l.asn AS answer_asn, sum(o.n) FILTER (f.net IS NOT NULL) AS n, "
    "sum(sum(o.n)) OVER (PARTITION BY o.domain, o.resolver_asn) AS total "
    "FROM observations o JOIN clusters c USING (domain) LEFT JOIN footprint f ON f.cluster_id = c.cluster_id AND f.net = o.answer_ip - o.answer_ip % 256 "
    "LEFT JOIN lpm l ON l.ip = o.answer_ip WHERE o.resolver_asn IS NOT NULL AND c.cluster_id IN (SELECT cluster_id FROM footprint) GROUP BY 1, 2, 3) t "
    "WHERE answer_asn IS NOT NULL AND n > 0.01::DOUBLE * total",
)
def _(i: Inputs):
    footprint = clusters.cluster_footprint_majority(i.net_domain, i.clusters)
    flow = rollups.asn_flow(i.obs, i.prefixes, i.clusters, materialize(footprint, "footprint"))
    return flow.withColumn("share", _r6("share"))


@query(
    "domains_without_footprint",
    "SELECT count(DISTINCT domain) AS domains FROM observations WHERE domain NOT IN "
    "(SELECT domain FROM clusters JOIN footprint USING (cluster_id))",
)
def _(i: Inputs):
    footprint = clusters.cluster_footprint_majority(i.net_domain, i.clusters)
    return rollups.domains_without_footprint(i.obs, i.clusters, footprint)


@query(
    "pivot_asn_ip_domain",
    "SELECT resolver_asn, answer_ip, domain, n FROM observations WHERE resolver_asn IS NOT NULL AND answer_ip IS NOT NULL",
)
def _(i: Inputs):
    return rollups.pivot_asn_ip_domain(i.observations)


@query(
    "pivot_asn_domain_ip",
    "SELECT resolver_asn, domain, answer_ip, n FROM observations WHERE resolver_asn IS NOT NULL",
)
def _(i: Inputs):
    return rollups.pivot_asn_domain_ip(i.observations)


@query(
    "pivot_country_domain_ip",
    "SELECT country, domain, answer_ip, CAST(sum(n) AS BIGINT) AS n FROM observations JOIN country1 ON asn = resolver_asn GROUP BY 1, 2, 3",
)
def _(i: Inputs):
    return rollups.pivot_country_domain_ip(i.obs, i.asn_country)


@query("ips_per_asn", "SELECT asn, count(*) AS n FROM resolver_asn GROUP BY 1")
def _(i: Inputs):
    return rollups.ips_per_asn(i.stored_resolvers, i.resolver_prefixes)


_ASN_MEASURES = (
    "asn_sums AS (SELECT resolver_asn, sum(n) AS good, sum(n) FILTER (answer_ip IS NULL) AS bad, count(*) AS other "
    "FROM observations WHERE resolver_asn IS NOT NULL GROUP BY 1)"
)


def _asn_measures(i: Inputs) -> DataFrame:
    return i.obs.filter("resolver_asn is not null").groupBy("resolver_asn").agg(
        F.sum("n").alias("good"),
        F.sum(F.when(F.col("answer_ip").isNull(), F.col("n"))).alias("bad"),
        F.count(F.lit(1)).alias("other"),
    )


@query(
    "asn_to_country_rollup",
    "SELECT country, CAST(sum(good) AS BIGINT) AS good, CAST(sum(bad) AS BIGINT) AS bad, CAST(sum(other) AS BIGINT) AS other "
    "FROM asn_sums JOIN country1 ON asn = resolver_asn GROUP BY 1",
    extra=_ASN_MEASURES,
)
def _(i: Inputs):
    return rollups.asn_to_country_rollup(
        _asn_measures(i), i.asn_country, ["good", "bad", "other"], "resolver_asn"
    )


@query(
    "reduce_by_country",
    "SELECT country, CAST(max(good) AS BIGINT) AS largest, round(avg(other), 6) AS mean_other FROM asn_sums JOIN country1 ON asn = resolver_asn GROUP BY 1",
    extra=_ASN_MEASURES,
)
def _(i: Inputs):
    return rollups.reduce_by_country(
        _asn_measures(i),
        i.asn_country,
        F.max("good").alias("largest"),
        _r6(F.avg("other")).alias("mean_other"),
        asn="resolver_asn",
    )


@query(
    "underrepresented_countries",
    "SELECT b.country, b.n AS base, coalesce(t.n, 0) AS test FROM (SELECT country, count(*) AS n FROM by_country GROUP BY 1) b "
    "LEFT JOIN (SELECT country, count(*) AS n FROM by_country WHERE n > 1 AND answer_ip % 3 = 0 GROUP BY 1) t USING (country) "
    "WHERE coalesce(t.n, 0) = 0 OR 2 * t.n < b.n",
)
def _(i: Inputs):
    placed = joins.observations_by_country(i.obs, i.asn_country)
    count = F.count(F.lit(1)).alias("n")
    base = placed.groupBy("country").agg(count)
    test = placed.filter("n > 1 and answer_ip % 3 = 0").groupBy("country").agg(count)
    return rollups.underrepresented_countries(base, test)


_SIZES = "sizes AS (SELECT shard, count(*) AS size FROM shards GROUP BY 1)"


@query(
    "expected_queries_by_asn",
    "SELECT s.shard, s.domain, v.asn, count(*) AS n FROM shards s JOIN sizes z USING (shard) JOIN resolver_asn v ON v.ip % z.size = s.idx GROUP BY 1, 2, 3",
    extra=_SIZES,
)
def _(i: Inputs):
    located = joins.lpm_join(i.stored_resolvers, i.resolver_prefixes)
    return rollups.expected_queries_by_asn(located, i.shards)


@query(
    "expected_queries_by_country",
    "SELECT s.domain, c.country, count(*) AS n FROM shards s JOIN sizes z USING (shard) "
    "JOIN (SELECT ip, country FROM resolver_asn JOIN country1 USING (asn)) c ON c.ip % z.size = s.idx GROUP BY 1, 2",
    extra=_SIZES,
)
def _(i: Inputs):
    located = joins.lpm_join(i.stored_resolvers, i.resolver_prefixes)
    placed = joins.country_of_asn(located, i.asn_country).select("ip", "country")
    return rollups.expected_queries_by_country(placed, i.shards)


@query(
    "most_frequent",
    "SELECT domain, answer_ip, n FROM (SELECT domain, answer_ip, count(*) AS n, "
    "row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, answer_ip) AS rn FROM obs_raw WHERE answer_ip IS NOT NULL GROUP BY 1, 2) t WHERE rn = 1",
)
def _(i: Inputs):
    return ranking.most_frequent(i.obs_raw.filter("answer_ip is not null"), ["domain"], "answer_ip")


def _tags(i: Inputs) -> DataFrame:
    footprint = materialize(clusters.cluster_footprint_majority(i.net_domain, i.clusters), "footprint")
    return clusters.cluster_metadata_tag(footprint, _net_metadata(i))


def _net_metadata(i: Inputs) -> DataFrame:
    named = i.ptrs.filter(F.size("names") > 0)
    return named.groupBy(ip.class_c("ip").alias("net")).agg(F.max_by("names", "ip").alias("names"))


@query(
    "confidence_histogram",
    "SELECT round(floor(round(c / pow(10.0::DOUBLE, floor(log10(c))), 9)) * pow(10.0::DOUBLE, floor(log10(c))), 9) AS bucket, count(*) AS n "
    "FROM (SELECT CAST(n AS DOUBLE) / 1000 AS c FROM observations) t GROUP BY 1",
)
def _(i: Inputs):
    return clusters.confidence_histogram(i.observations.select((F.col("n") / 1000).alias("confidence")))


@query(
    "signature_type_counts",
    "SELECT coalesce(method, 'UNKNOWN') AS method, count(*) AS domains FROM (SELECT DISTINCT domain FROM observations) d "
    "LEFT JOIN (SELECT DISTINCT domain, method FROM signatures) s USING (domain) GROUP BY 1",
)
def _(i: Inputs):
    return rollups.signature_type_counts(i.obs.select("domain"), _signatures(i))


_SIDES = " UNION ALL ".join(
    f"SELECT asn, '{p}-{m}/{q}-{l}' AS pair, CAST(sum(greatest(c{p}{m} - c{q}{l}, 0)) AS BIGINT) AS only_first, "
    f"CAST(sum(least(c{p}{m}, c{q}{l})) AS BIGINT) AS both, CAST(sum(greatest(c{q}{l} - c{p}{m}, 0)) AS BIGINT) AS only_second "
    "FROM http_ip WHERE asn IS NOT NULL GROUP BY 1, 2"
    for (p, m), (q, l) in SCAN_PAIRS
)
_HTTP_IP = (
    "http_ip AS (SELECT ip, asn, "
    + ", ".join(f"count(*) FILTER (port = {p} AND mode = '{m}') AS c{p}{m}" for p, m in HTTP_SCANS)
    + " FROM http_scans LEFT JOIN lpm USING (ip) GROUP BY 1, 2)"
)


@query("http_scan_stats", _SIDES, extra=_HTTP_IP)
def _(i: Inputs):
    return rollups.http_scan_stats(i.http_scans, i.prefixes, SCAN_PAIRS)


# --- similarity and clusters -----------------------------------------------------------


def _cells(i: Inputs) -> DataFrame:
    return materialize(i.net_domain, "cells")


def _similarity(i: Inputs) -> DataFrame:
    return materialize(similarity.domain_similarity(_cells(i)), "similarity")


@query("domain_similarity", "SELECT a, b, round(sim, 6) AS sim FROM sim0 WHERE sim > 0")
def _(i: Inputs):
    return similarity.domain_similarity(_cells(i)).withColumn("sim", _r6("sim"))


@query("similar_pairs", "SELECT a, b, round(sim, 6) AS sim FROM hosted_sim WHERE sim > 0.5", extra=hosted(SITES).strip())
def _(i: Inputs):
    return similarity.similar_pairs(i.hosted(SITES), 0.5).withColumn("sim", _r6("sim"))


@query("reweight_networks", "SELECT domain, net, round(w, 6) AS w FROM weights1")
def _(i: Inputs):
    cells = _cells(i)
    sim = materialize(similarity.domain_similarity(cells), "similarity")
    return similarity.reweight_networks(cells, sim).withColumn("w", _r6("w"))


@query(
    "iterate_similarity",
    f"SELECT a, b, round(sim, 6) AS sim FROM sim{SIMILARITY_ROUNDS}",
    rounds=SIMILARITY_ROUNDS,
)
def _(i: Inputs):
    sim, _ = similarity.iterate_similarity(i.net_domain, SIMILARITY_ROUNDS)
    return sim.withColumn("sim", _r6("sim"))


# Pivots one by one in the order of their hashes: a domain linked to no earlier pivot is one.
_PIVOT = """
turn AS MATERIALIZED (
SELECT domain, row_number() OVER (ORDER BY md5('0:' || domain), domain) AS i FROM (SELECT DISTINCT domain FROM cells) t
),
near AS MATERIALIZED (SELECT a, b FROM full1 WHERE sim > 0.5 UNION ALL SELECT domain, domain FROM turn),
picked AS (
SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS pivots
UNION ALL
SELECT v.i + 1, CASE WHEN (SELECT count(*) FROM near WHERE a = t.domain AND list_contains(v.pivots, b)) > 0
  THEN v.pivots ELSE list_append(v.pivots, t.domain) END
FROM picked v JOIN turn t ON t.i = v.i + 1
),
pivots AS (SELECT unnest(pivots) AS pivot FROM picked WHERE i = (SELECT max(i) FROM turn)),
placed AS (
SELECT n.a AS domain, arg_min(n.b, t.i) AS leader FROM near n JOIN pivots p ON p.pivot = n.b JOIN turn t ON t.domain = n.b GROUP BY 1
),
numbered AS (
SELECT leader, row_number() OVER (ORDER BY count(*) DESC, min(domain)) - 1 AS cluster_id FROM placed GROUP BY leader
)"""


@query(
    "correlation_cluster",
    "SELECT domain, CAST(cluster_id AS INTEGER) AS cluster_id FROM placed JOIN numbered USING (leader)",
    rounds=1,
    extra=_PIVOT.strip(),
)
def _(i: Inputs):
    cells = _cells(i)
    sim, _ = similarity.iterate_similarity(cells, 1)
    return clusters.correlation_cluster(cells.select("domain").distinct(), sim)


# VOTE one by one in the order of names; cells without a similarity count as 1e-6.
_VOTE = """
turn AS MATERIALIZED (SELECT domain, row_number() OVER (ORDER BY domain) AS i FROM (SELECT DISTINCT domain FROM hosted) t),
odds AS MATERIALIZED (
SELECT y.i, y.domain, list(ln(p / (1 - p)) ORDER BY x.i) AS odds
FROM (SELECT x.i AS xi, y.i AS yi, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, coalesce(sim, 0.0::DOUBLE))) AS p
      FROM turn x JOIN turn y ON x.i < y.i LEFT JOIN hosted_sim s ON s.a = x.domain AND s.b = y.domain) t
JOIN turn x ON x.i = xi JOIN turn y ON y.i = yi GROUP BY 1, 2
),
voted AS (
SELECT CAST(1 AS BIGINT) AS i, [domain] AS leaders FROM turn WHERE i = 1
UNION ALL
SELECT v.i + 1, list_append(v.leaders, coalesce((
  SELECT leader FROM (SELECT leader, round(sum(w), 9) AS pull FROM (SELECT unnest(v.leaders) AS leader, unnest(o.odds) AS w) t GROUP BY 1) t
  WHERE pull > 0 ORDER BY pull DESC, leader LIMIT 1), o.domain))
FROM voted v JOIN odds o ON o.i = v.i + 1
),
placed AS (
SELECT domain, leader FROM turn JOIN (
  SELECT unnest(leaders) AS leader, generate_subscripts(leaders, 1) AS i FROM voted WHERE i = (SELECT max(i) FROM turn)) t USING (i)
),
numbered AS (
SELECT leader, row_number() OVER (ORDER BY count(*) DESC, min(domain)) - 1 AS cluster_id FROM placed GROUP BY leader
)"""


@query(
    "correlation_cluster_vote",
    "SELECT domain, CAST(cluster_id AS INTEGER) AS cluster_id FROM placed JOIN numbered USING (leader)",
    extra=hosted(VOTED_SITES).strip() + "," + _VOTE,
)
def _(i: Inputs):
    cells = i.hosted(VOTED_SITES)
    sim = similarity.domain_similarity(cells)
    return clusters.correlation_cluster(cells.select("domain"), sim, "vote")


@query("cluster_footprint_majority", "SELECT cluster_id, net FROM footprint")
def _(i: Inputs):
    return clusters.cluster_footprint_majority(i.net_domain, i.clusters)


@query(
    "cluster_footprint_max",
    "SELECT cluster_id, net FROM (SELECT cluster_id, net, row_number() OVER (PARTITION BY net ORDER BY sum(n) DESC, cluster_id) AS rn "
    "FROM net_domain JOIN clusters USING (domain) GROUP BY 1, 2) t WHERE rn = 1",
)
def _(i: Inputs):
    return clusters.cluster_footprint_max(i.net_domain, i.clusters)


@query(
    "cluster_footprint_similarity",
    "SELECT cluster_id, net, round(weight, 6) AS weight FROM (SELECT net, cluster_id, sum(w) AS weight, row_number() OVER (PARTITION BY net ORDER BY round(sum(w), 9) DESC, cluster_id) AS rn "
    "FROM (SELECT p.net, c.cluster_id, s.sim * least(p.n, q.n) AS w FROM cells p JOIN cells q ON p.net = q.net AND p.domain <> q.domain "
    "JOIN full0 s ON s.a = p.domain AND s.b = q.domain JOIN clusters c ON c.domain = p.domain) t GROUP BY 1, 2 HAVING sum(w) > 0) t WHERE rn = 1",
)
def _(i: Inputs):
    cells = _cells(i)
    sim = materialize(similarity.domain_similarity(cells), "similarity")
    best = clusters.cluster_footprint_similarity(cells, i.clusters, sim)
    return best.withColumn("weight", _r6("weight"))


@query("cluster_metadata_tag", "SELECT cluster_id, tag, round(confidence, 6) AS confidence FROM cluster_tags")
def _(i: Inputs):
    return _tags(i).withColumn("confidence", _r6("confidence"))


@query(
    "merge_clusters_on_metadata",
    "SELECT domain, coalesce(merged, fine) AS cluster_id FROM (SELECT domain, CAST(k AS INTEGER) AS fine, CAST(k % 7 AS VARCHAR) AS tag, k % 10 AS c FROM domain_keys) d "
    "LEFT JOIN (SELECT CAST(k % 7 AS VARCHAR) AS tag, min(CAST(k AS INTEGER)) AS merged FROM domain_keys WHERE k % 10 / 10.0::DOUBLE > 0.2::DOUBLE GROUP BY 1) m "
    "ON m.tag = d.tag AND d.c / 10.0::DOUBLE > 0.2::DOUBLE",
)
def _(i: Inputs):
    fine = i.domain_keys.select("domain", F.col("k").cast("int").alias("cluster_id"))
    tags = i.domain_keys.select(
        F.col("k").cast("int").alias("cluster_id"),
        (F.col("k") % 7).cast("string").alias("tag"),
        (F.col("k") % 10 / 10.0).alias("confidence"),
    )
    return clusters.merge_clusters_on_metadata(fine, tags, 0.2)


_THRESHOLD = "n * 2 + m / 10"


@query(
    "cluster_stats",
    "SELECT cluster_id, ip, round(score, 6) AS score, n, m, asn, country FROM ("
    "SELECT cluster_id, ip, sum(score) AS score, count(*) AS n FROM scores JOIN clusters USING (domain) GROUP BY 1, 2) t "
    "JOIN (SELECT cluster_id, count(*) AS m FROM clusters GROUP BY 1) z USING (cluster_id) LEFT JOIN lpm USING (ip) LEFT JOIN country1 USING (asn) "
    "WHERE round(score, 6) > n * 2 + m / 10.0::DOUBLE",
)
def _(i: Inputs):
    threshold = scoring.user_threshold_expression(_THRESHOLD)
    scores = _scores(i).withColumn("score", F.round("score", 9))
    stats = clusters.cluster_stats(i.clusters, scores, threshold, i.prefixes, i.asn_country)
    return stats.withColumn("score", _r6("score"))


@query("domain_cluster_map", "SELECT domain, cluster_id FROM clusters")
def _(i: Inputs):
    piece = F.pmod(F.xxhash64("domain"), F.lit(64))
    lists = i.clusters.groupBy("cluster_id", piece).agg(F.collect_list("domain").alias("domains"))
    return clusters.domain_cluster_map(lists)


@query(
    "pair_similarity_lookup",
    "SELECT x.domain AS a, y.domain AS b, round(CASE WHEN x.domain = y.domain THEN 1.0::DOUBLE ELSE coalesce(s.sim, 0) END, 6) AS sim "
    "FROM domain_keys x JOIN domain_keys y ON x.k % 5 = y.k % 5 LEFT JOIN full0 s ON s.a = x.domain AND s.b = y.domain",
)
def _(i: Inputs):
    left = i.domain_keys.select(F.col("domain").alias("a"), (F.col("k") % 5).alias("g"))
    right = i.domain_keys.select(F.col("domain").alias("b"), (F.col("k") % 5).alias("g"))
    asked = left.join(right, "g").drop("g")
    return pairs.pair_similarity_lookup(asked, _similarity(i)).withColumn("sim", _r6("sim"))


# --- scoring ---------------------------------------------------------------------------


def _scores(i: Inputs) -> DataFrame:
    ip_domain = materialize(i.ip_domain, "ip-domain")
    return materialize(scoring.score_resolutions(ip_domain, _similarity(i)), "scores")


@query("score_resolutions", "SELECT domain, ip, round(score, 6) AS score FROM scores")
def _(i: Inputs):
    ip_domain = materialize(i.ip_domain, "ip-domain")
    return scoring.score_resolutions(ip_domain, _similarity(i)).withColumn("score", _r6("score"))


@query(
    "score_with_diversity",
    "SELECT domain, ip, round(w + (1 - w) * (score + 1) / 2, 6) AS score FROM ("
    "SELECT domain, ip, pow(n / sum(n) OVER (PARTITION BY domain), 1.0::DOUBLE / 3) AS w FROM ip_domain) t JOIN scores USING (domain, ip)",
)
def _(i: Inputs):
    return scoring.score_with_diversity(i.ip_domain, _scores(i)).withColumn("score", _r6("score"))


def _group_score_sql(group: str, source: str) -> str:
    return (
        f"SELECT {group}, domain, round(score, 6) AS score, CAST(total AS BIGINT) AS total, ip, CAST(n AS BIGINT) AS n, round(ip_score, 6) AS ip_score FROM ("
        f"SELECT {group}, domain, ip, n, ip_score, sum(ip_score * n) OVER w / sum(n) OVER w AS score, sum(n) OVER w AS total, "
        "count(*) FILTER (ip_score IS NULL) OVER w AS missing "
        f"FROM (SELECT {group}, p.domain, p.ip, p.n, s.score AS ip_score FROM ({source}) p LEFT JOIN scores s ON s.domain = p.domain AND s.ip = p.ip) t "
        f"WINDOW w AS (PARTITION BY {group}, domain)) t WHERE missing = 0 AND round(score, 9) <= 40"
    )


def _grouped_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", _r6("score")).withColumn("ip_score", _r6("ip_score"))


@query(
    "score_asn_domains",
    _group_score_sql(
        "resolver_asn",
        "SELECT resolver_asn, domain, answer_ip AS ip, n FROM observations WHERE resolver_asn IS NOT NULL AND answer_ip IS NOT NULL",
    ),
)
def _(i: Inputs):
    counts = rollups.pivot_asn_domain_ip(i.obs)
    return _grouped_scores(scoring.score_asn_domains(counts, _scores(i), 40.0))


@query(
    "score_country_domains",
    _group_score_sql(
        "country",
        "SELECT country, domain, answer_ip AS ip, sum(n) AS n FROM observations JOIN country1 ON asn = resolver_asn WHERE answer_ip IS NOT NULL GROUP BY 1, 2, 3",
    ),
)
def _(i: Inputs):
    counts = rollups.pivot_country_domain_ip(i.obs, i.asn_country)
    return _grouped_scores(scoring.score_country_domains(counts, _scores(i), 40.0))


_ASN_IPS = (
    "asn_ips AS (SELECT resolver_asn, ip, round(score, 6) AS score, total, domains FROM ("
    "SELECT resolver_asn, answer_ip AS ip, CAST(sum(n) AS BIGINT) AS total, count(*) AS domains FROM observations WHERE resolver_asn IS NOT NULL AND answer_ip IS NOT NULL GROUP BY 1, 2) t "
    "LEFT JOIN (SELECT p.resolver_asn, p.answer_ip AS ip, sum(coalesce(s.sim, 0) * least(p.n, q.n)) / sum(least(p.n, q.n)) AS score FROM observations p "
    "JOIN observations q ON p.resolver_asn = q.resolver_asn AND p.answer_ip = q.answer_ip AND p.domain < q.domain "
    "LEFT JOIN sim0 s ON s.a = p.domain AND s.b = q.domain GROUP BY 1, 2) v USING (resolver_asn, ip) WHERE score IS NULL OR round(score, 9) <= 0.9::DOUBLE)"
)


@query("score_asn_ips", "SELECT * FROM asn_ips", extra=_ASN_IPS)
def _(i: Inputs):
    return scoring.score_asn_ips(_asn_cells(i), _similarity(i), 0.9).withColumn("score", _r6("score"))


def _asn_cells(i: Inputs) -> DataFrame:
    return materialize(rollups.pivot_asn_ip_domain(i.obs), "asn-ip-domain")


@query(
    "score_country_asn_ips",
    "SELECT country, a.* FROM asn_ips a JOIN (SELECT DISTINCT * FROM asn_country) c ON c.asn = a.resolver_asn",
    extra=_ASN_IPS,
)
def _(i: Inputs):
    asn_ips = scoring.score_asn_ips(_asn_cells(i), _similarity(i), 0.9)
    return scoring.score_country_asn_ips(asn_ips, i.asn_country).withColumn("score", _r6("score"))


# --- interference ----------------------------------------------------------------------


def _signatures(i: Inputs) -> DataFrame:
    return materialize(
        interference.domain_signatures(i.obs, i.prefixes, i.ptrs, i.servers), "signatures"
    )


def _anomalies(i: Inputs) -> DataFrame:
    found = interference.country_anomalies(
        i.obs, i.asn_country, _signatures(i), i.prefixes, i.ptrs, i.servers
    )
    return materialize(found, "anomalies")


def _flat_anomalies(df: DataFrame) -> DataFrame:
    rows = df.select("country", "domain", "total", F.inline("checks"))
    return rows.withColumn("expected", F.array_join("expected", ","))


_FLAT = "SELECT country, domain, total, method, array_to_string(expected, ',') AS expected, good, top, top_n FROM anomalies"


@query("domain_signatures", "SELECT domain, method, array_to_string(value, ',') AS value FROM signatures")
def _(i: Inputs):
    found = interference.domain_signatures(i.obs, i.prefixes, i.ptrs, i.servers)
    return found.withColumn("value", F.array_join("value", ","))


@query("country_anomalies", _FLAT)
def _(i: Inputs):
    return _flat_anomalies(
        interference.country_anomalies(
            i.obs, i.asn_country, _signatures(i), i.prefixes, i.ptrs, i.servers
        )
    )


@query(
    "drop_ubiquitous_anomalies", _FLAT + " WHERE domain NOT IN (SELECT domain FROM ubiquitous)"
)
def drop_ubiquitous(i: Inputs):
    return _flat_anomalies(interference.drop_ubiquitous_anomalies(_anomalies(i)))


@query(
    "anomaly_summary",
    "SELECT country, count(*) AS anomalies, count(*) FILTER (domain NOT IN (SELECT domain FROM ubiquitous)) AS kept, "
    "(SELECT count(*) FROM ubiquitous) AS dropped_domains FROM anomaly_pairs GROUP BY country",
)
def _(i: Inputs):
    return interference.anomaly_summary(_anomalies(i))


@query("block_page_candidates", "SELECT country, ip, domain FROM candidates")
def _(i: Inputs):
    return interference.block_page_candidates(i.obs, i.prefixes, i.asn_country)


@query(
    "block_page_ips",
    "SELECT country, ip, CAST(sum(k) AS BIGINT) AS domains FROM (SELECT country, c.ip, top_ip, count(*) AS k FROM candidates c JOIN world_dom USING (domain) GROUP BY 1, 2, 3) t "
    "GROUP BY 1, 2 HAVING sum(k) > 5 AND sum(k * (k - 1) / 2) < sum(k)",
)
def _(i: Inputs):
    candidates = interference.block_page_candidates(i.obs, i.prefixes, i.asn_country)
    return interference.block_page_ips(candidates, i.obs)


@query(
    "local_resolutions",
    f"SELECT domain, CAST(sum(CASE WHEN {reserved('answer_ip')} THEN 0 ELSE n END) AS BIGINT) AS public, "
    f"CAST(sum(CASE WHEN {reserved('answer_ip')} THEN n ELSE 0 END) AS BIGINT) AS reserved FROM by_country "
    f"WHERE country = 'NATION_3' AND answer_ip IS NOT NULL GROUP BY 1 HAVING reserved * 4 > public",
)
def _(i: Inputs):
    return interference.local_resolutions(i.obs, i.asn_country, "NATION_3")


@query(
    "resolution_underflow",
    "SELECT country, domain, answered, empty, round(average, 6) AS average FROM (SELECT *, sum(answered + empty) OVER (PARTITION BY country) / (SELECT count(DISTINCT domain) + (SELECT count(DISTINCT p_brand) FROM part) FROM observations) AS average FROM ("
    "SELECT country, domain, CAST(coalesce(sum(n) FILTER (answer_ip IS NOT NULL), 0) AS BIGINT) AS answered, CAST(coalesce(sum(n) FILTER (answer_ip IS NULL), 0) AS BIGINT) AS empty FROM by_country GROUP BY 1, 2) t) u "
    "WHERE answered < average AND empty > answered",
)
def _(i: Inputs):
    silent = i.table("part").select(F.concat(F.lit("silent."), "p_brand").alias("domain")).distinct()
    domains = i.domain_keys.select("domain").unionByName(silent)
    found = interference.resolution_underflow(i.obs, i.asn_country, domains)
    return found.withColumn("average", _r6("average"))


@query(
    "asn_diversity_outliers",
    "SELECT domain, resolver_asn, total, round(ratio, 6) AS ratio FROM (SELECT *, avg(ratio) OVER w AS mean, stddev_pop(ratio) OVER w AS dev FROM ("
    "SELECT domain, resolver_asn, CAST(sum(k) AS BIGINT) AS total, sum(k) / max(k) AS ratio FROM ("
    "SELECT domain, resolver_asn, asn, count(*) AS k FROM observations LEFT JOIN lpm ON ip = answer_ip WHERE answer_ip IS NOT NULL GROUP BY 1, 2, 3) t GROUP BY 1, 2) u "
    "WINDOW w AS (PARTITION BY domain)) v WHERE total >= 20 AND ratio > mean + 3.0::DOUBLE * dev",
)
def _(i: Inputs):
    found = interference.asn_diversity_outliers(i.obs, i.prefixes)
    return found.withColumn("ratio", _r6("ratio"))


# --- validation and set operations -----------------------------------------------------


@query(
    "favicon_match",
    "SELECT f.ip, f.host, f.hash = e.hash AS matched FROM favicons f JOIN favicon_fetches e ON e.host = f.host AND e.status = 200",
)
def _(i: Inputs):
    return validation.favicon_match(i.favicons, validation.expected_favicons(i.favicon_fetches))


@query("expected_favicons", "SELECT host, hash FROM favicon_fetches WHERE status = 200")
def _(i: Inputs):
    return validation.expected_favicons(i.favicon_fetches)


@query(
    "favicon_carry_forward",
    "SELECT f.ip, f.host, f.seq, CASE WHEN f.seq > s.seq THEN s.status ELSE f.status END AS status, CASE WHEN f.seq > s.seq THEN s.length ELSE f.length END AS length, "
    "CASE WHEN f.seq > s.seq THEN s.hash ELSE f.hash END AS hash, f.ctype FROM favicons f LEFT JOIN (SELECT * FROM favicons WHERE status < 0 QUALIFY row_number() OVER (PARTITION BY ip ORDER BY seq) = 1) s USING (ip)",
)
def _(i: Inputs):
    return validation.favicon_carry_forward(i.favicons)


@query(
    "score_validation",
    "SELECT domain, n, correct, matches, matches_correct, round(correct / n, 6) AS accuracy FROM ("
    "SELECT coalesce(domain, '(all)') AS domain, count(*) AS n, count(*) FILTER (CASE WHEN matched THEN score > 5 ELSE score < 5 END) AS correct, "
    "count(*) FILTER (matched) AS matches, count(*) FILTER (matched AND score > 5) AS matches_correct FROM ("
    "SELECT s.domain, f.hash = e.hash AS matched, round(s.score, 9) AS score FROM favicons f JOIN favicon_fetches e ON e.host = f.host AND e.status = 200 "
    "JOIN scores s ON s.domain = f.host AND s.ip = f.ip WHERE round(s.score, 9) <> 0) t GROUP BY GROUPING SETS ((domain), ())) u",
)
def _(i: Inputs):
    matches = validation.favicon_match(i.favicons, validation.expected_favicons(i.favicon_fetches))
    scores = _scores(i).withColumn("score", F.round("score", 9))
    per_domain, overall = validation.score_validation(matches, scores, SCORE_CUT)
    both = per_domain.unionByName(overall.withColumn("domain", F.lit("(all)")))
    return both.withColumn("accuracy", _r6("accuracy"))


def _every_pair(i: Inputs, compare: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``compare`` over all scan pairs, with the number of the pair."""
    scans = materialize(i.http_scans, "http-scans")
    one = lambda port, mode: scans.filter((F.col("port") == port) & (F.col("mode") == mode)).select("ip")
    found = [
        compare(one(*a), one(*b)).withColumn("pair", F.lit(at)) for at, (a, b) in enumerate(SCAN_PAIRS)
    ]
    return reduce(DataFrame.unionByName, found)


def _pair_counts() -> str:
    test = "count(*) FILTER (port = {} AND mode = '{}')"
    return " UNION ALL ".join(
        f"SELECT {at} AS pair, ip, {test.format(*a)} AS ca, {test.format(*b)} AS cb FROM http_scans GROUP BY ip"
        for at, (a, b) in enumerate(SCAN_PAIRS)
    )


_DIFF = (
    f"diff AS ({_pair_counts()}), "
    "sides AS (SELECT pair, ip, 'both' AS side, least(ca, cb) AS n FROM diff UNION ALL SELECT pair, ip, 'a-b', ca - cb FROM diff UNION ALL SELECT pair, ip, 'b-a', cb - ca FROM diff)"
)


@query("ip_list_diff", "SELECT pair, ip, side, n FROM sides WHERE n > 0", extra=_DIFF)
def _(i: Inputs):
    return _every_pair(i, setops.ip_list_diff)


@query(
    "ip_list_diff_by_asn",
    "SELECT pair, asn, ip, side, n FROM sides LEFT JOIN lpm USING (ip) WHERE n > 0",
    extra=_DIFF,
)
def _(i: Inputs):
    return _every_pair(i, lambda a, b: setops.ip_list_diff_by_asn(a, b, i.prefixes))


@query(
    "append_domains",
    "SELECT domain, count(*) AS n FROM (SELECT * FROM (SELECT domain FROM domain_keys ORDER BY k LIMIT 20) a UNION ALL SELECT 'extra-' || domain FROM domain_keys "
    "UNION ALL SELECT host FROM redirects WHERE status = 301) t GROUP BY 1",
)
def _(i: Inputs):
    ranked = i.domain_keys.select("domain", F.col("k").alias("rank"))
    extra = i.domain_keys.select(F.concat(F.lit("extra-"), "domain").alias("domain"))
    hosts = i.redirects.select(text.redirect_host("status", "location").alias("host"))
    all_domains = setops.append_domains(ranked, extra, hosts.filter("host is not null"), top=20)
    return all_domains.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query("shard_domains", "SELECT shard, idx, domain FROM shards")
def _(i: Inputs):
    ranked = i.domain_keys.select(
        F.concat("domain", F.lit("/path")).alias("domain"), F.col("k").alias("rank")
    )
    return setops.shard_domains(ranked, 10)


# --- ranking ---------------------------------------------------------------------------


@query(
    "top_k_by_weight",
    "SELECT domain, ip, n, CAST(rn AS INTEGER) AS rank FROM (SELECT domain, ip, n, row_number() OVER (PARTITION BY domain ORDER BY n DESC, ip) AS rn FROM ip_domain) t WHERE rn <= 3",
)
def _(i: Inputs):
    counts = rollups.ip_domain_counts(i.observations)
    return ranking.top_k_by_weight(counts, ["domain"], "ip", "n", 3).select("domain", "ip", "n", "rank")


@query("cumulative_cliff", "SELECT domain, ip, n, CAST(rn AS INTEGER) AS rank FROM sig_head")
def _(i: Inputs):
    counts = i.obs.filter("resolver_asn <> 0").groupBy("domain", F.col("answer_ip").alias("ip")).agg(
        F.sum("n").alias("n")
    )
    return ranking.cumulative_cliff(counts, "domain", "ip", "n")


@query(
    "user_threshold_expression",
    "SELECT ip, n, m FROM (SELECT ip, CAST(sum(n) AS BIGINT) AS n, count(*) AS m FROM ip_domain GROUP BY 1) t WHERE n > (m + 3) * 10 - n / 2",
)
def _(i: Inputs):
    per_ip = i.ip_domain.groupBy("ip").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    limit = scoring.user_threshold_expression("(m + 3) * 10 - n / 2")
    return per_ip.filter(F.col("n") > limit)


@query("row_numbers", "SELECT domain, seq, row_number() OVER (PARTITION BY domain ORDER BY seq) AS rn FROM obs_raw")
def _(i: Inputs):
    rows = i.obs_raw.select("domain", "seq")
    return ranking.row_numbers(rows, "seq", ["domain"]).select("domain", "seq", "rn")
