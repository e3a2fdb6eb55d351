"""Canonical long-form tables. IPv4 addresses are uint32 values in a bigint."""

from __future__ import annotations

DOMAIN_SCAN = "shard string, resolver_ip string, probe int, ts string, data_hex string"
PROBE_SCAN = "resolver_ip string, ts string, data_hex string"
SHARD_DOMAINS = "shard string, idx int, domain string"
OBSERVATIONS = "domain string, resolver_asn bigint, answer_ip bigint, n bigint"
PREFIXES = "network bigint, prefix_len int, asn bigint"
ASN_COUNTRY = "asn bigint, country string"
PTRS = "ip bigint, names array<string>"
SERVERS = "ip bigint, status int, server string"
WHOIS = "ip bigint, org string"
HTTP_SCAN = "port int, mode string, ip bigint"
SIMILARITY = "a string, b string, sim double"
WEIGHTS = "domain string, net bigint, w double"

DECODED = (
    "ok boolean, qr int, ra int, rcode int, qdcount int, ancount int, "
    "qname string, a_records array<bigint>, first_a bigint"
)

EMPTY = "empty"
"""Fixed value: key that stands for "no address in the answer" in files and signatures."""

UNKNOWN = "unknown"
"""Fixed value: key that stands for "no ASN for this resolver" in files."""
