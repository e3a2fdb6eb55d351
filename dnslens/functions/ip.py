"""IPv4 arithmetic as column expressions over uint32 values held in a bigint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address ranges that are never public, as CIDR blocks.
RESERVED_BLOCKS = (
    "224.0.0.0/4",
    "240.0.0.0/4",
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "100.64.0.0/10",
    "172.16.0.0/12",
    "198.18.0.0/15",
    "169.254.0.0/16",
    "192.168.0.0/16",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.88.99.0/24",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "255.255.255.255/32",
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _octets(dotted: str) -> int:
    a, b, c, d = (int(x) for x in dotted.split("."))
    return (a << 24) + (b << 16) + (c << 8) + d


def _block_range(cidr: str) -> tuple[int, int]:
    base, length = cidr.split("/")
    first = _octets(base)
    return first, first + (1 << (32 - int(length))) - 1


def ip_to_long(c: Column | str) -> Column:
    """Dotted text to uint32; anything that is not four octets in 0..255 is NULL."""
    text = F.trim(as_col(c))
    parts = F.split(text, r"\.")
    octet = [F.get(parts, i).try_cast("bigint") for i in range(4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    only_digits = F.translate(text, "0123456789.", "") == ""
    return F.when(only_digits & (F.size(parts) == 4) & (F.greatest(*octet) <= 255), value)


def format_ip(c: Column | str) -> Column:
    ip = as_col(c)
    octet = [F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    dot = F.lit(".")
    return F.concat(octet[0], dot, octet[1], dot, octet[2], dot, octet[3])


def prefix(c: Column | str, length: int) -> Column:
    """Network base of an address for a fixed prefix length."""
    ip = as_col(c)
    return ip - ip % F.lit(1 << (32 - length))


def class_c(c: Column | str) -> Column:
    return prefix(c, 24)


def is_reserved(c: Column | str) -> Column:
    ip = as_col(c)
    return reduce(
        lambda acc, rng: acc | ip.between(*rng),
        (_block_range(b) for b in RESERVED_BLOCKS[1:]),
        ip.between(*_block_range(RESERVED_BLOCKS[0])),
    )
