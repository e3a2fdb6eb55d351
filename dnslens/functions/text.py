"""Name, header and record cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ip import as_col

# Fixed value: the host part of a redirect target.
REDIRECT_HOST = r"https?://([a-zA-Z0-9.-]*)"

# Result codes of an icon fetch and their descriptions.
FAVICON_STATUS = {
    -1: "Could not connect to the server",
    -2: "Server refused the connection",
    -3: "Connection was reset by peer",
    -4: "Response is not valid HTTP",
    -5: "Unknown error occured",
}


def ptr_base_domain(c: Column | str) -> Column:
    """Label naming the organisation in a reverse-DNS host name."""
    name = as_col(c)
    labels = F.split(name, r"\.")
    short_second_level = F.length(F.try_element_at(labels, F.lit(-2))) < 3
    return F.when((F.length(name) == 0) | name.startswith("."), None).otherwise(
        F.when(
            (F.size(labels) > 3) & short_second_level, F.try_element_at(labels, F.lit(-3))
        ).otherwise(F.try_element_at(labels, F.lit(-2)))
    )


def clean_metadata_tag(c: Column | str) -> Column:
    """Normalised owner tag: lower case, without a long leading host label."""
    raw = as_col(c)
    tag = F.lower(F.trim(raw))
    labels = F.split(tag, r"\.")
    host_like = (
        ~tag.contains(" ") & (F.size(labels) > 2) & (F.length(F.element_at(labels, 1)) > 5)
    )
    rest = F.array_join(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), ".")
    return F.when(F.length(raw) > 0, F.when(host_like, rest).otherwise(tag))


def whois_org(c: Column | str) -> Column:
    """Owner named by the last ``OrgNOCName`` / ``netname`` line of a WHOIS record."""
    owner_lines = F.filter(
        F.split(as_col(c), "\n"),
        lambda line: line.startswith("OrgNOCName") | line.startswith("netname"),
    )
    last = F.try_element_at(owner_lines, F.lit(-1))
    return F.trim(F.try_element_at(F.split(last, ":"), F.lit(2)))


def redirect_host(status: Column | str, location: Column | str) -> Column:
    """Host a 3xx response points to, NULL if there is none."""
    host = F.regexp_extract(as_col(location), REDIRECT_HOST, 1)
    is_redirect = F.floor(as_col(status) / 100) == 3
    return F.when(is_redirect & (host != ""), host)


def asn_or_unknown(c: Column | str) -> Column:
    """ASN text to bigint; the no-match markers become NULL."""
    return as_col(c).try_cast("bigint")


def favicon_status_label(c: Column | str) -> Column:
    code = as_col(c)
    label = F.lit(None).cast("string")
    for value, text in FAVICON_STATUS.items():
        label = F.when(code == value, text).otherwise(label)
    return label
