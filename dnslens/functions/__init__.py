from .dns import answered_recursively, decode_dns_responses, response_fields
from .ip import class_c, format_ip, ip_to_long, is_reserved, prefix
from .text import (
    asn_or_unknown,
    clean_metadata_tag,
    favicon_status_label,
    ptr_base_domain,
    redirect_host,
    whois_org,
)

__all__ = [
    "answered_recursively",
    "asn_or_unknown",
    "class_c",
    "clean_metadata_tag",
    "decode_dns_responses",
    "favicon_status_label",
    "format_ip",
    "ip_to_long",
    "is_reserved",
    "prefix",
    "ptr_base_domain",
    "redirect_host",
    "response_fields",
    "whois_org",
]
