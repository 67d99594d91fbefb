"""URL extraction and the unsafe-target test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import any_of, let

# What ends a URL, and punctuation that is not part of it.
URL = r"(?iU)https?://[^\s<>\"'`)]+"
QUICK_URL = r"(?iU)https?://[^\s<>\"]+"
URL_TAIL = r"[).,;:]+$"


def extract_urls(text: Column) -> Column:
    """Every URL of a text in order, trailing punctuation removed."""
    found = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    return F.when(
        text.rlike("(?i)https?://"), F.transform(found, lambda u: F.regexp_replace(u, URL_TAIL, ""))
    ).otherwise(F.array().cast("array<string>"))


# IPv4 blocks that are private, loopback, link-local or reserved.
UNSAFE_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
)
# Two addresses inside 192.0.0.0/24 are public.
PUBLIC_IPV4 = ("192.0.0.9/32", "192.0.0.10/32")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# IPv6 blocks open to the public are 2000::/3, multicast and the
# old site-local block, less the special-purpose ranges.
PUBLIC_IPV6 = r"^(?:[23][0-9a-f]{3}|ff[0-9a-f]{2}|fe[c-f][0-9a-f]):"
SPECIAL_IPV6 = r"^(?:2001:(?:0?[01]?[0-9a-f]{0,2}:|:|0?db8:)|2002:|3fff:0?[0-9a-f]{0,3}:)"


def _in_block(number: Column, block: str) -> Column:
    base, bits = block.split("/")
    low = sum(int(o) * 256 ** (3 - i) for i, o in enumerate(base.split(".")))
    return number.between(low, low + 2 ** (32 - int(bits)) - 1)


def _unsafe_ipv4(host: Column) -> Column:
    number = F.aggregate(F.split(host, r"\."), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint"))
    return let(
        number,
        lambda n: any_of(_in_block(n, b) for b in UNSAFE_IPV4) & ~any_of(_in_block(n, b) for b in PUBLIC_IPV4),
    )


def _unsafe_host(host: Column) -> Column:
    """The host as written in the URL, an IPv6 address still in its brackets."""
    bracketed = host.startswith("[")
    inner = F.rtrim(F.ltrim(host, F.lit("[")), F.lit("]"))
    mapped = F.regexp_extract(inner, r"^::ffff:([0-9.]+)$", 1)
    return (
        F.when(inner == "", True)
        .when(bracketed & mapped.rlike(IPV4), _unsafe_ipv4(mapped))
        .when(bracketed, ~inner.rlike(PUBLIC_IPV6) | inner.rlike(SPECIAL_IPV6))
        .when(host.rlike(IPV4), _unsafe_ipv4(host))
        .otherwise(False)
    )


def is_unsafe_url(url: Column) -> Column:
    """No http(s) scheme, no host, or a literal address that is not public.

    Host names are not resolved.
    """
    host = F.regexp_extract(url, r"^[^:/?#]*://(?:[^/?#@]*@)*(\[[^\]]*\]|[^/?#:@]*)", 1)
    return F.when(~url.rlike("(?i)^https?:"), True).otherwise(let(F.lower(host), _unsafe_host))
