"""Functions on URLs: organisations, links, guards against private addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: host prefixes in the order in which they are taken off
HOST_PREFIXES = ("www.", "blog.", "status.", "engineering.", "tech.")
# fixed values: second-level names that stand for a country's top level
SECOND_LEVEL = ("co", "com", "org", "io", "net")
# fixed values: what an address must not contain to be a report
SKIP = ("github.com/danluu", "github.com/hjacobs", "creativecommons.org", "shields.io", "badge", "#")
# fixed value: a markdown link to the web
LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """The host without user, port and brackets, lower-cased; null if there is none."""
    bare = F.regexp_replace(F.lower(netloc(url)), r"^.*@", "")
    return F.nullif(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":\d*$", "")), F.lit(""))


def extract_org(url: Column) -> Column:
    """The organisation a URL belongs to; ``unknown`` without one."""
    h = F.lower(netloc(url))
    for prefix in HOST_PREFIXES:
        h = F.regexp_replace(h, "^" + prefix.replace(".", "\\."), "")
    parts = F.split(h, "\\.", -1)
    last, second, third = (F.try_element_at(parts, F.lit(-k)) for k in (1, 2, 3))
    pages = (F.size(parts) >= 3) & last.isin("io", "com") & second.isin("github", "gitlab")
    named = F.when(pages, parts[0]).when((F.size(parts) >= 3) & second.isin(*SECOND_LEVEL), third).when(F.size(parts) >= 2, second).otherwise(F.coalesce(F.nullif(h, F.lit("")), F.lit("unknown")))
    return F.when(url.isNull() | (url == ""), "unknown").otherwise(named)


def is_report_url(url: Column) -> Column:
    """Whether none of the skipped substrings occurs."""
    bad = F.lit(False)
    for s in SKIP:
        bad = bad | F.contains(url, F.lit(s))
    return ~bad


def links(markdown: Column) -> Column:
    """The targets of a text's links, in order, without slashes at their end."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(LINK), F.lit(2)), lambda u: F.regexp_replace(F.regexp_replace(u, r"^\s+|\s+$", ""), "/+$", ""))


def is_private_address(host_: Column) -> Column:
    """Whether a literal IP address is private, loopback, link-local or reserved. Names aren't resolved here."""
    v4 = host_.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    octets = F.transform(F.split(host_, "\\."), lambda o: o.try_cast("int"))
    a, b, c = octets[0], F.get(octets, F.lit(1)), F.get(octets, F.lit(2))
    private = (
        a.isin(0, 10, 127) | (a >= 240) | ((a == 100) & b.between(64, 127) & F.lit(False)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100)))) | ((a == 203) & (b == 0) & (c == 113))
    )
    v6 = host_.rlike(r"(?i)^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*|100::.*)$")
    return (v4 & private) | v6


def url_verdict(url: Column) -> Column:
    """``ok`` or why a URL must not be fetched."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(~scheme.isin("http", "https") | url.isNull(), "scheme").when(host(url).isNull(), "host").when((host(url) == "localhost") | is_private_address(host(url)), "address").otherwise("ok")
