"""Host rules on urls, by pattern so that unusual but real hosts do not become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
DOTTED = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
# Address blocks that are not public.
PRIVATE_V4 = (
    r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.[02]\.|"
    r"198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2[4-5]\d\.)"
)
PRIVATE_V6 = r"^(?:::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def with_scheme(url: Column) -> Column:
    """Read a bare host as https."""
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    """Lower-case host without user, port or IPv6 brackets; empty when there is none."""
    netloc = F.regexp_replace(F.regexp_extract(url, NETLOC, 1), "^.*@", "")
    bare = F.when(
        netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.regexp_replace(netloc, r":\d*$", ""))
    return F.lower(bare)


def site_host(url: Column) -> Column:
    """Host without a leading "www."."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def domain_key(website: Column) -> Column:
    """Domain used for source matching: network location, lower case, without "www."."""
    netloc = F.regexp_extract(with_scheme(website), NETLOC, 1)
    return F.regexp_replace(F.lower(netloc), r"^www\.", "")


def is_http(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def is_public(url: Column) -> Column:
    """http(s) with a host that is neither local nor a private address literal."""
    name = host(url)
    private = (F.rlike(name, F.lit(DOTTED)) & F.rlike(name, F.lit(PRIVATE_V4))) | F.rlike(
        name, F.lit(PRIVATE_V6)
    )
    return F.coalesce(is_http(url) & (name != "") & (name != "localhost") & ~private, F.lit(False))


def same_site(base: Column, other: Column) -> Column:
    return is_http(other) & (site_host(base) == site_host(other))


def host_in(name: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of the list or a sub-domain of one (a single pattern)."""
    known = "|".join(host.replace(".", r"\.") for host in hosts)
    return F.rlike(name, F.lit(rf"^(?:.*\.)?(?:{known})$"))


def website_path_key(url: Column) -> Column:
    """Path part of a website signature: lower case, booking suffix and last slash removed."""
    lowered = F.lower(path(with_scheme(url)))
    return F.regexp_replace(
        F.regexp_replace(lowered, "/(?:book|onlinebookingform).*", ""), "/+$", ""
    )


def link_rank(url: Column, terms: tuple[str, ...]) -> Column:
    """0 when the letters of the url contain a wanted word, else 1."""
    letters = F.regexp_replace(F.lower(url), "[^a-z]", "")
    return F.when(F.rlike(letters, F.lit("|".join(terms))), 0).otherwise(1)
