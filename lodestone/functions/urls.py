"""URL functions as Catalyst expressions, and the address guard of the crawler."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path segments that give a document its role, first rule first.
ROLE_RULES = (
    ("Engineering", ("/eng/", "/dev/", "/tech/")),
    ("HR", ("/hr/", "/careers/", "/people/")),
    ("Finance", ("/finance/", "/pricing/", "/billing/")),
    ("Admin", ("/admin/", "/internal/")),
)
#: Endings that make a dotted name a file, not a site.
FILE_ENDINGS = "py|md|txt|json|csv|js|jsx|ts|tsx"


def assigned_role(url: Column) -> Column:
    out = F.lit("Public")
    for role, parts in reversed(ROLE_RULES):
        out = F.when(F.lower(url).rlike("|".join(parts)), role).otherwise(out)
    return out


def in_domain(url: Column, domain: str) -> Column:
    """Whether the url holds the domain anywhere, whatever the case."""
    return F.contains(F.lower(url), F.lit(domain.lower()))


def host(url: Column) -> Column:
    """Host name in small letters, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def normalized(url: Column) -> Column:
    """Small letters in scheme and network place, one closing slash of the path gone (an empty path is a slash), no fragment."""
    pattern = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, place, path, query = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3, 4))
    cut = F.regexp_replace(path, "/$", "")
    asked = F.when(query == "?", "").otherwise(query)
    return F.concat(F.lower(scheme), F.lit("://"), F.lower(place), F.when(cut == "", "/").otherwise(cut), asked)


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether the network place is one of the domains or below one; without domains all are."""
    if not domains:
        return F.lit(True)
    place = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    return F.exists(F.array(*(F.lit(d.lower()) for d in domains)), lambda d: (place == d) | F.endswith(place, F.concat(F.lit("."), d)))


def safe_href(url: Column) -> Column:
    site = url.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9-]{1,61}[a-zA-Z0-9]\.[a-zA-Z]{2,}(/.*)?$")
    file = url.rlike(rf"(?i)\.({FILE_ENDINGS})$")
    return F.when(url.rlike("^https?://"), url).when(site & ~file, F.concat(F.lit("https://"), url)).otherwise("#")


def is_safe_address(address: str) -> bool:
    """Whether an address literal is public."""
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return False
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified)


def is_safe_url(url: str, resolve: Callable[[str], list[str]] | None = None) -> bool:
    """Whether the scheme is http(s) and every address of the host is public; names resolve by ``resolve`` (none: unsafe)."""
    try:
        parts = urlsplit(url)
        name = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not name:
        return False
    try:
        ipaddress.ip_address(name)
        found = [name]
    except ValueError:
        found = resolve(name) if resolve else []
    return bool(found) and all(map(is_safe_address, found))
