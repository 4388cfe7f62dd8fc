"""Web addresses: hosts, fetch policy, canonical forms and the state of links."""

from __future__ import annotations

import ipaddress
import re
import socket
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Sites that refuse readers, phrases of challenge pages, and networks that are not public.
BOT_WALLED = ("reddit.com", "x.com", "twitter.com", "linkedin.com", "glassdoor.com", "indeed.com")
CHALLENGES = ("please wait for verification", "checking your browser")
PRIVATE_V4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
PRIVATE_V6 = "::/96 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 5f00::/16 fc00::/7 fe80::/10 fec0::/10 ff00::/8".split()
NAT64 = "64:ff9b::/96"
LOCAL_ENDINGS = (".localhost", ".local", ".internal", ".home.arpa")

_V4, _V6, _NAT, _MAPPED = [ipaddress.ip_network(n) for n in PRIVATE_V4], [ipaddress.ip_network(n) for n in PRIVATE_V6], ipaddress.ip_network(NAT64), ipaddress.ip_network("::ffff:0:0/96")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column) -> Column:
    """Small letters, no port, user or closing dot; empty if there is none."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(h, r"\.+$|[\[\]]", ""))


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (host(url) != "")


def bot_walled(url: Column) -> Column:
    """The site among those that refuse readers; null if the address is elsewhere."""
    h = host(url)
    return F.coalesce(*[F.when((h == d) | h.endswith("." + d), d) for d in BOT_WALLED])


def canonical(url: Column) -> Column:
    """The address to fetch: a site that serves readers under an older name is asked there."""
    return F.when(host(url).isin("reddit.com", "www.reddit.com"), F.regexp_replace(url, r"^(\s*[A-Za-z]+://)(?:[^/?#@]*@)?[^/?#:]+", "$1old.reddit.com")).otherwise(url)


def is_challenge(status: Column, text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (status == 200) & (F.length(F.trim(t)) <= 200) & F.array_contains(F.array(*[t.contains(m) for m in CHALLENGES]), True)


def raw_snapshot(url: Column) -> Column:
    """An archive's address of the page as it was captured."""
    return F.regexp_replace(url, r"^(https?://[^/]+/web/\d+)(?:[a-z]{2}_)?/", "$1id_/")


def same_page(a: Column, b: Column) -> Column:
    plain = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/+$", "")
    return plain(a) == plain(b)


def link_status(url: Column, status: Column, final_url: Column, blocked: Column) -> Column:
    return (
        F.when(F.coalesce(blocked, F.lit(False)), "refused")
        .when(status.isNull(), "dead")
        .when(status.isin(401, 403, 429), "walled")
        .when(status >= 400, "dead")
        .when(final_url.isNotNull() & (final_url != "") & ~same_page(url, final_url), "redirected")
        .otherwise("ok")
    )


def _inner(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> ipaddress.IPv4Address | ipaddress.IPv6Address:
    """The IPv4 address that an IPv6 one stands for, else the address itself."""
    embeds = ip.version == 6 and any(ip in n for n in (_MAPPED, _NAT))
    return ipaddress.IPv4Address(ip.packed[-4:]) if embeds else ip


def is_private(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Whether an address is not a public one; embedded IPv4 addresses are judged themselves."""
    plain = _inner(ip)
    return any(plain in n for n in {4: _V4, 6: _V6}[plain.version])


def _as_ip(name: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    try:
        return ipaddress.ip_address(name.partition("%")[0])
    except ValueError:
        return None


def _as_number(name: str) -> bool:
    """Whether a name is an IPv4 address in another notation: one number, hexadecimal parts, or fewer than four of them."""
    if not re.fullmatch(r"[0-9a-fx.]*\d[0-9a-fx.]*", name):
        return False
    try:
        socket.inet_aton(name)
    except OSError:
        return False
    return True


def _problems(url: str, exempt: Callable[[str], bool]) -> Iterator[str]:
    """Everything that forbids an address, the gravest first."""
    try:
        parts = urllib.parse.urlsplit(url)
        port = parts.port
    except ValueError as e:
        yield f"malformed URL ({e})"
        return
    scheme_, name = parts.scheme.lower(), (parts.hostname or "").rstrip(".")
    if scheme_ not in ("http", "https"):
        yield f"URL scheme {f'{scheme_}:' if scheme_ else '(none)'} is not allowed; only http and https are fetched"
    if not name:
        yield "URL has no host"
    if port == 0:
        yield "URL has an invalid port"
    if exempt(name):
        return
    ip = _as_ip(name)
    if name == "localhost" or name.endswith(LOCAL_ENDINGS):
        yield f"host {name} is a local name"
    elif ip is not None and is_private(ip):
        yield f"address {ip} is not a public address"
    elif ip is None and _as_number(name):
        yield f"host {name} is a non-canonical numeric address"


def address_problem(url: str | None, allow_private: bool = False, allow_hosts: frozenset[str] = frozenset()) -> str | None:
    """Why an address must not be fetched; None if it may be."""
    return next(_problems(url or "", lambda name: allow_private or name.lower() in allow_hosts), None)


@F.pandas_udf(StringType())
def url_problem(url: pd.Series) -> pd.Series:
    """``address_problem`` under the default policy, for batches of addresses."""
    return url.map(address_problem, na_action=None)
