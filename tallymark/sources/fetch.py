"""The one stage that touches the network: guarded GETs of distinct addresses, off unless called.

Every hop's address is judged before and after its name is resolved, and the connection goes to an address that was
judged. Addresses of one host share a task, which spaces them; that is the point of a host's limit, so a host that
a third of all claims point to is read by one task, one page a second.
"""

from __future__ import annotations

import email.utils
import http.client
import ipaddress
import random
import socket
import ssl
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.urls import address_problem, host, is_private
from tallymark.sources.html import decode_body, html_text, kind_of

SCHEMA = "url string, status int, text string, final_url string, content_type string, kind string, error string, blocked boolean, truncated boolean, transient boolean, retry_after double"
PASSING = (408, 425, 429, 500, 502, 503, 504)
MAX_WAIT = 30.0


@dataclass(frozen=True)
class Policy:
    """What may be fetched, and how patiently."""

    allow_private: bool = False
    allow_hosts: frozenset[str] = frozenset()
    max_bytes: int = 5_000_000
    max_redirects: int = 5
    timeout: float = 10.0
    retries: int = 2
    delay: float = 1.0


class Refused(Exception):
    """The policy forbids this address."""


def _judged_address(name: str, port: int, policy: Policy) -> tuple:
    """An address of a host whose every address is public, or the policy exempts it."""
    found = socket.getaddrinfo(name, port, type=socket.SOCK_STREAM)
    if not (policy.allow_private or name.lower() in policy.allow_hosts):
        for *_, at in found:
            if is_private(ipaddress.ip_address(at[0].partition("%")[0])):
                raise Refused(f"refused: {name} resolves to a non-public address")
    return found[0][4]


def _get(url: str, policy: Policy) -> tuple[http.client.HTTPResponse, http.client.HTTPConnection]:
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme.lower() == "https" else 80)
    at = _judged_address(parts.hostname, port, policy)
    raw = socket.create_connection(at[:2], policy.timeout)
    if parts.scheme.lower() == "https":
        raw = ssl.create_default_context().wrap_socket(raw, server_hostname=parts.hostname)
    c = http.client.HTTPConnection(parts.hostname, port, timeout=policy.timeout)
    c.sock = raw
    c.request("GET", (parts.path or "/") + ("?" + parts.query if parts.query else ""), headers={"User-Agent": "tallymark", "Accept-Encoding": "identity"})
    return c.getresponse(), c


def retry_after(value: str | None) -> float | None:
    """Seconds to wait, from a number or a date."""
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - time.time())
    except (TypeError, ValueError):
        return None


def fetch_once(url: str, policy: Policy) -> dict:
    """One attempt; never raises."""
    out = dict.fromkeys((c.split()[0] for c in SCHEMA.split(", ")), None) | {"url": url, "text": "", "final_url": "", "content_type": "", "kind": "", "error": "", "blocked": False, "truncated": False, "transient": False}
    at = url
    try:
        for _ in range(policy.max_redirects + 1):
            if problem := address_problem(at, policy.allow_private, policy.allow_hosts):
                raise Refused(f"refused: {problem}")
            response, connection = _get(at, policy)
            try:
                if response.status in (301, 302, 303, 307, 308) and response.getheader("Location"):
                    at = urljoin(at, response.getheader("Location"))
                    continue
                body = response.read(policy.max_bytes + 1)
            finally:
                connection.close()
            declared = response.getheader("Content-Type") or ""
            kind = kind_of(declared, body)
            text = "" if kind in ("pdf", "binary") else decode_body(body[: policy.max_bytes], declared)
            return out | {"status": response.status, "final_url": at, "content_type": declared, "kind": kind, "text": html_text(text) if kind == "html" else " ".join(text.split()), "truncated": len(body) > policy.max_bytes, "transient": response.status in PASSING, "retry_after": retry_after(response.getheader("Retry-After"))}
        return out | {"error": "too many redirects"}
    except Refused as e:
        return out | {"error": str(e), "blocked": True}
    except (OSError, http.client.HTTPException, ValueError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"[:200], "transient": True}


def fetch(url: str, policy: Policy) -> dict:
    """With retries: the wait doubles, or is what the server asks, up to half a minute."""
    for n in range(policy.retries + 1):
        r = fetch_once(url, policy)
        if not r["transient"] or n == policy.retries:
            return r
        time.sleep(min(MAX_WAIT, r["retry_after"] if r["retry_after"] is not None else 2.0**n + random.uniform(0, 0.25)))
    return r


def fetch_pages(claims: DataFrame, policy: Policy = Policy(), url: str = "source_url") -> DataFrame:  # noqa: B008
    """One result per distinct web address; a refused one is a result too."""
    urls = claims.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("_host", host(F.col("url")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for b in batches:
            for u, h in zip(b["url"], b["_host"], strict=True):
                time.sleep(max(0.0, free.get(h, 0.0) - time.monotonic()))
                yield pd.DataFrame([fetch(u, policy)])
                free[h] = time.monotonic() + policy.delay

    return urls.repartition("_host").mapInPandas(run, SCHEMA)
