import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tallymark.sources.fetch import Policy, fetch, fetch_once, fetch_pages, retry_after


class Site(BaseHTTPRequestHandler):
    hits: list[str] = []

    def do_GET(self):  # noqa: N802
        self.hits.append(self.path)
        status, headers, body = {
            "/page": (200, {"Content-Type": "text/html"}, b"<p>Hello &amp; <b>there</b></p>"),
            "/away": (302, {"Location": "/page"}, b""),
            "/round": (302, {"Location": "/round"}, b""),
            "/inside": (302, {"Location": "http://169.254.169.254/x"}, b""),
            "/big": (200, {"Content-Type": "text/plain"}, b"x" * 5000),
            "/busy": (503, {"Retry-After": "0"}, b""),
            "/pdf": (200, {}, b"%PDF-1.7"),
        }.get(self.path, (404, {}, b"no"))
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


OPEN = Policy(allow_hosts=frozenset({"127.0.0.1"}), delay=0.0, max_bytes=1000)


def test_pages_redirects_and_limits(base):
    assert fetch_once(f"{base}/page", OPEN)["text"] == "Hello & there"
    away = fetch_once(f"{base}/away", OPEN)
    assert away["final_url"] == f"{base}/page" and away["status"] == 200
    assert fetch_once(f"{base}/round", OPEN)["error"] == "too many redirects"
    assert fetch_once(f"{base}/inside", OPEN)["blocked"]
    big = fetch_once(f"{base}/big", OPEN)
    assert big["truncated"] and len(big["text"]) == 1000
    assert fetch_once(f"{base}/pdf", OPEN)["kind"] == "pdf"
    assert fetch_once(f"{base}/page", Policy())["blocked"] and fetch_once("ftp://x", OPEN)["blocked"]
    assert fetch_once("http://127.0.0.1:9/", OPEN)["transient"]


def test_retries(base):
    Site.hits.clear()
    assert fetch(f"{base}/busy", OPEN)["status"] == 503 and Site.hits.count("/busy") == 3
    assert retry_after("7") == 7.0 and retry_after("junk") is None and retry_after("Wed, 21 Oct 2015 07:28:00 GMT") == 0.0


def test_one_visit_per_address(spark, base):
    Site.hits.clear()
    df = spark.createDataFrame([(f"{base}/page",)] * 5 + [(None,), ("nonsense",)], "source_url string")
    got = {r.url: r for r in fetch_pages(df, OPEN).collect()}
    assert len(got) == 2 and got[f"{base}/page"].status == 200 and got["nonsense"].blocked and Site.hits == ["/page"]
