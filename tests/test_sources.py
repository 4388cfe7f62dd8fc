import json

import pytest
from pyspark.sql import functions as F

from tallymark.operators import urls
from tallymark.operators.sources import check_sources
from tallymark.sources import reports
from tallymark.sources.claims import InvalidClaims, duplicate_ids, load_claims
from tallymark.sources.html import decode_body, drafts_of_pages, html_text, html_to_markdown, kind_of, page_kind, with_page_text

LONG = "The harbour board approved the new ferry line on Monday after a long debate about cost. " * 4
PAGES = "url string, status int, text string, final_url string, content_type string, kind string, error string, blocked boolean, truncated boolean"
SNAPSHOTS = "url string, snapshot_date string, snapshot_url string, a_status int, a_text string, a_kind string, a_truncated boolean"
CLAIM = "The harbour board approved the new ferry line"


def page(url, status=200, text=LONG, kind="text", error=None, blocked=False, truncated=False):
    return (url, status, text, url, "text/plain", kind, error, blocked, truncated)


def test_every_branch_of_the_tree(spark):
    cases = [
        ("ftp://a.test/x", None, None, "broken", "none"),
        ("https://in.test/", page("https://in.test/", None, "", "", "refused: local", True), None, "broken", "none"),
        ("https://miss.test/", None, None, "unverified", "none"),
        ("https://live.test/", page("https://live.test/"), None, "verified", "live"),
        ("https://gone.test/", page("https://gone.test/", 404, ""), ("https://gone.test/", "20240101", "s", 200, LONG, "html", False), "verified", "wayback"),
        ("https://pdf-gone.test/", page("https://pdf-gone.test/", 404, ""), ("https://pdf-gone.test/", None, "s", 200, "", "pdf", False), "unverified", "none"),
        ("https://slow.test/", page("https://slow.test/", 429, ""), None, "snippet_only", "none"),
        ("https://www.linkedin.com/p", page("https://www.linkedin.com/p", 403, ""), None, "snippet_only", "none"),
        ("https://dead.test/", page("https://dead.test/", 500, ""), None, "broken", "none"),
        ("https://pdf.test/", page("https://pdf.test/", 200, "", "pdf"), None, "unverified", "none"),
        ("https://thin.test/", page("https://thin.test/", 200, "short"), None, "unverified", "live"),
        ("https://cut.test/", page("https://cut.test/", 200, "Other words entirely. " * 20, truncated=True), None, "unverified", "live"),
    ]
    claims = spark.createDataFrame([(i, CLAIM, c[0]) for i, c in enumerate(cases)] + [(99, None, None)], "i int, claim string, source_url string")
    pages = spark.createDataFrame([c[1] for c in cases if c[1]], PAGES)
    snaps = spark.createDataFrame([c[2] for c in cases if c[2]], SNAPSHOTS)
    got = {r.i: r for r in check_sources(claims, pages, snaps).collect()}
    for i, c in enumerate(cases):
        assert (got[i].tier, got[i].checked_against) == c[3:], (c[0], got[i])
    assert got[99].tier == "broken" and got[2].offline_miss and "20240101" in got[4].note and "not proven" in got[11].note


def test_addresses(spark):
    bad = ["http://127.0.0.1/", "http://[::1]/", "http://2130706433/", "http://127.1/", "http://localhost/x", "http://a.internal/", "http://[64:ff9b::7f00:1]/", "ftp://a.test/", "https:///x", "https://a.test:0/", "nonsense", None]
    assert all(urls.address_problem(u) for u in bad)
    assert not any(urls.address_problem(u) for u in ("https://example.com/", "http://8.8.8.8/", "http://[2606:4700::1]/"))
    assert urls.address_problem("http://127.0.0.1/", allow_private=True) is None
    df = spark.createDataFrame([("https://user@WWW.Reddit.com:8080/r?x#y",), ("http://x.com.evil.test/",), (None,)], "u string")
    r = df.select(urls.host(F.col("u")).alias("h"), urls.bot_walled(F.col("u")).alias("w"), urls.canonical(F.col("u")).alias("c")).collect()
    assert r[0].h == "www.reddit.com" and r[0].w == "reddit.com" and r[0].c == "https://old.reddit.com:8080/r?x#y"
    assert r[1].w is None and r[2].h == ""


def test_claims_file(spark, tmp_path):
    good = tmp_path / "c.json"
    good.write_text(json.dumps([{"claim": "a b", "source_url": "https://a.test", "extra": [1]}, {"id": 7, "claim": "c", "source_url": "u"}]))
    rows = load_claims(spark, str(good))
    assert [(r["index"], r.id, r.claim) for r in rows.select("index", "id", "claim").orderBy("index").collect()] == [(0, "#0", "a b"), (1, "7", "c")]
    bad = tmp_path / "d.json"
    bad.write_text(json.dumps([{"claim": " ", "source_url": 3}, 5, {"source_url": "u", "id": True}]))
    with pytest.raises(InvalidClaims) as e:
        load_claims(spark, str(bad))
    assert len(e.value.problems) == 5
    for text in ("{}", "not json"):
        bad.write_text(text)
        with pytest.raises(InvalidClaims):
            load_claims(spark, str(bad))
    d = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 4)], "id string, index int")
    assert [tuple(r) for r in duplicate_ids(d).collect()] == [("x", 2, 1)]


def test_pages(spark):
    assert html_text("<h1>A</h1><p>b &amp; c</p><script>x</script><style>y</style>") == "Ab & c"
    assert html_text('<meta name="description" content="d"><script type="application/ld+json">{"a": ["s", {"b": "t"}]}</script>') == "d s t"
    assert decode_body("é".encode("cp1252"), None) == "é" and decode_body("é".encode("latin-1"), "text/html; charset=latin-1") == "é"
    md, title = html_to_markdown("<title>T</title><nav>no</nav><h2>H</h2><p>See <a href='/x y'>[it]</a></p><ul><li>one</ul>", "https://a.test/")
    assert title == "T" and "## H" in md and "[(it)](https://a.test/x%20y)" in md and "- one" in md and "no" not in md
    rows = [("a", "text/html", b"<p>x</p>"), ("b", "", b"%PDF-1.7"), ("c", "", b"<!doctype html><p>y"), ("d", "image/png", b"\x00"), ("e", None, b"z  z")]
    got = {r.url: (r.kind, r.text) for r in with_page_text(spark.createDataFrame(rows, "url string, content_type string, body binary")).collect()}
    assert got == {"a": ("html", "x"), "b": ("pdf", ""), "c": ("html", "y"), "d": ("binary", ""), "e": ("text", "z z")}


def test_json_ld_and_hidden_parts():
    assert html_text('<script type="application/ld+json">{"k": "v", "n": {"z": ["a\\u00e9", 3, "b: c"]}}</script>') == "v aé b: c"
    assert html_text('<script type="application/ld+json">{not json</script>x') == "{not json x"
    md, _ = html_to_markdown("<div hidden><p>no</p></div><button>no</button><p style='display : none'>no</p><p>Mail <a href='mailto:a@b'>us</a> at <a href='/p'>port</a></p><table><tr><td>a<td>b</table>", "https://a.test/x")
    assert "no" not in md and "Mail us at [port](https://a.test/p)" in md and "mailto" not in md
    deep = html_to_markdown("<div>" * 5000 + "deep" + "</div>" * 5000)[0]
    assert deep == "deep\n"


def test_one_rule_of_kinds(spark):
    cases = [("text/html", b"x"), ("application/atom+xml; charset=x", b""), ("application/ld+json", b"{}"), ("application/vnd.json-seq", b""), ("", b"  <HTML>"), ("", b"text <html> in the middle"), ("", b"pre <body>"), (None, b"a\x00b"), ("text/plain", b"%PDF-1"), ("image/png", b""), (None, None), ("TEXT/Plain", b"x")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, b binary")
    got = [r.kind for r in df.select("k", page_kind(F.col("t"), F.col("b")).alias("kind")).orderBy("k").collect()]
    assert got == [kind_of(t, b or b"") for t, b in cases] == ["html", "html", "text", "binary", "html", "text", "html", "binary", "pdf", "binary", "text", "text"]


def test_pages_as_drafts(spark):
    rows = [("https://a.test/posts/one?x=1", "text/html", b"<title>T</title><p>A <a href='/b'>b</a>"), ("https://a.test/", "text/html", b"<title>T</title>"), (None, None, b"# Pasted"), ("u", "application/pdf", b""), ("v", "text/plain", b"x" * 500_001), (None, None, None)]
    got = [(r.document, r.text, r.problem is None) for r in drafts_of_pages(spark.createDataFrame(rows, "url string, content_type string, body binary")).collect()]
    assert got == [("one", "A [b](https://a.test/b)\n", True), ("T", "\n", True), ("draft", "# Pasted", True), (None, None, False), (None, None, False), ("draft", "", True)]


def test_reports(spark):
    rows = [(0, "a", "c<", "https://a.test", "verified", "", 1.0, 0.5, False, 3), (1, "b", "d", "javascript:x", "unsupported", "n", 0.0, 0.0, False, 1)]
    df = spark.createDataFrame(rows, "index int, id string, claim string, source_url string, tier string, note string, quoted double, topical double, offline_miss boolean, line int")
    s = reports.summary(df)
    assert s["total"] == 2 and s["blocking"] == 1 and s["exit_code"] == 1 and s["counts"]["low_match"] == 0
    assert reports.exit_code(0, 1) == 3 and reports.exit_code(0, 1, 1) == 4 and reports.exit_code(0, 0) == 0
    page_ = reports.certificate(df, "T<")
    assert "c&lt;" in page_ and 'href="javascript' not in page_ and page_.index("Not on page") < page_.index("Verified")
    assert "quoted 1.00" in reports.text_table(df).orderBy("index").first().line
    entries = df.withColumn("entry", F.parse_json(F.lit('{"id": 7, "x": [1]}')))
    got = json.loads(reports.annotated(entries, "2025-01-01").orderBy("index").first().json)
    assert got == {"id": 7, "x": [1], "verification_tier": "verified", "verification_note": "", "verified_at": "2025-01-01"}


def test_words_of_a_report(spark):
    counts = dict.fromkeys(("unsupported", "broken", "low_match", "unverified", "snippet_only", "verified"), 0) | {"unsupported": 1, "low_match": 2, "unverified": 1}
    told = reports.sentences(counts, offline_misses=1, strict=True)
    assert told[0] == "4 claims checked: 1 not on page, 2 needs review, 1 unverified."
    assert told[1].startswith("1 claim is not on the page") and told[2].startswith("2 claims share words with their page but are") and told[3].startswith("1 claim was never") and told[4] == "1 source had no stored copy." and len(told) == 5
    assert reports.sentences({}) == ["0 claims checked: none."] and reports.plural(2, "entry", "entries") == "2 entries"
    x = [0.03125, 0.00625, 0.5, 1.0, 0.0, 2 / 3, 0.00005, 0.12345]
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", reports.exactly_rounded(F.col("x")).alias("x")).orderBy("k").collect()]
    assert got == [round(v, 4) for v in x]
    rows = [(0, "a", "c", "https://a.test", "verified", "", 1.0, 0.5, False, 3)]
    df = spark.createDataFrame(rows, "index int, id string, claim string, source_url string, tier string, note string, quoted double, topical double, offline_miss boolean, line int")
    head = json.loads(reports.header(df, checked_at="x"))
    assert head["schema_version"] == 1 and head["summary"]["exit_code"] == 0 and head["options"] == {"strict": False, "offline": False, "wayback": True}
    page_ = reports.certificate(df, "T", spark.createDataFrame([(9, "<u>", "navigational link")], "line int, source_url string, reason string"))
    assert "Verified: 1" in page_ and "Not checked (1)" in page_ and "&lt;u&gt;" in page_
