"""The labelled set: 29 claims, one page."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tallymark.operators.containment import is_blocking
from tallymark.operators.runs import bootstrap
from tallymark.operators.sources import check_sources

GOLD = json.loads((Path(__file__).parent / "gold.json").read_text())
URL = "https://www.rfc-editor.org/rfc/rfc2606.txt"


def test_flags_of_the_labelled_claims(spark):
    claims = spark.createDataFrame([(k, c["claim"], URL, c["on_page"]) for k, c in enumerate(GOLD["claims"])], "k int, claim string, source_url string, on_page boolean")
    pages = spark.createDataFrame([(URL, 200, GOLD["page"], URL, "text/plain", "text", None, False, False)], "url string, status int, text string, final_url string, content_type string, kind string, error string, blocked boolean, truncated boolean")
    none = spark.createDataFrame([], "url string, snapshot_date string, snapshot_url string, a_status int, a_text string, a_kind string, a_truncated boolean")
    rows = check_sources(claims, pages, none).select("on_page", "tier", "branch", is_blocking(F.col("tier")).alias("flagged")).collect()
    assert len(rows) == 29 and {r.branch for r in rows} == {"live"}
    absent, there = [r for r in rows if not r.on_page], [r for r in rows if r.on_page]
    assert (sum(r.flagged for r in absent), len(absent)) == (10, 15)
    assert (sum(r.flagged for r in there), len(there)) == (5, 14) and {r.tier for r in there if r.flagged} == {"low_match"}
    intervals = bootstrap([(r.on_page, r.flagged) for r in rows])
    for name in ("recall", "precision"):
        low, high = intervals[name]
        assert 0.35 < low < 10 / 15 < high < 0.95
