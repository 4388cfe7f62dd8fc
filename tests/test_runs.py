"""Stored runs, re-checks, drift, the page cache, and faults that must not end a run."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from tallymark.operators import drafts, runs
from tallymark.operators.sources import check_sources
from tallymark.sources.cache import cacheable, read_cache, write_cache

LONG = "The harbour board approved the new ferry line on Monday after a long debate about cost. " * 4
CLAIM = "The harbour board approved the new ferry line"
PAGES = "url string, status int, text string, final_url string, content_type string, kind string, error string, blocked boolean, truncated boolean"
SNAPSHOTS = "url string, snapshot_date string, snapshot_url string, a_status int, a_text string, a_kind string, a_truncated boolean"


def pages(spark, *rows):
    return spark.createDataFrame([(u, 200, t, u, "text/plain", "text", e, False, False) for u, t, e in rows], PAGES)


def stored(tmp_path, name, *results):
    at = tmp_path / f"{name}.json"
    at.write_text(json.dumps({"document": name, "checked_at": "2025-01-01T00:00:00Z", "results": list(results), "extra": 1}, indent=1))
    return str(at)


def result(k, tier, url="https://a.test/", **other):
    return {"index": k, "id": f"c{k}", "claim": CLAIM, "source_url": url, "tier": tier, "line": k, "bucket": "checkable"} | other


def test_recheck_of_a_stored_run(spark, tmp_path):
    path = stored(tmp_path, "brief", result(0, "verified"), result(1, "broken"), result(2, "verified", "https://gone.test/"))
    again = runs.recheck(runs.stored_run(spark, path), pages(spark, ("https://a.test/", LONG, None)), spark.createDataFrame([], SNAPSHOTS)).collect()
    assert {(r.document, r["index"], r.id, r.old_tier, r.new_tier) for r in again} == {("brief", 1, "c1", "broken", "verified"), ("brief", 2, "c2", "verified", "unverified")}
    assert runs.stored_run(spark, stored(tmp_path, "empty")).count() == 0


def test_a_stored_result_must_be_complete(spark, tmp_path):
    with pytest.raises(PySparkException, match="lacks claim"):
        runs.stored_run(spark, stored(tmp_path, "bad", result(0, "verified", claim=None))).collect()


def test_drift_of_runs_that_differ_in_length(spark):
    schema = "document string, index int, id string, tier string"
    old = spark.createDataFrame([("a", 0, "x", "verified"), ("a", 1, "y", None), ("b", 0, "z", "broken")], schema)
    new = spark.createDataFrame([("a", 0, "x", "verified"), ("a", 1, "y", None), ("a", 2, "w", "broken")], schema)
    got = {tuple(r) for r in runs.drift(old, new, by=("document",), strict=False).collect()}
    assert got == {("a", 2, "w", None, "broken", False, True), ("b", 0, "z", "broken", None, True, False)}
    with pytest.raises(PySparkException, match="differ in length"):
        runs.drift(old, new, by=("document",)).collect()
    assert runs.drift(old, old, by=("document",)).count() == 0 and runs.drift(old.limit(0), old.limit(0), by=("document",)).count() == 0


def test_a_source_that_fails_leaves_its_claims_unverified(spark):
    claims = spark.createDataFrame([(1, CLAIM, "https://a.test/"), (2, CLAIM, "https://b.test/")], "k int, claim string, source_url string")
    p = pages(spark, ("https://a.test/", LONG, "internal_error: ValueError: x"), ("https://b.test/", LONG, None))
    got = {r.k: r for r in check_sources(claims, p, spark.createDataFrame([], SNAPSHOTS)).collect()}
    assert (got[1].tier, got[1].branch, got[1].checked_against) == ("unverified", "internal_error", "none") and "ValueError" in got[1].note
    assert got[2].tier == "verified"


def test_a_draft_that_fails_is_one_excluded_row(monkeypatch):
    monkeypatch.setattr(drafts, "blocks", lambda text: 1 / 0)
    (row,) = drafts._safely("x")
    assert row["bucket"] == "excluded" and row["reason"].startswith("internal_error: ZeroDivisionError") and set(row) == {c.split()[0] for c in drafts.SCHEMA.split(", ")} - {"document"}


def record(kind, url, **data):
    name = hashlib.sha256(f"{kind}\n{url}".encode()).hexdigest()
    return name, {"cache_format": 1, "kind": kind, "url": url, "stored_at": "2025-01-01", "data": {"status": 200, "text": "t", "blocked": False, "transient": False} | data}


def test_page_cache(spark, tmp_path):
    folder = tmp_path / "cache"
    folder.mkdir()
    good, moved, old = record("page", "https://a.test/"), record("page", "https://b.test/"), record("page", "https://c.test/")
    (folder / f"{good[0]}.json").write_text(json.dumps(good[1]))
    (folder / f"{'0' * 64}.json").write_text(json.dumps(moved[1]))  # not under its own key
    (folder / f"{old[0]}.json").write_text(json.dumps(old[1] | {"cache_format": 0}))
    (folder / f"{'1' * 64}.json").write_text("{broken")
    records = read_cache(spark, str(folder))
    assert [(r.url, r.data.status) for r in records.collect()] == [("https://a.test/", 200)]
    write_cache(records, str(tmp_path / "table"))
    write_cache(records.limit(0), str(tmp_path / "table"))
    (back,) = spark.read.parquet(str(tmp_path / "table")).collect()
    assert back.cache_key == good[0] and back.data.text == "t"
    f = spark.createDataFrame([(1, None, None), (2, True, False), (3, False, True)], "k int, blocked boolean, transient boolean")
    assert [r.k for r in cacheable(f).collect()] == [1]
