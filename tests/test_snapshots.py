from datetime import datetime

import pytest

from tallymark.operators.snapshots import changes, row_hash, verdict_changes
from pyspark.sql import functions as F

SCHEMA = "snapshot_no int, delivered_at timestamp, checked_at timestamp, document string, id string, claim string, source_url string, tier string, _row string, _hash int"


def at(h):
    return datetime(2025, 1, 1, h)


def row(no, doc, id_, tier, claim="c", url="u", h=1):
    return (no, at(h), at(h), doc, id_, claim, url, tier, "x", 1)


def brute(rows):
    import re

    def canon(x):
        return None if x is None else re.sub(r"[\s_\-./]+", "_", x.strip().lower())

    snaps = {}
    for r in rows:
        if r[0] is None or r[4] is None or not r[4].strip():
            continue
        key = (r[3], canon(r[4]))
        old = snaps.setdefault(r[0], {}).get(key)
        if old is None or (r[2], r[1]) >= (old[2], old[1]):
            snaps[r[0]][key] = r
    out = set()
    nos = sorted(snaps)
    for a, b in zip(nos, nos[1:], strict=False):
        for k in {*snaps[a], *snaps[b]}:
            x, y = snaps[a].get(k), snaps[b].get(k)
            v = lambda r: (canon(r[7]), r[5], r[6])
            if x is None or y is None or v(x) != v(y):
                s = y or x
                out.add((b, s[3], s[4].strip().lower(), "added" if x is None else "removed" if y is None else "changed"))
    return out


def got(spark, rows):
    df = verdict_changes(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["snapshot_no", "document", "id", "change"]
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_kinds_of_change_and_spellings(spark):
    rows = [
        row(1, "d", "doc-1", "verified"), row(1, "d", "doc-2", None), row(1, "d", "doc-3", "broken"), row(1, "d", "doc-5", "low_match"),
        row(4, "d", " DOC-1 ", "VERIFIED "), row(4, "d", "doc-2", "broken"), row(4, "d", "doc-4", None), row(4, "d", "doc-5", "low match"),
        row(6, "d", "doc-1", "verified", claim="other"), row(6, "d", "doc_2", "broken"), row(6, "d", "doc-4", None),
    ]
    want = {(4, "d", "doc-2", "changed"), (4, "d", "doc-3", "removed"), (4, "d", "doc-4", "added"), (6, "d", "doc-1", "changed"), (6, "d", "doc-5", "removed")}
    assert got(spark, rows) == want == brute(rows)


def test_latest_row_stands_and_repeats_count_once(spark):
    rows = [row(1, "d", "a", "verified", h=1), row(1, "d", "a", "broken", h=5), row(2, "d", "a", "broken", h=2), row(2, "d", "a", "broken", h=2)]
    assert got(spark, rows) == set()


def test_null_document_id_and_snapshot(spark):
    rows = [row(1, None, "a", "verified"), row(2, None, "a", "broken"), row(2, "d", None, "broken"), row(2, "d", "  ", "broken"), row(None, "d", "b", "broken")]
    assert got(spark, rows) == {(2, None, "a", "changed")}


@pytest.mark.parametrize("rows", [[], [row(3, "d", "a", "verified")]])
def test_empty_and_single_snapshot(spark, rows):
    assert got(spark, rows) == set()


def test_random_rows_agree_with_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [row(r.choice([1, 2, 5, 9]), r.choice("pq"), r.choice(["a", "b", "C", " c", "d e", "d-e"]), r.choice([None, "x", "X", "y"]), claim=r.choice("st"), h=k % 24) for k in range(24)]
    assert got(spark, rows) == brute(rows)


def test_hash_keeps_values_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("1:a|", "a"), ("a|1:a", "")], "x string, y string")
    assert df.select(row_hash(F.col("x"), F.col("y"))).distinct().count() == 5


def test_general_form_over_any_table(spark):
    df = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (2, "n", 1)], "v int, k string, x int").withColumn("h", row_hash(F.col("x").cast("string")))
    assert {tuple(r) for r in changes(df, "v", ["k"], {"k": "k"}, "h", []).collect()} == {(2, "k", "changed"), (2, "n", "added")}
