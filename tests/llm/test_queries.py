"""Every query of the subpackage over awkward tables: empty ones, and rows of nulls, blanks, repeats and extra columns."""

import pytest

from tallymark.llm.queries import QUERIES

SCHEMAS = {
    "claims": "claim_key bigint, claim string, source_url string, skeleton string, src int",
    "pairs": "pair_id bigint, claim string, document string, start_pos string",
    "fetch_results": "fetch_id bigint, url string, status int, text string, content_type string, kind string, truncated boolean, key string, band int, cut int",
    "page_cache": "cache_id bigint, kind string, url string, row_id int, data struct<kind:string,text:string,status:int>",
    "documents": "doc_id bigint, text string, source string, n_tokens string, score int, lang string, share int",
    "doc_labels": "doc_id bigint, label string, rater string, text int",
    "eval_items": "item_id bigint, suite string, text string, doc_id int",
    "source_targets": "source string, target_share double, max_repeats int, n_tokens string",
}
ROWS = {
    "claims": [(1, None, None, "s", 1), (2, " ", "u", None, 1), (3, "Ａ", "u", "s", 1), (4, "A", "u", "s", 1), (4, "A", "u", "s", 1), (None, "A", None, None, None)],
    "pairs": [(1, "One. Two.", None, "1"), (1, "One. Two.", None, "1"), (2, None, None, None), (None, "x", None, None)],
    "fetch_results": [(1, "u", 200, "Prüfung PrÃ¼fung\nfoo", "t", "html", True, "k", 1, 1), (1, "u", 200, "Prüfung PrÃ¼fung\nfoo", "t", "html", True, "k", 1, 1), (2, None, None, None, None, None, None, None, None, None), (3, "u", 1, "", "t", "text", None, None, None, None), (4, "u", 1, "word " * 50_000, "t", "text", None, None, None, None), (None, "u", 1, "x", "t", "text", None, None, None, None)],
    "page_cache": [(1, "page", "u", 1, ("html", "a\nb", 200)), (2, "page", "u", 1, None), (None, None, None, None, None)],
    "documents": [(1, "Some words here.", "s", "1", 1, "en", 1), (2, None, None, None, None, None, None), (3, "", "s", None, None, None, None), (4, "word " * 50_000, " ", None, None, None, None)],
    "doc_labels": [(1, "abuse", "r", 1), (1, "abuse", "r", 1), (3, None, None, None), (None, "none", "r", 1)],
    "eval_items": [(1, "s", "some words here and a few more of them", 1), (2, None, None, None), (3, "s", "", 1)],
    "source_targets": [("s", 0.5, 2, "x"), ("t", 0.5, 1, None)],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = {k: str(tmp_path_factory.mktemp(k)) for k in ("empty", "awkward")}
    for t, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{at['empty']}/{t}.parquet")
        spark.createDataFrame(ROWS[t], schema).write.parquet(f"{at['awkward']}/{t}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_query(spark, folders, name, kind):
    df = QUERIES[name](spark, folders[kind])
    rows = df.collect()
    assert kind == "awkward" or not rows or name in ("p8_leaked_items", "p9_shares", "p9_found")
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
