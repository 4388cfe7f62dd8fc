"""Drafts, runs and limits over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import runs
from tallymark.operators.drafts import draft_summary, extract_pairs, listing
from tallymark.sources.cache import cache_key, cacheable
from tallymark.sources.claims import duplicate_ids as _duplicates
from tallymark.sources.tables import table
from tallymark.streaming import limits


def draft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link and bare address of the drafts with its claim."""
    return extract_pairs(table(spark, sf_dir, "documents").where("doc_kind = 'draft'"), "doc_id", "text")


def draft_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draft_pairs(spark, sf_dir).groupBy("bucket", "reason").agg(F.count("*").alias("n"))


def draft_first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_links(table(spark, sf_dir, "pairs", "document", "source_url", "line"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(table(spark, sf_dir, "claims", "claim_key", "id"), "id", "claim_key")


def _run(spark: SparkSession, sf_dir: str, no: str) -> DataFrame:
    r = table(spark, sf_dir, "recheck", "snapshot_no", "document", "row_index", "checked_at", "id", "tier").where("id is not null and snapshot_no is not null")
    edge = r.groupBy("document").agg(getattr(F, no)("snapshot_no").alias("snapshot_no"))
    one = r.join(edge, ["document", "snapshot_no"], "left_semi").groupBy("document", "row_index").agg(F.max(F.struct("checked_at", "id", "tier")).alias("t"))
    return one.select("document", F.col("row_index").alias("index"), "t.id", "t.tier")


def run_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's last run against its first, by place; the runs of these tables differ in length."""
    return runs.drift(_run(spark, sf_dir, "min"), _run(spark, sf_dir, "max"), by=("document",), strict=False)


def claim_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = runs.batches(table(spark, sf_dir, "claims", "claim_key").select(F.col("claim_key").alias("index")))
    return d.groupBy("batch").agg(F.count("*").alias("n"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_cache", "kind", "url").distinct().select("kind", "url", cache_key(F.col("kind"), F.col("url")).alias("cache_key"))


def cacheable_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cacheable(table(spark, sf_dir, "fetch_results", "fetch_id", "url", "blocked", "transient")).select("fetch_id", "url").distinct()


def fresh_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches that arrived within the tolerance of their own time."""
    return limits.fresh(table(spark, sf_dir, "fetch_results", "fetch_id", "fetched_at", "ingested_at"), "fetched_at", "ingested_at").select("fetch_id").distinct()


def draft_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each draft, by bucket."""
    return draft_summary(draft_pairs(spark, sf_dir))


def draft_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be checked of each draft, one line for a link."""
    return listing(draft_pairs(spark, sf_dir))


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    # Two for each window: the table has too few events of a user in ten minutes to reach the usual ten.
    e = limits.rate_limited(e, "user_id", "ts", "event_id", limit=2)
    return e.select("event_id", F.col("slot"), "allowed")


def lease_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.leases(table(spark, sf_dir, "events", "event_id", "ts", "event_type"), "event_type", "ts", "event_id")


def throttle_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = limits.throttled(table(spark, sf_dir, "events", "event_id", "ts", "user_id"), "user_id", "ts", "event_id", 30.0)
    return e.select("event_id", F.round(F.col("starts") * 1000).cast("bigint").alias("starts_ms"))


_RUNS = "select document, row_index, checked_at, id, tier, snapshot_no from recheck where id is not null and snapshot_no is not null"
_TOP = "qualify row_number() over (partition by document, row_index order by checked_at desc nulls last, id desc, tier desc nulls last) = 1"
SQL = {
    "draft_first_links": "select document, source_url, first from (select document, source_url, min(line) as first from pairs group by all) qualify row_number() over (partition by document order by first nulls first, source_url nulls first) <= 25",
    "duplicate_ids": "select id, count(*) as n, min(claim_key) as first from claims where id is not null group by id having count(*) > 1",
    "run_drift": f"""with b as ({_RUNS}), e as (select document, min(snapshot_no) as first, max(snapshot_no) as last from b group by document),
      o as (select b.* from b join e using (document) where snapshot_no = first {_TOP}), n as (select b.* from b join e using (document) where snapshot_no = last {_TOP})
      select coalesce(o.document, n.document) as document, coalesce(o.row_index, n.row_index) as index, coalesce(o.id, n.id) as id, o.tier as old_tier, n.tier as new_tier, o.snapshot_no is not null as in_old, n.snapshot_no is not null as in_new
      from o full join n on o.document = n.document and o.row_index = n.row_index where o.snapshot_no is null or n.snapshot_no is null or o.tier is distinct from n.tier""",
    "claim_batches": "select (claim_key // 8)::int as batch, count(*) as n from claims group by 1",
    "cache_keys": "select distinct kind, url, sha256(kind || chr(10) || url) as cache_key from page_cache",
    "cacheable_fetches": "select distinct fetch_id, url from fetch_results where not coalesce(blocked, false) and not coalesce(transient, false)",
    "fresh_fetches": "select distinct fetch_id from fetch_results where abs(floor(epoch(fetched_at)) - floor(epoch(ingested_at))) <= 300",
    "rate_limit_windows": "select event_id, floor(epoch(ts) / 600)::bigint as slot, user_id is null or row_number() over (partition by user_id, floor(epoch(ts) / 600) order by ts, event_id) <= 2 as allowed from events",
    "lease_first_wins": "select event_type as key, floor(epoch(ts) / 60)::bigint as slot, arg_min(event_id, (ts, event_id)) as holder from events where event_type is not null group by all",
    "throttle_slots": """with e as (select event_id, user_id, ts, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)
      select event_id, round((max(t - i * 30) over (partition by user_id order by ts, event_id) + i * 30) * 1000)::bigint as starts_ms from e""",
}
QUERIES = {f.__name__: f for f in (draft_pairs, draft_bucket_counts, draft_first_links, duplicate_ids, run_drift, claim_batches, cache_keys, cacheable_fetches, fresh_fetches, draft_summaries, draft_listing, rate_limit_windows, lease_first_wins, throttle_slots)}
