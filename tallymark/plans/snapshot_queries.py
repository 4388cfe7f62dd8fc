"""Queries over the delivered snapshots of verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.snapshots import verdict_changes
from tallymark.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_changes(table(spark, sf_dir, "recheck"))


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences per snapshot and kind."""
    return p1_found(spark, sf_dir).groupBy("snapshot_no", "change").agg(F.count("*").alias("n"))


_SIGNS = r"[\s_\-\x{2010}-\x{2015}./]+"
_BARE = "lower(regexp_replace({}, '^[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{3000}}]+$', '', 'g'))"
_PART = "coalesce(length({0})::varchar || ':' || {0}, '-')"
_P1 = f"""
with r as (
  select snapshot_no as no, document, checked_at, delivered_at, {_BARE.format("id")} as id, claim, source_url,
         regexp_replace({_BARE.format("tier")}, '{_SIGNS}', '_', 'g') as tier
  from recheck),
h as (
  select no, document, checked_at, delivered_at, id, regexp_replace(id, '{_SIGNS}', '_', 'g') as key,
         sha256({_PART.format("tier")} || '|' || {_PART.format("claim")} || '|' || {_PART.format("source_url")}) as digest
  from r where id <> '' and no is not null),
one as (
  select * from h qualify row_number() over (partition by no, document, key
    order by checked_at desc nulls last, delivered_at desc nulls last, digest desc, id desc) = 1),
steps as (select no, lead(no) over (order by no) as nxt from (select distinct snapshot_no as no from recheck where snapshot_no is not null)),
o as (select one.*, nxt from one join steps using (no) where nxt is not null),
n as (select * from one where no > (select min(no) from steps)),
j as (
  select coalesce(n.no, o.nxt) as snapshot_no,
         case when n.digest is null then o.document else n.document end as document,
         case when n.digest is null then o.id else n.id end as id,
         case when o.digest is null then 'added' when n.digest is null then 'removed' when o.digest <> n.digest then 'changed' end as change
  from o full outer join n on o.nxt = n.no and o.document is not distinct from n.document and o.key = n.key)
"""

QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts}
SQL = {
    "p1_found": _P1 + "select snapshot_no, document, id, change from j where change is not null",
    "p1_change_counts": _P1 + "select snapshot_no, change, count(*) as n from j where change is not null group by all",
}
