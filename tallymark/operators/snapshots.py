"""What was added, removed or changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that may stand between the words of an id or a tier.
_SIGNS = r"[\s_\-\x{2010}-\x{2015}./]+"


def bare(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def canonical(c: Column) -> Column:
    """``bare`` with one sign between words, so that spellings of one name agree."""
    return F.regexp_replace(bare(c), f"(?U){_SIGNS}", "_")


def row_hash(*columns: Column) -> Column:
    """SHA-256 over the values; each carries its length, and null is unlike any value."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat_ws("|", *map(part, columns)), 256)


def changes(
    df: DataFrame,
    snapshot: str,
    keys: Sequence[str],
    shown: dict[str, str],
    digest: str,
    latest: Sequence[str],
) -> DataFrame:
    """One row per key that differs between a snapshot and the one before.

    df: rows of all snapshots. snapshot: the column that orders them (numbers may be skipped).
    keys: the primary key's columns; null equals null. shown: output name -> column taken from the
    later side, or from the earlier one for a removed key. digest: the canonical row hash.
    latest: of several rows of a key in a snapshot, the one with the greatest ``latest`` stands
    (null last; the hash settles ties). Rows without a snapshot number have no place and are left out.
    Result: snapshot, the shown columns, change (``added``, ``removed``, ``changed``). An empty table or
    a single snapshot gives no rows.

    The rows are first reduced to one small struct per key and snapshot, before the shuffle where they
    repeat. Both sides of the full outer join read that one exchange. A key's rows in a snapshot
    are the largest group, so a document holding a third of all rows is spread by its ids.
    """
    keys = list(keys)
    one = (
        df.where(F.col(snapshot).isNotNull())
        .select(
            F.col(snapshot).alias("_no"),
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.struct(*[F.col(c) for c in latest], F.col(digest).alias("_hash"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(shown.values())]).alias("_row"),
        )
        .groupBy("_no", *[f"_k{i}" for i in range(len(keys))])
        .agg(F.max("_row").alias("_row"))
        .select("_no", *[f"_k{i}" for i in range(len(keys))], "_row._hash", *[f"_row._s{i}" for i in range(len(shown))])
    )
    # One row per delivery: as few as the snapshots there are, whatever their size.
    numbers = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("_no")).distinct()
    steps = numbers.withColumn("_next", F.expr("lead(_no) over (order by _no)")).where("_next is not null")
    first = numbers.agg(F.min("_no").alias("_first"))
    old = one.join(F.broadcast(steps), "_no").drop("_no")
    new = one.join(F.broadcast(first), F.col("_no") > F.col("_first")).drop("_first")
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o._next") == F.col("n._no")
    for i in range(len(keys)):
        same &= F.col(f"o._k{i}").eqNullSafe(F.col(f"n._k{i}"))
    change = F.when(F.col("o._hash").isNull(), "added").when(F.col("n._hash").isNull(), "removed").when(F.col("o._hash") != F.col("n._hash"), "changed")
    side = lambda i: F.when(F.col("n._hash").isNull(), F.col(f"o._s{i}")).otherwise(F.col(f"n._s{i}"))
    return (
        o.join(n, same, "full_outer")
        .select(
            F.coalesce("n._no", "o._next").alias(snapshot),
            *[side(i).alias(name) for i, name in enumerate(shown)],
            change.alias("change"),
        )
        .where("change is not null")
    )


def verdict_changes(recheck: DataFrame) -> DataFrame:
    """``changes`` over stored verdicts: a record is a document and an id.

    Ids and tiers that differ in letter case, outer blanks or the sign between words are the same; rows
    whose id is null or blank don't count; tier, claim and source_url make up the hash.
    """
    rows = recheck.select(
        "snapshot_no",
        "document",
        "checked_at",
        "delivered_at",
        bare(F.col("id")).alias("id"),
        canonical(F.col("id")).alias("key"),
        row_hash(canonical(F.col("tier")), F.col("claim"), F.col("source_url")).alias("digest"),
    ).where("id <> ''")
    return changes(rows, "snapshot_no", ["document", "key"], {"document": "document", "id": "id"}, "digest", ["checked_at", "delivered_at"])
