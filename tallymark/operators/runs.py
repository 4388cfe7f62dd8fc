"""Runs over time: drift against a stored run, metrics against gold labels, links and batches."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.sources import check_sources

_RESULT = "index:int,id:string,claim:string,source_url:string,tier:string,note:string,quoted:double,topical:double,line:int,bucket:string"
BATCH, FIRST_LINKS = 8, 25


def drift(old: DataFrame, new: DataFrame, *, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """(*by, index, id, old_tier, new_tier, in_old, in_new) of the rows whose tier changed, matched by place, null unlike any tier.

    Runs of one document have equally many rows: where one side lacks a place, a strict comparison fails, the other reports it.
    """
    key = [*by, "index"]
    o = old.select(*key, F.col("id").alias("_a"), F.col("tier").alias("old_tier"), F.lit(True).alias("in_old"))
    n = new.select(*key, F.col("id").alias("_b"), F.col("tier").alias("new_tier"), F.lit(True).alias("in_new"))
    j = o.join(n, key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_old", "in_new")})
    if strict:
        gap = F.raise_error(F.concat(F.lit("runs differ in length at index "), F.col("index").cast("string")))
        j = j.withColumn("in_old", F.when(F.col("in_old") & F.col("in_new"), True).otherwise(gap.cast("boolean")))
    changed = (F.col("in_old") != F.col("in_new")) | ~F.col("old_tier").eqNullSafe(F.col("new_tier"))
    return j.where(changed).select(*key, F.coalesce("_a", "_b").alias("id"), "old_tier", "new_tier", "in_old", "in_new")


def stored_run(spark: SparkSession, path: str) -> DataFrame:
    """(document, index, id, claim, source_url, tier, bucket, line) of stored runs, JSON files of one run each.

    A result without id, claim, source_url or tier is an error: a run that can't be checked again must not pass for one.
    """
    runs = spark.read.option("multiLine", True).schema(f"document string, checked_at string, results array<struct<{_RESULT}>>").json(path)
    r = runs.select("document", F.posexplode_outer("results").alias("place", "r")).where("place is not null")
    lacks = [F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in ("id", "claim", "source_url", "tier")]
    wrong = F.concat_ws(", ", *lacks)
    problem = F.raise_error(F.concat(F.lit("stored result "), F.col("place").cast("string"), F.lit(" of "), F.coalesce("document", F.lit("a run")), F.lit(" lacks "), wrong))
    checked = F.when(wrong == "", F.col("r.tier")).otherwise(problem.cast("string"))
    return r.select("document", F.coalesce("r.index", "place").alias("index"), "r.id", "r.claim", "r.source_url", checked.alias("tier"), "r.bucket", "r.line")


def recheck(stored: DataFrame, pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The stored run's claims checked again against the pages of today: the rows whose tier changed."""
    again = check_sources(stored.drop("tier"), pages, snapshots)
    return drift(stored, again, by=("document",))


def batches(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds ``batch``: rows are taken ``size`` at a time by their index."""
    return df.withColumn("batch", F.floor(F.col("index") / size).cast("int"))


def first_links(pairs: DataFrame, n: int = FIRST_LINKS) -> DataFrame:
    """(document, source_url, first): the first n distinct addresses of each document, a top-k report."""
    at = pairs.groupBy("document", "source_url").agg(F.min("line").alias("first"))
    ranked = at.withColumn("rank", F.expr("row_number() over (partition by document order by first, source_url)"))
    return ranked.where(F.col("rank") <= n).drop("rank")


def bootstrap(flags: list[tuple[bool, bool]], resamples: int = 2000, seed: int = 0) -> dict[str, tuple[float, float]]:
    """95 % intervals of recall and precision over (on page, flagged) pairs of a labelled set, on the driver."""
    draw = random.Random(seed)
    found: dict[str, list[float]] = {"recall": [], "precision": []}
    for _ in range(resamples):
        sample = draw.choices(flags, k=len(flags))
        tp = sum(f and not g for g, f in sample)
        for name, base in (("recall", sum(not g for g, _ in sample)), ("precision", sum(f for _, f in sample))):
            if base:
                found[name].append(tp / base)
    return {k: (sorted(v)[int(0.025 * len(v))], sorted(v)[int(0.975 * len(v)) - 1]) for k, v in found.items() if v}
