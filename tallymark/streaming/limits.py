"""Rate limits, leases and host spacing over event streams; each also as a batch query.

A tumbling window and a key make a group; its first events win. Over a stream the same counting is done with
a watermark, so state of closed windows is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE_SECONDS, RATE_LIMIT, LEASE_SECONDS, SPACING_SECONDS, SKEW_SECONDS = 600, 10, 60, 1.0, 300


def slot(ts: Column, seconds: int) -> Column:
    """Number of the tumbling window that a time falls into."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


def rate_limited(events: DataFrame, key: str, ts: str, event: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """Adds ``slot`` and ``allowed``: the first ``limit`` events of a key in a window; no key or no limit allows all."""
    rows = events.withColumn("slot", slot(F.col(ts), seconds))
    if limit <= 0:
        return rows.withColumn("allowed", F.lit(True))
    # Events without a key are many and not ranked: no task gets them all.
    w = W.partitionBy(key, "slot").orderBy(ts, event)
    ranked = rows.where(F.col(key).isNotNull()).withColumn("allowed", F.row_number().over(w) <= limit)
    return ranked.unionByName(rows.where(F.col(key).isNull()).withColumn("allowed", F.lit(True)))


def leases(events: DataFrame, key: str, ts: str, event: str, seconds: int = LEASE_SECONDS) -> DataFrame:
    """(key, slot, holder): of each window the first event to ask, ties by the event's id."""
    return events.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), slot(F.col(ts), seconds).alias("slot")).agg(F.min_by(event, F.struct(ts, event)).alias("holder"))


def throttled(events: DataFrame, key: str, ts: str, event: str, delay: float = SPACING_SECONDS) -> DataFrame:
    """Adds ``starts``, seconds since 1970: no two events of a key start less than ``delay`` apart, none before its time.

    Closed form of "the later of now and the last start plus the delay": a running maximum of time less delay times place.
    A key's events are ordered in one task; keys are hosts or clients.
    """
    w = W.partitionBy(key).orderBy(ts, event)
    i = F.row_number().over(w) - 1
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    base = events.withColumn("_i", i).withColumn("_t", t - F.col("_i") * delay)
    return base.withColumn("starts", F.max("_t").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("_i") * delay).drop("_i", "_t")


def window_counts(stream: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming: (key, window start, n, refused) per tumbling window, with a watermark for late events."""
    return (
        stream.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", f"{seconds} seconds"), F.col(key).alias("key"))
        .agg(F.count("*").alias("n"))
        .select("key", F.col("window.start").alias("start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))
    )


def fresh(events: DataFrame, signed: str, received: str, seconds: int = SKEW_SECONDS) -> DataFrame:
    """Events whose two clocks differ by no more than the tolerance."""
    return events.where(F.abs(F.unix_timestamp(F.col(signed).cast("timestamp")) - F.unix_timestamp(F.col(received).cast("timestamp"))) <= seconds)


def _by_key(stream: DataFrame, key: str, ts: str, event: str, late: str, out: str, step: Callable[[dict, pd.Series], tuple | None], keep: float) -> DataFrame:
    """Events of a stream in the order of their times, each shown to ``step`` with its key's state, a small dict that it changes.

    State is given up once the watermark is ``keep`` seconds past the key's newest event.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["_ts", "_event"], kind="stable")
        made = [x for _, row in rows.iterrows() if (x := step(held, row)) is not None]
        state.update((json.dumps(held),))
        newest = max(int(rows["_ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + int(keep * 1000) + 1)
        yield pd.DataFrame([(k[0], *x) for x in made], columns=["key", *[c.split()[0] for c in out.split(", ")]])

    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("_ts"), F.col(event).alias("_event")).where("key is not null")
    kinds = dict(rows.dtypes)
    return rows.withWatermark("_ts", late).groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, " + out.format(event=kinds["_event"]), "held string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited_stream(stream: DataFrame, key: str, ts: str, event: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``rate_limited``: (key, event, slot, allowed), decided as events come in."""

    def step(held: dict, row: pd.Series) -> tuple:
        at = int(row["_ts"].timestamp() // seconds)
        for old in [x for x in held if int(x) < at - 1]:  # closed windows
            del held[old]
        n = held[str(at)] = held.get(str(at), 0) + 1
        return row["_event"], at, limit <= 0 or n <= limit

    return _by_key(stream, key, ts, event, late, "event {event}, slot long, allowed boolean", step, 2 * seconds)


def leases_stream(stream: DataFrame, key: str, ts: str, event: str, seconds: int = LEASE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``leases``: (key, holder, slot), once per window, for the first event that comes in."""

    def step(held: dict, row: pd.Series) -> tuple | None:
        at = int(row["_ts"].timestamp() // seconds)
        if at <= held.get("slot", -1):
            return None
        held["slot"] = at
        return row["_event"], at

    return _by_key(stream, key, ts, event, late, "holder {event}, slot long", step, 2 * seconds)


def throttled_stream(stream: DataFrame, key: str, ts: str, event: str, delay: float = SPACING_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Streaming twin of ``throttled``: (key, event, starts), each event's start no sooner than the last one's plus the delay."""

    def step(held: dict, row: pd.Series) -> tuple:
        starts = max(row["_ts"].timestamp(), held.get("free", 0.0))
        held["free"] = starts + delay
        return row["_event"], starts

    return _by_key(stream, key, ts, event, late, "event {event}, starts double", step, 3600.0)


def pending(jobs: DataFrame, done: DataFrame, by: tuple[str, ...] = ("job", "batch")) -> DataFrame:
    """Batches of a job that have no result yet: what a run that was cut short goes on with. A batch done twice is done."""
    return jobs.join(done.select(*by).distinct(), list(by), "left_anti")
