from datetime import datetime, timedelta

from tallymark.operators import runs
from tallymark.streaming import limits

T0 = datetime(2025, 1, 1)
EVENTS = "event int, client string, ts timestamp"


def events(spark, *rows):
    return spark.createDataFrame([(i, c, T0 + timedelta(seconds=s)) for i, (c, s) in enumerate(rows)], EVENTS)


def test_first_of_a_window_are_allowed(spark):
    df = events(spark, ("a", 0), ("a", 1), ("a", 2), ("a", 601), (None, 3), ("b", 4))
    got = {r.event: r.allowed for r in limits.rate_limited(df, "client", "ts", "event", limit=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    assert all(r.allowed for r in limits.rate_limited(df, "client", "ts", "event", limit=0).collect())


def test_first_to_ask_holds_the_lease(spark):
    df = events(spark, ("a", 5), ("a", 1), ("a", 61), ("b", 1), ("b", 1))
    assert {(r.key, r.holder) for r in limits.leases(df, "client", "ts", "event").collect()} == {("a", 1), ("a", 2), ("b", 3)}


def test_spacing_matches_the_slot_rule(spark):
    times = [0, 0, 0.5, 10, 10.2, 10.3]
    df = events(spark, *[("a", t) for t in times])
    want, free = [], 0.0
    for t in times:
        at = max(t, free)
        want.append(at)
        free = at + 1
    got = [r.starts for r in limits.throttled(df, "client", "ts", "event").orderBy("event").collect()]
    assert [round(g - got[0], 6) for g in got] == [round(w, 6) for w in want]


def test_stream_counts_like_the_batch(spark, tmp_path):
    events(spark, *[("a", s) for s in range(12)], ("b", 1)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = limits.window_counts(stream, "client", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.n, r.refused) for r in spark.table("counts").collect()} == {("a", 12, 2), ("b", 1, 0)}


def test_runs(spark):
    a = spark.createDataFrame([(0, "x", "verified"), (1, "y", None), (2, "z", "broken")], "index int, id string, tier string")
    b = spark.createDataFrame([(0, "x", "broken"), (1, "y", "verified"), (2, "z", "broken")], "index int, id string, tier string")
    assert {(r["index"], r.old_tier, r.new_tier) for r in runs.drift(a, b).collect()} == {(0, "verified", "broken"), (1, None, "verified")}
    assert [r.batch for r in runs.batches(spark.range(17).withColumnRenamed("id", "index")).orderBy("index").collect()][::8] == [0, 1, 2]
    ci = runs.bootstrap([(False, True)] * 10 + [(False, False)] * 5 + [(True, True)] * 5 + [(True, False)] * 9)
    assert ci["recall"][0] < 10 / 15 < ci["recall"][1]


def streamed(spark, tmp_path, name, df, make):
    """Rows of ``make`` over the events in three files, one micro-batch each, in the order of time."""
    rows = sorted(df.collect(), key=lambda r: (r.ts, r.event))
    folder = str(tmp_path / name)
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_decide_like_their_batch_twins(spark, tmp_path):
    df = events(spark, *[(c, 37 * i % 1500 + (i % 7) / 10) for i, c in enumerate("aabac" * 9)], (None, 3))
    batch = {r.event: (r.slot, r.allowed) for r in limits.rate_limited(df, "client", "ts", "event", limit=3).where("client is not null").collect()}
    assert {r.event: (r.slot, r.allowed) for r in streamed(spark, tmp_path, "limited", df, lambda s: limits.rate_limited_stream(s, "client", "ts", "event", limit=3))} == batch
    held = {(r.key, r.slot, r.holder) for r in limits.leases(df, "client", "ts", "event").collect()}
    assert {(r.key, r.slot, r.holder) for r in streamed(spark, tmp_path, "leased", df, lambda s: limits.leases_stream(s, "client", "ts", "event"))} == held
    starts = {r.event: round(r.starts, 3) for r in limits.throttled(df, "client", "ts", "event", 30.0).where("client is not null").collect()}
    assert {r.event: round(r.starts, 3) for r in streamed(spark, tmp_path, "spaced", df, lambda s: limits.throttled_stream(s, "client", "ts", "event", 30.0))} == starts


def test_pending_batches_and_clocks(spark):
    jobs = spark.createDataFrame([("j", 0), ("j", 1), ("k", 0)], "job string, batch int")
    done = spark.createDataFrame([("j", 0, 1), ("j", 0, 2)], "job string, batch int, n int")
    assert {tuple(r) for r in limits.pending(jobs, done).collect()} == {("j", 1), ("k", 0)}
    clocks = spark.createDataFrame([(1, T0, T0 + timedelta(seconds=300)), (2, T0, T0 + timedelta(seconds=301)), (3, T0 + timedelta(seconds=299), T0), (4, None, T0)], "k int, a timestamp, b timestamp")
    assert {r.k for r in limits.fresh(clocks, "a", "b").collect()} == {1, 3}
