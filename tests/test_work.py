"""Leases and transitions in streams of several batches, against a replay and by hand."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.streaming import work

SCHEMA = "step string, ts timestamp, id long, kind string, worker string, seconds double"


def frame(spark, rows):
    return spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(seconds=t), i, k, w, x) for i, (s, t, k, w, x) in enumerate(rows)], SCHEMA)


def stream_of(spark, folder, batches):
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{folder}/{n:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def log_of(df):
    return sorted((r.step, r.at.isoformat(), r.event, r.before, r.after, r.worker or "", r.attempt, r.version) for r in df.collect())


def test_by_hand(spark):
    rows = [
        ("a", 0, "claim", "w1", 20.0), ("a", 5, "heartbeat", "w2", 20.0), ("a", 15, "heartbeat", "w1", 20.0), ("a", 50, "finish", "w1", None), ("a", 60, "claim", "w2", 1.0), ("a", 65, "finish", "w2", None), ("a", 70, "claim", "w1", 9.0),
        ("b", 0, "claim", "w1", 1.0), ("b", 100, "claim", "w1", 1.0), ("c", 3, "cancel", None, None), ("c", 4, "claim", "w1", 5.0), ("d", 1, "unknown", "w", None), ("e", 1, "hold", None, None), ("e", 2, "reopen", None, None), ("e", 3, "approve", None, None), (None, 1, "claim", "w", 1.0),
    ]
    got = [(r.step, r.event, r.after, r.attempt) for r in work.replayed(frame(spark, rows), most=2, until="2024-01-01 01:00:00").orderBy("step", "at", "version").collect()]
    assert got == [
        ("a", "claim", "running", 1), ("a", "heartbeat rejected", "running", 1), ("a", "heartbeat", "running", 1), ("a", "lease_expired", "retry_wait", 1), ("a", "finish rejected", "retry_wait", 1),
        ("a", "claim", "running", 2), ("a", "finish", "succeeded", 2), ("a", "claim rejected", "succeeded", 2),
        ("b", "claim", "running", 1), ("b", "lease_expired", "retry_wait", 1), ("b", "claim", "running", 2), ("b", "lease_expired", "failed", 2),
        ("c", "cancel", "canceled", 0), ("c", "claim rejected", "canceled", 0), ("d", "unknown rejected", "ready", 0),
        ("e", "hold", "waiting_approval", 0), ("e", "reopen rejected", "waiting_approval", 0), ("e", "approve", "ready", 0),
    ]


def test_stream_equals_replay(spark, tmp_path):
    """Five batches; many leases run out in a batch that holds no event of their steps."""
    rng = random.Random(5)
    kinds = ["claim"] * 6 + ["heartbeat"] * 3 + ["finish", "fail", "fail", "hold", "approve", "reopen", "reopen", "cancel"]
    rows = sorted(((f"s{rng.randint(0, 25)}", t * 7 + rng.randint(0, 6), rng.choice(kinds), rng.choice(["w1", "w2"]), rng.choice([1.0, 30.0, 200.0])) for t in range(220)), key=lambda r: r[1])
    rows.append(("last", 100_000, "claim", "w1", 10.0))  # moves the watermark past all leases but its own
    every = frame(spark, rows)
    cuts = [0, 40, 90, 150, 220, 221]
    batches = [every.where((F.col("id") >= a) & (F.col("id") < b)) for a, b in zip(cuts, cuts[1:])]
    stream = work.leased(stream_of(spark, tmp_path / "in", batches), most=2, forget_s=1e9)
    got = log_of(work.run_to(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    want = log_of(work.replayed(every, most=2))
    assert got == want and sum(r[2] == "lease_expired" for r in got) > 20
    again = work.leased(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), most=2, forget_s=1e9)
    assert log_of(work.run_to(again, str(tmp_path / "out"), str(tmp_path / "checkpoint"))) == got  # nothing new, nothing twice


def test_ended_steps_are_forgotten(spark, tmp_path):
    rows = [("a", 0, "claim", "w1", 20.0), ("a", 1, "finish", "w1", None), ("b", 500, "claim", "w1", 20.0), ("b", 2000, "claim", "w1", 20.0), ("a", 3000, "claim", "w1", 20.0)]
    batches = [frame(spark, rows).where(F.col("id") == i) for i in range(5)]
    stream = work.leased(stream_of(spark, tmp_path / "in", batches), forget_s=100.0)
    got = log_of(work.run_to(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    assert [(r[2], r[6], r[7]) for r in got if r[0] == "a"] == [("claim", 1, 1), ("finish", 1, 2), ("claim", 1, 1)]


def test_replay_takes_groups_one_by_one(spark):
    """Steps and events that lie over several Arrow batches, and a plan that builds no group."""
    rows = [(f"s{i % 7}", i, "claim" if i % 14 < 7 else "finish", "w1", 1e6) for i in range(200)]
    events = frame(spark, rows)
    want = log_of(work.replayed(events))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        replay = work.replayed(events.repartition(5))
        assert log_of(replay) == want and len(want) == 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in replay._jdf.queryExecution().toString()


def test_leases_by_any_zone(spark):
    """A lease over the hour that is left out in spring runs as long as any other."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        given = spark.sql("SELECT 'a' AS step, timestamp_seconds(1711846800 - 1800 + 5400 * n) AS ts, n AS id, IF(n = 0, 'claim', 'finish') AS kind, 'w' AS worker, 6000D AS seconds FROM VALUES (0L), (1L) AS t(n)")
        assert [r.event for r in work.replayed(given).orderBy("version").collect()] == ["claim", "finish"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
