"""Steps of work and routed messages, replayed over the table of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog import Tables
from quarry.queries import query
from quarry.sources.shared import shared_path
from quarry.streaming import work
from quarry.streaming.upserts import EVERYONE, KeyedTable, heard

_kinds = "CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' WHEN 'purchase' THEN 'finish' ELSE 'fail' END"


@query("work_leases", f"""WITH RECURSIVE e AS (SELECT user_id || ':' || (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4) AS step, ts, event_id AS id, {_kinds} AS kind, 'w' || event_id % 2 AS worker, greatest(10, CAST(floor(value) AS BIGINT) * 900) AS secs FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY ts, id) AS n FROM e), t AS (SELECT max(ts) AS now FROM e),
  r(step, n, state, worker, until, attempt, version, expired, rejected) AS (
    SELECT DISTINCT step, CAST(0 AS BIGINT), 'ready', CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM e
    UNION ALL
    SELECT step, n, CASE WHEN NOT ok THEN s WHEN kind = 'claim' OR kind = 'heartbeat' THEN 'running' WHEN kind = 'finish' THEN 'succeeded' WHEN attempt < 3 THEN 'retry_wait' ELSE 'failed' END,
           CASE WHEN NOT ok THEN w WHEN kind = 'claim' OR kind = 'heartbeat' THEN worker END, CASE WHEN NOT ok THEN u WHEN kind = 'claim' OR kind = 'heartbeat' THEN ts + to_seconds(secs) END,
           attempt + CAST(ok AND kind = 'claim' AS INT), version + CAST(x AS INT) + CAST(ok AND kind <> 'heartbeat' AS INT), expired + CAST(x AS INT), rejected + CAST(NOT ok AS INT)
    FROM (SELECT *, CASE WHEN kind = 'claim' THEN s IN ('ready', 'retry_wait') ELSE s = 'running' AND w = worker END AS ok
          FROM (SELECT o.step, o.n, o.kind, o.worker, o.secs, o.ts, r.attempt, r.version, r.expired, r.rejected, r.state = 'running' AND r.until <= o.ts AS x,
                       CASE WHEN r.state = 'running' AND r.until <= o.ts THEN CASE WHEN r.attempt < 3 THEN 'retry_wait' ELSE 'failed' END ELSE r.state END AS s,
                       CASE WHEN r.state = 'running' AND r.until <= o.ts THEN NULL ELSE r.worker END AS w, CASE WHEN r.state = 'running' AND r.until <= o.ts THEN NULL ELSE r.until END AS u
                FROM r JOIN o ON o.step = r.step AND o.n = r.n + 1))),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC) AS back FROM r) WHERE back = 1)
  SELECT step, CASE WHEN state = 'running' AND until <= now THEN CASE WHEN attempt < 3 THEN 'retry_wait' ELSE 'failed' END ELSE state END AS state, attempt AS attempts,
         version + CAST(state = 'running' AND coalesce(until <= now, false) AS INT) AS version, expired + CAST(state = 'running' AND coalesce(until <= now, false) AS INT) AS expired, rejected FROM f, t""")
def leases(t: Tables):
    """What became of each step (a user's events of four days) when leases that weren't renewed had run out."""
    days = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 4).cast("string")
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "heartbeat").when(F.col("event_type") == "purchase", "finish").otherwise("fail")
    events = t("events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), days).alias("step"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"),
        (F.floor("value") * 900).cast("double").alias("seconds"),
    )
    return work.outcome(work.replayed(events))


@query("upsert_by_key", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT user_id, event_id, event_type, value FROM e WHERE back = 1 AND event_type <> 'signup'""")
def upserted(t: Tables):
    """Each user's latest event, merged from three batches that come out of order, one of them twice; a signup removes the user."""
    rows = t("events").withColumn("gone", F.col("event_type") == "signup")
    rows = rows.select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("at"), "gone")
    table = KeyedTable(t.spark, shared_path(t.spark, "users"), rows.schema, ("user_id",), "at", "gone")
    for batch, part in ((0, 2), (1, 0), (0, 2), (2, 1), (2, 1)):
        table.merge(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), batch)
    return table.read().select("user_id", "event_id", "event_type", "value")


@query("messages_routed", """WITH s AS (SELECT s_suppkey AS subscriber, CASE s_nationkey % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' ELSE 'purchase' END AS channel FROM supplier), h AS (SELECT * FROM s UNION SELECT subscriber, '*' FROM s)
  SELECT subscriber, channel, count(*) AS messages, max(event_id) AS last_message FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN '*' ELSE event_type END AS channel FROM events) JOIN h USING (channel) GROUP BY 1, 2""")
def routes(t: Tables):
    """How many messages each subscriber hears on each channel; signups go to everyone."""
    kind = F.when(F.col("s_nationkey") % 4 == 0, "view").when(F.col("s_nationkey") % 4 == 1, "click").when(F.col("s_nationkey") % 4 == 2, "error").otherwise("purchase")
    channel = F.when(F.col("event_type") == "signup", EVERYONE).otherwise(F.col("event_type"))
    subscriptions = t("supplier").select(kind.alias("channel"), F.col("s_suppkey").alias("subscriber"))
    return heard(t("events").select("event_id", channel.alias("channel")), subscriptions, F.count("*").alias("messages"), F.max("event_id").alias("last_message"))
