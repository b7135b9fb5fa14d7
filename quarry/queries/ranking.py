"""Rank within a key: latest rows, trends, running sums, lexicographic choice."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.operators import ranked
from quarry.plans.catalog import Tables
from quarry.queries import query


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest(t: Tables):
    return ranked.latest(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("price_trend", """WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
  SELECT o_custkey, o_orderkey, round((o_totalprice - before) / before, 4) AS change, CASE WHEN before IS NULL THEN NULL WHEN round((o_totalprice - before) / before, 4) > 0.05 THEN 'up' WHEN round((o_totalprice - before) / before, 4) < -0.05 THEN 'down' ELSE 'stable' END AS trend FROM p""")
def price_trend(t: Tables):
    before = ranked.with_previous(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    change = F.round(F.try_divide(F.col("o_totalprice") - F.col("previous_o_totalprice"), F.col("previous_o_totalprice")), 4)
    return before.select("o_custkey", "o_orderkey", change.alias("change"), ranked.trend(change).alias("trend"))


@query("price_stability", """WITH l AS (SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5),
  a AS (SELECT *, avg(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS m FROM l) SELECT o_custkey, round(1 - max(abs(o_totalprice - m)) / max(m), 3) AS stability FROM a GROUP BY 1""")
def stability(t: Tables):
    last = ranked.latest(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5)
    own = last.withColumn("m", F.avg("o_totalprice").over(W.partitionBy("o_custkey")))
    return own.groupBy("o_custkey").agg(F.round(1 - F.max(F.abs(F.col("o_totalprice") - F.col("m"))) / F.max("m"), 3).alias("stability"))


@query("running_balance", "SELECT event_id, user_id, CAST(sum(CAST(CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM events")
def balance(t: Tables):
    signed = t("events").withColumn("signed", F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")))
    return ranked.with_running_sum(signed, ["user_id"], ["ts", "event_id"], "signed", "balance").select("event_id", "user_id", "balance")


@query("carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS category FROM events""")
def carry(t: Tables):
    own = t("events").withColumn("head", F.when(F.col("event_type") == "signup", F.col("props")))
    return ranked.carried_forward(own, ["user_id"], ["ts", "event_id"], "head", "category").select("event_id", "category")


@query("best_with_margin", """WITH b AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS i, q - lead(q) OVER w AS margin FROM b WINDOW w AS (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey))
  SELECT l_partkey, l_suppkey, q AS l_quantity, margin FROM r WHERE i = 1""")
def margin(t: Tables):
    return ranked.best_with_margin(t("lineitem"), ["l_partkey"], "l_suppkey", "l_quantity").select("l_partkey", "l_suppkey", "l_quantity", "margin")


@query("lexicographic_choice", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_tax, l_quantity DESC, l_suppkey, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def choice(t: Tables):
    order = F.struct((-F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"), (-F.col("l_quantity")).alias("c"), F.col("l_suppkey").alias("d"), F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("f"))
    best = t("lineitem").groupBy("l_partkey").agg(F.min(order).alias("best"))
    return best.select("l_partkey", F.col("best.d").alias("l_suppkey"), F.col("best.e").alias("l_orderkey"))


@query("top_events_per_user", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def top_events(t: Tables):
    return ranked.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "ts")


@query("event_sequence_numbers", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def sequence(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("sequence"))


@query("dedup_first_by_rank", "SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def first_by_rank(t: Tables):
    """The longest document of each language and source, by an aggregate: nothing but its key and size is shuffled."""
    best = t("documents").groupBy("lang", "source").agg(F.min(F.struct((-F.col("n_chars")).alias("size"), "doc_id")).alias("best"))
    return best.select("lang", "source", "best.doc_id")


@query("lease_claim", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1999-01-01' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 10")
def claim(t: Tables):
    due = t("orders").where("o_orderstatus = 'P' AND o_orderdate <= timestamp '1999-01-01'")
    return due.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(10).select("o_orderkey", "o_orderpriority")
