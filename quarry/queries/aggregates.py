"""Aggregation: pivots, facets, filtered counts, percentiles, rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog import Tables
from quarry.queries import query


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("pivot_items_by_supplier", """SELECT coalesce(s_name, 'no supplier') AS supplier, count(*) AS item_count, count(DISTINCT l_orderkey) AS invoice_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
  CAST(round(avg(CAST(l_extendedprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS avg_amount, min(l_extendedprice) AS min_amount, max(l_extendedprice) AS max_amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def pivot_supplier(t: Tables):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return lines.groupBy(F.coalesce("s_name", F.lit("no supplier")).alias("supplier")).agg(
        F.count("*").alias("item_count"), F.countDistinct("l_orderkey").alias("invoice_count"), money("l_extendedprice").alias("total_amount"), F.round(F.avg(F.col("l_extendedprice").cast("decimal(18,4)")), 2).cast("double").alias("avg_amount"),
        F.min("l_extendedprice").alias("min_amount"), F.max("l_extendedprice").alias("max_amount"), money("l_quantity").alias("quantity"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ", ").alias("statuses"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
    )


@query("pivot_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS invoices, count(DISTINCT o_custkey) AS parties, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1")
def pivot_month(t: Tables):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("invoices"), F.countDistinct("o_custkey").alias("parties"), money("o_totalprice").alias("amount"))


@query("pivot_status_columns", """SELECT o_orderpriority AS priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DOUBLE) AS F, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS O,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P') AS DOUBLE) AS P FROM orders GROUP BY 1""")
def pivot_columns(t: Tables):
    return t("orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(money("o_totalprice"))


@query("pivot_distinct_items_first_seen", """WITH f AS (SELECT l_suppkey, p_name, min(l_shipdate) AS seen FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 5 GROUP BY 1, 2)
  SELECT l_suppkey AS supplier, string_agg(p_name, '; ' ORDER BY seen, p_name) AS items FROM f GROUP BY 1""")
def first_seen_items(t: Tables):
    seen = t("lineitem").join(t("part").where("p_size <= 5"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.min("l_shipdate").alias("seen"))
    entries = F.array_sort(F.collect_list(F.struct("seen", "p_name")))
    return seen.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.array_join(F.transform(entries, lambda x: x["p_name"]), "; ").alias("items"))


@query("facet_counts", """WITH b AS (SELECT * FROM part WHERE p_retailprice >= 950) SELECT 'type' AS facet, p_type AS value, count(*) AS n FROM b GROUP BY p_type UNION ALL SELECT 'brand', p_brand, count(*) FROM b GROUP BY p_brand
  UNION ALL SELECT 'name', p_name, count(*) FROM b GROUP BY p_name""")
def facet_counts(t: Tables):
    """All facets in one pass over the filtered rows."""
    base = t("part").where("p_retailprice >= 950").select(F.col("p_type").alias("type"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    sets = base.groupingSets([["type"], ["brand"], ["name"]], "type", "brand", "name").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "brand").otherwise("name")
    value = F.when(F.col("g") == 3, F.col("type")).when(F.col("g") == 5, F.col("brand")).otherwise(F.col("name"))
    return sets.select(name.alias("facet"), value.alias("value"), "n")


@query("dashboard_counters", """SELECT count(*) AS orders, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_totalprice > 450000) AS large, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS recent,
  count(DISTINCT o_custkey) AS parties FROM orders""")
def counters(t: Tables):
    return t("orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_totalprice") > 450000).alias("large"),
        F.count_if(F.col("o_orderdate") >= F.to_timestamp(F.lit("2001-01-01"))).alias("recent"), F.countDistinct("o_custkey").alias("parties"),
    )


@query("having_repeated", "SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, user_id, event_type LIMIT 100")
def having(t: Tables):
    few = t("events").where("value > 50").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 3")
    return few.orderBy(F.desc("n"), "user_id", "event_type").limit(100)


@query("failure_groups", """SELECT event_type, json_extract_string(props, '$.k') AS code, count(*) AS failures, min(event_id) AS sample FROM events
  WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-24' GROUP BY 1, 2 HAVING count(*) >= 5""")
def failures(t: Tables):
    own = t("events").where("event_type = 'error' AND ts >= timestamp '2024-01-24'")
    return own.groupBy("event_type", F.get_json_object("props", "$.k").alias("code")).agg(F.count("*").alias("failures"), F.min("event_id").alias("sample")).where("failures >= 5")


@query("percentile_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, max(value) FILTER (i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1) AS p50, max(value) FILTER (i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1) AS p95 FROM r GROUP BY 1""")
def percentiles(t: Tables):
    """Exact, from ranks: two passes of slim windows would do as well, but a type's values fit an array only by their counts, so values are counted first."""
    counted = t("events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    upto = F.sum("n").over(W.partitionBy("event_type").orderBy("value"))
    total = F.sum("n").over(W.partitionBy("event_type"))
    rank = lambda p: F.bround(p * (F.col("total") - 1), 0) + 1
    at = lambda p: F.max(F.when((F.col("upto") >= rank(p)) & (F.col("upto") - F.col("n") < rank(p)), F.col("value")))
    return counted.withColumn("upto", upto).withColumn("total", total).groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("percentile_small_groups", """WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT l_orderkey AS l_suppkey, l_quantity FROM lineitem))
  SELECT l_suppkey AS l_orderkey, max(l_quantity) FILTER (i = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1) AS p90 FROM r GROUP BY l_suppkey""")
def small_percentiles(t: Tables):
    return _counted_p90(t("lineitem").select(F.col("l_orderkey").alias("l_suppkey"), "l_quantity")).withColumnRenamed("l_suppkey", "l_orderkey")


@query("percentile_all_lines", """WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
  SELECT l_suppkey, max(l_quantity) FILTER (i = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1) AS p90 FROM r GROUP BY 1""")
def all_percentiles(t: Tables):
    return _counted_p90(t("lineitem"))


def _counted_p90(lines):
    """Lines are counted by supplier and quantity first, so that a supplier's group is as large as its different quantities."""
    from pyspark.sql import Window as W

    counted = lines.groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    own = W.partitionBy("l_suppkey")
    ranked = counted.withColumn("upto", F.sum("n").over(own.orderBy(F.col("l_quantity").asc_nulls_last()))).withColumn("total", F.sum("n").over(own))
    rank = F.bround(0.9 * (F.col("total") - 1), 0) + 1
    hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    return ranked.groupBy("l_suppkey").agg(F.max(F.when(hit, F.col("l_quantity"))).alias("p90"))


@query("acceptance_rate", """SELECT event_type, count(*) FILTER (value >= 10) AS accepted, count(*) FILTER (value < 5) AS dismissed,
  CASE WHEN count(*) >= 50 THEN round(count(*) FILTER (value >= 10) / CAST(count(*) FILTER (value >= 10) + count(*) FILTER (value < 5) AS DOUBLE), 4) END AS rate FROM events GROUP BY 1""")
def acceptance(t: Tables):
    accepted, dismissed = F.count_if(F.col("value") >= 10), F.count_if(F.col("value") < 5)
    rate = F.when(F.count("*") >= 50, F.round(F.try_divide(accepted.cast("double"), accepted + dismissed), 4))
    return t("events").groupBy("event_type").agg(accepted.alias("accepted"), dismissed.alias("dismissed"), rate.alias("rate"))


@query("macro_average", """WITH g AS (SELECT s_nationkey, l_suppkey, avg(CAST(l_discount AS DECIMAL(18,6))) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), c AS (SELECT s_nationkey, avg(m) AS m FROM g GROUP BY 1)
  SELECT round(avg(m), 6) AS macro FROM c""")
def macro(t: Tables):
    joined = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    groups = joined.groupBy("s_nationkey", "l_suppkey").agg(F.avg("l_discount").alias("m"))
    return groups.groupBy("s_nationkey").agg(F.avg("m").alias("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


@query("unnest_words_count", "SELECT w AS word, count(*) AS n, count(*) FILTER (p_type = 'PROMO') AS promo FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unnest(t: Tables):
    words = t("part").select("p_type", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("p_type") == "PROMO").alias("promo"))


@query("queue_margins", "SELECT o_orderstatus AS status, NULL AS priority, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM orders")
def margins(t: Tables):
    sets = t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority")
    return sets.agg(F.count("*").alias("n")).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "n")


@query("weighted_confidence", """SELECT l_orderkey, round(CAST(sum(CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END * (1 - CAST(l_discount AS DECIMAL(18,4)))) / sum(CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END) AS DOUBLE), 4) AS confidence FROM lineitem GROUP BY 1""")
def weighted(t: Tables):
    w = F.when(F.col("l_linenumber") == 1, 2).otherwise(1)
    return t("lineitem").groupBy("l_orderkey").agg(F.round((F.sum(w * (1 - F.col("l_discount").cast("decimal(18,4)"))) / F.sum(w)).cast("double"), 4).alias("confidence"))


@query("telemetry", """SELECT event_type AS task, count(*) AS calls, count(*) FILTER (value > 30) AS slow, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(ts) AS latest FROM events GROUP BY 1 ORDER BY calls DESC, task""")
def telemetry(t: Tables):
    return t("events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 30).alias("slow"), money("value").alias("total"), F.max("ts").alias("latest")).orderBy(F.desc("calls"), "task")


@query("budget_first_exceeded", """WITH u AS (SELECT user_id, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost, max(value) AS largest FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN calls > 80 THEN 'calls' WHEN cost > 700 THEN 'cost' WHEN largest > 60 THEN 'size' END AS exceeded FROM u""")
def budgets(t: Tables):
    used = t("events").groupBy("user_id").agg(F.count("*").alias("calls"), money("value").alias("cost"), F.max("value").alias("largest"))
    return used.select("user_id", F.when(F.col("calls") > 80, "calls").when(F.col("cost") > 700, "cost").when(F.col("largest") > 60, "size").alias("exceeded"))


@query("quality_by_language", "SELECT lang, count(*) AS docs, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def by_language(t: Tables):
    joined = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("quality").alias("labelled"))
