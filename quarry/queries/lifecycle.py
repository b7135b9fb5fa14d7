"""Visibility, leases, transitions, expiry, retirement, promotion and repair over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import repair
from quarry.operators import lifecycle
from quarry.plans.catalog import Tables
from quarry.queries import query
from quarry.sources import revisions
from quarry.sources.shared import shared_path


@query("scope_visibility", """SELECT event_id, ['global', 'owner', 'department', 'session'][CAST(event_id % 4 + 1 AS INT)] AS scope FROM events
  WHERE event_id % 4 = 0 OR (event_id % 4 = 1 AND user_id = 7) OR (event_id % 4 = 2 AND event_type IN ('view', 'error')) OR (event_id % 4 = 3 AND json_extract_string(props, '$.k') = '42')""")
def scope(t: Tables):
    of = F.element_at(F.lit(["global", "owner", "department", "session"]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = t("events").withColumn("scope", of).withColumn("session", F.get_json_object("props", "$.k"))
    me = {"owner": 7, "departments": ("view", "error"), "session": "42"}
    return rows.where(lifecycle.in_scope(F.col("scope"), F.col("user_id"), F.col("event_type"), F.col("session"), me)).select("event_id", "scope")


@query("filter_audit", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND user_id IN (1, 2, 3, 5, 8, 13)")
def audit(t: Tables):
    return t("events").where(lifecycle.chosen({"event_type": ["error", "signup"], "user_id": [1, 2, 3, 5, 8, 13], "props": []})).select("event_id")


@query("filter_tolerant_enum", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def tolerant(t: Tables):
    known = {"F", "O", "P"}
    rows = t("orders").where(lifecycle.known_or_all("o_orderstatus", "P", known)).where(lifecycle.known_or_all("o_orderstatus", "no such", known))
    return rows.select("o_orderkey")


@query("filter_catalog", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 910 AND 1500 AND p_size BETWEEN 3 AND 30 AND p_type = 'PROMO' AND lower(p_name) LIKE '%bolt%'")
def catalog(t: Tables):
    rows = t("part").where(F.col("p_retailprice").between(910, 1500) & F.col("p_size").between(3, 30) & (F.col("p_type") == "PROMO"))
    return rows.where(F.contains(F.lower("p_name"), F.lit("bolt"))).select("p_partkey")


_facts = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 3 DAY END AS expires_at FROM events"


def facts(t: Tables):
    expires = F.when(F.col("event_id") % 5 > 0, F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    return t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, "inactive").otherwise("active").alias("status"), expires.alias("expires_at"))


@query("filter_active", f"SELECT event_id FROM ({_facts}) WHERE status = 'active' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-10')")
def active(t: Tables):
    return facts(t).where(lifecycle.active(F.lit("2024-01-10").cast("timestamp"))).select("event_id")


@query("memory_expiry", f"SELECT event_id, CASE WHEN status = 'active' AND expires_at <= TIMESTAMP '2024-01-10' THEN 'expired' ELSE status END AS status FROM ({_facts})")
def expiry(t: Tables):
    now = F.lit("2024-01-10").cast("timestamp")
    gone = (F.col("status") == "active") & ~lifecycle.active(now)
    return facts(t).select("event_id", F.when(gone, "expired").otherwise(F.col("status")).alias("status"))


@query("filter_without_orphans", """WITH e AS (SELECT event_id, ['order', 'part', 'other'][CAST(event_id % 3 + 1 AS INT)] AS kind, event_id * 7 % 40000 AS entity FROM events)
  SELECT event_id, kind FROM e WHERE kind = 'other' OR (kind = 'order' AND entity IN (SELECT o_orderkey FROM orders)) OR (kind = 'part' AND entity IN (SELECT p_partkey FROM part))""")
def orphans(t: Tables):
    kind = F.element_at(F.lit(["order", "part", "other"]), (F.col("event_id") % 3 + 1).cast("int"))
    rows = t("events").select("event_id", kind.alias("kind"), (F.col("event_id") * 7 % 40000).alias("entity"))
    return lifecycle.with_existing(rows, "kind", "entity", {"order": (t("orders"), "o_orderkey"), "part": (t("part"), "p_partkey")}).select("event_id", "kind")


@query("state_transitions", """WITH s AS (SELECT event_id, user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT event_id, state, before, before IS NULL OR (before, state) IN (('signup', 'view'), ('view', 'click'), ('view', 'view'), ('click', 'purchase'), ('click', 'view'), ('purchase', 'view')) AS allowed FROM s""")
def moves(t: Tables):
    allowed = {"signup": ["view"], "view": ["click", "view"], "click": ["purchase", "view"], "purchase": ["view"]}
    rows = t("events").select("event_id", "user_id", "ts", F.col("event_type").alias("state"))
    return lifecycle.transitions(rows, "user_id", "state", ["ts", "event_id"], allowed).select("event_id", "state", "before", "allowed")


_jobs = "SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' ELSE 'done' END AS status, o_orderdate + INTERVAL 30 DAY AS lease_until, o_custkey % 4 AS attempts FROM orders"


def jobs(t: Tables):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    return t("orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("lease_until"), (F.col("o_custkey") % 4).alias("attempts"))


@query("lease_expiry", f"SELECT job, CASE WHEN status = 'running' AND lease_until < TIMESTAMP '2000-01-01' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS next_status FROM ({_jobs})")
def leases(t: Tables):
    return lifecycle.expired_leases(jobs(t), F.lit("2000-01-01").cast("timestamp"), 3).select("job", "next_status")


@query("one_shot_reminders", f"SELECT job, lease_until FROM ({_jobs}) WHERE status <> 'done' AND attempts = 0 AND lease_until <= TIMESTAMP '2000-01-01' ORDER BY lease_until, job LIMIT 50")
def reminders(t: Tables):
    due = jobs(t).where("status <> 'done' AND attempts = 0").where(F.col("lease_until") <= F.lit("2000-01-01").cast("timestamp"))
    return due.orderBy("lease_until", "job").limit(50).select("job", "lease_until")


@query("saved_query_alerts", """WITH n AS (SELECT p_brand AS query, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1), l AS (SELECT p_brand AS query, count(*) AS n FROM part WHERE p_size <= 25 AND p_retailprice < 905 AND p_brand <> 'Brand#1' GROUP BY 1)
  SELECT n.query, n.n, l.n AS last_n FROM n LEFT JOIN l ON n.query = l.query WHERE n.n IS DISTINCT FROM l.n""")
def alerts(t: Tables):
    """Counts now against those stored by an earlier run over fewer rows."""
    counts = lambda df: df.groupBy(F.col("p_brand").alias("query")).agg(F.count("*").alias("n"))
    rows = t("part").where("p_size <= 25")
    return lifecycle.changed_counts(counts(rows), counts(rows.where("p_retailprice < 905 AND p_brand <> 'Brand#1'")), "query")


@query("retire_unconfirmed", "SELECT p_partkey, p_size > 5 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-01-01') AS is_active FROM part")
def retire(t: Tables):
    rows = t("part").select("p_partkey", (F.col("p_size") > 5).alias("is_active"))
    return lifecycle.retired(rows, t("lineitem").where("l_shipdate >= TIMESTAMP '2001-01-01'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("purge_dry_run", """SELECT event_type AS kind, count(*) AS n FROM events WHERE NOT (event_id % 3 = 0) AND ts < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AND NOT (user_id % 7 = 0) AND event_type NOT IN ('signup') GROUP BY 1""")
def purge(t: Tables):
    rows = t("events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("is_active"), F.col("ts").alias("updated_at"), (F.col("user_id") % 7 == 0).alias("pinned"))
    return lifecycle.to_purge(rows, F.lit("2024-02-01").cast("timestamp"), 10, ["signup"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("promotion_checks", """WITH f AS (SELECT conv_id, turn, lower(substr(text, 1, 12)) AS title, text, conv_id % 10 / 10.0::DOUBLE AS confidence, CASE WHEN turn % 3 > 0 THEN turn END AS source_id FROM conversations WHERE role = 'user'),
  k AS (SELECT DISTINCT lower(substr(text, 1, 12)) AS title FROM conversations WHERE role <> 'user')
  SELECT conv_id, turn, source_id IS NOT NULL AS has_source, length(text) BETWEEN 20 AND 4000 AS length_fits, confidence >= 0.5 AS is_sure, k.title IS NULL AS is_new,
    source_id IS NOT NULL AND length(text) BETWEEN 20 AND 4000 AND confidence >= 0.5 AND k.title IS NULL AS promoted FROM f LEFT JOIN k ON f.title = k.title""")
def promotion(t: Tables):
    rows = t("conversations").withColumn("title", F.substring("text", 1, 12))
    new = rows.where("role = 'user'").withColumn("confidence", F.col("conv_id") % 10 / 10.0).withColumn("source_id", F.when(F.col("turn") % 3 > 0, F.col("turn")))
    return lifecycle.promotable(new, rows.where("role <> 'user'"), "title", "text").select("conv_id", "turn", "has_source", "length_fits", "is_sure", "is_new", "promoted")


@query("rule_confirmation", """WITH w AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part), m AS (SELECT p_brand, list(word ORDER BY word)[1:20] AS words FROM w GROUP BY 1), c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
  SELECT p_brand AS rule, n AS occurrences, array_to_string(words, ',') AS words, least(1.0::DOUBLE, n / 80.0::DOUBLE) AS confidence, n >= 80 AS is_active FROM c JOIN m USING (p_brand)""")
def confirmation(t: Tables):
    rows = t("part").select(F.col("p_brand").alias("rule"), F.split("p_name", " ").alias("words"))
    return lifecycle.confirmed_rules(rows, 80).select("rule", "occurrences", F.array_join("words", ",").alias("words"), "confidence", "is_active")


@query("queue_waits", """WITH r AS (SELECT date_diff('second', o_orderdate, l_shipdate) AS wait, CAST(l_quantity AS BIGINT) * 60 AS ran FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT CAST(floor(avg(greatest(0, wait))) AS BIGINT) AS mean_wait, CAST(floor(avg(greatest(0, ran))) AS BIGINT) AS mean_runtime FROM r""")
def waits(t: Tables):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    wait = F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")
    mean = lambda c: F.floor(F.avg(F.greatest(F.lit(0), c)))
    return rows.agg(mean(wait).alias("mean_wait"), mean(F.col("l_quantity").cast("long") * 60).alias("mean_runtime"))


@query("rule_statistics", """WITH r AS (SELECT event_type, user_id, count(*) AS applied, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS gain FROM events GROUP BY 1, 2)
  SELECT * FROM (SELECT event_type, user_id, applied, gain, row_number() OVER (PARTITION BY event_type ORDER BY applied DESC, user_id) AS place FROM r) WHERE place <= 5""")
def rules(t: Tables):
    own = t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("applied"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("gain"))
    place = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("applied"), "user_id"))
    return own.withColumn("place", place).where("place <= 5")


@query("ab_evaluation", """WITH r AS (SELECT p_brand, count(*) FILTER (p_type = 'PROMO') AS c1, count(*) FILTER (p_type = 'PROMO' AND p_size > 25) AS s1, count(*) FILTER (p_type <> 'PROMO') AS c2, count(*) FILTER (p_type <> 'PROMO' AND p_size > 25) AS s2 FROM part GROUP BY 1)
  SELECT p_brand, round(s1 / CAST(greatest(1, c1) AS DOUBLE), 4) AS rate1, round(s2 / CAST(greatest(1, c2) AS DOUBLE), 4) AS rate2, CASE WHEN least(c1, c2) < 10 THEN 'wait' WHEN s2 / CAST(greatest(1, c2) AS DOUBLE) - s1 / CAST(greatest(1, c1) AS DOUBLE) >= 0.05 THEN 'win' ELSE 'keep' END AS verdict FROM r""")
def ab(t: Tables):
    promo, good = F.col("p_type") == "PROMO", F.col("p_size") > 25
    rows = t("part").groupBy("p_brand").agg(F.count_if(promo).alias("c1"), F.count_if(promo & good).alias("s1"), F.count_if(~promo).alias("c2"), F.count_if(~promo & good).alias("s2"))
    rate = lambda i: F.col(f"s{i}") / F.greatest(F.lit(1), F.col(f"c{i}"))
    verdict = F.when(F.least("c1", "c2") < 10, "wait").when(rate(2) - rate(1) >= 0.05, "win").otherwise("keep")
    return rows.select("p_brand", F.round(rate(1), 4).alias("rate1"), F.round(rate(2), 4).alias("rate2"), verdict.alias("verdict"))


@query("underperformers", "SELECT user_id, count(*) AS calls, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 4) AS fail_rate FROM events GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) >= 0.25")
def failing(t: Tables):
    own = t("events").groupBy("user_id").agg(F.count("*").alias("calls"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("rate"))
    return own.where("calls >= 10 AND rate >= 0.25").select("user_id", "calls", F.round("rate", 4).alias("fail_rate"))


@query("pending_approvals", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def approvals(t: Tables):
    rows = t("orders").where("o_orderstatus = 'P'").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return rows.join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("case_list_visibility", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def cases(t: Tables):
    """Rows of one's own, or that one is a member of; both conditions in one pass by a join that keeps all."""
    member = t("lineitem").where("l_suppkey = 7").select("l_orderkey").distinct()
    rows = t("orders").join(member, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.where((F.col("o_custkey") % 10 == 3) | F.col("l_orderkey").isNotNull()).select("o_orderkey")


@query("embedding_bookkeeping", """WITH s AS (SELECT doc_id, CASE WHEN v.vec_id IS NULL THEN 'missing' WHEN d.n_chars > 3000 THEN 'stale' ELSE 'indexed' END AS status FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id) SELECT status, count(*) AS n FROM s GROUP BY 1""")
def bookkeeping(t: Tables):
    rows = t("documents").join(t("embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    status = F.when(F.col("vec_id").isNull(), "missing").when(F.col("n_chars") > 3000, "stale").otherwise("indexed")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- repair of fields

_subtotal = "SELECT o_orderkey, o_totalprice AS total, floor(o_totalprice / 6) AS tax, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_totalprice ELSE floor(o_totalprice / 2) END AS given FROM orders"


@query("repair_subtotal", f"SELECT o_orderkey, CASE WHEN tax > 0 AND (given IS NULL OR abs(given - total) <= 0.01) THEN round(total - tax, 2) ELSE given END AS subtotal FROM ({_subtotal})")
def subtotals(t: Tables):
    third, total = F.col("o_orderkey") % 3, F.col("o_totalprice")
    given = F.when(third == 1, total).when(third == 2, F.floor(total / 2).cast("double"))
    return t("orders").select("o_orderkey", repair.subtotal(given, F.floor(total / 6).cast("double"), total).alias("subtotal"))


@query("repair_swapped_accounts", r"""WITH a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '04' || lpad(CAST(4525200 + s_suppkey AS VARCHAR), 7, '0') ELSE lpad(CAST(s_suppkey AS VARCHAR), 20, '4') END AS x, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 20, '4') ELSE '04' || lpad(CAST(4525200 + s_suppkey AS VARCHAR), 7, '0') END AS y FROM supplier),
  s AS (SELECT *, regexp_full_match(x, '04[0-9]{7}') AND substr(x, 3, 3) <> '000' AND (substr(x, 6) = '0000' OR substr(x, 6) >= '0050') AND length(y) = 20 AS swapped FROM a)
  SELECT s_suppkey, CASE WHEN swapped THEN y ELSE x END AS account, CASE WHEN swapped THEN x ELSE y END AS bik FROM s""")
def swapped(t: Tables):
    key = F.col("s_suppkey")
    bik, account = F.concat(F.lit("04"), F.lpad((key + 4525200).cast("string"), 7, "0")), F.lpad(key.cast("string"), 20, "4")
    own = repair.unswapped(F.when(key % 2 == 0, bik).otherwise(account), F.when(key % 2 == 0, account).otherwise(bik))
    return t("supplier").select("s_suppkey", own.alias("r")).select("s_suppkey", "r.account", "r.bik")


@query("repair_fields_from_text", """SELECT o_orderkey, 'A-' || o_orderkey AS number, CAST(o_orderdate AS DATE) AS date FROM orders""")
def recovered(t: Tables):
    """Numbers and dates written into a text in two ways, and read again."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    long = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(F.lit(list(repair.MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))
    text = F.concat(F.lit("Счёт № A-"), key.cast("string"), F.lit(" от "), F.when(key % 2 == 0, long).otherwise(F.date_format(day, "dd.MM.yyyy")), F.lit(" г."))
    return t("orders").select("o_orderkey", repair.found_number(text).alias("number"), repair.found_date(text).alias("date"))


@query("normalisation_rules", r"SELECT p_partkey, regexp_replace(CASE WHEN regexp_replace(p_name, '\bbolt\b', 'screw', 'g') = 'large screw' THEN 'big screw' ELSE regexp_replace(p_name, '\bbolt\b', 'screw', 'g') END, '^(\w+) (\w+)$', '\2, \1', 'g') AS name FROM part")
def rules_applied(t: Tables):
    rules = [(r"\bbolt\b", "screw", True), ("large screw", "big screw", False), (r"^(\w+) (\w+)$", "$2, $1", True)]
    return t("part").select("p_partkey", repair.by_rules(F.col("p_name"), rules).alias("name"))


@query("writeback_coercion", "SELECT o_orderkey, o_totalprice AS number, CAST(o_orderdate AS DATE) AS date FROM orders")
def coerced(t: Tables):
    """Cells as they are written by hand, in three formats of dates."""
    from quarry.functions.checks import money

    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.when(F.year("o_orderdate") >= 2000, F.date_format("o_orderdate", " dd.MM.yy")).otherwise(F.date_format("o_orderdate", " dd.MM.yyyy ")))
    return t("orders").select("o_orderkey", repair.typed(money(F.col("o_totalprice")), "number").alias("number"), repair.typed(written, "date").alias("date"))


@query("catalog_price_check", """WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity AS price, l_linenumber % 2 = 0 AS target, p_retailprice / CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END AS one, p_size % 5 = 0 AS packed,
    CASE p_size % 4 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 20 / 100.0::DOUBLE ELSE 0.1::DOUBLE END AS share, CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END AS held, CAST(l_shipdate AS DATE) AS shipped, date_diff('day', CAST(l_shipdate AS DATE), DATE '1999-01-01') AS age FROM lineitem JOIN part ON l_partkey = p_partkey),
  n AS (SELECT *, CASE WHEN target AND NOT coalesce(held, false) THEN one * (1 + share) WHEN NOT target AND coalesce(held, false) THEN one / (1 + share) ELSE one END AS exact FROM c)
  SELECT l_orderkey, l_linenumber, l_suppkey, round(exact, 4) AS catalog_price, held IS NULL AS tax_assumed, packed AS pack_normalized, CASE WHEN abs((price - exact) / exact * 100) <= 5 THEN 'ok' WHEN price > exact THEN 'above_catalog' ELSE 'below_catalog' END AS verdict,
         round((price - exact) / exact * 100, 2) + 0.0 AS difference_pct, CASE WHEN CASE WHEN l_linenumber = 3 THEN age > 0 ELSE age > 180 END THEN age END AS stale_days FROM n""")
def price_check(t: Tables):
    """Every line against its part's price, brought to the line's own basis of tax and piece."""
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    size, target, shipped = F.col("p_size"), F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("date")
    rate = F.when(size % 4 == 1, 20.0).when(size % 4 > 1, 0.1)
    held = F.when(size % 3 == 1, True).when(size % 3 == 2, False)
    known = repair.on_basis(F.col("p_retailprice"), rate, held, F.when(size % 5 == 0, 2), target)
    brought = rows.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("paid"), known.alias("known"), shipped.alias("shipped"))
    until = F.when(F.col("l_linenumber") == 3, F.col("shipped"))
    found = brought.withColumn("found", repair.price_comparison(F.col("paid"), F.col("known.exact"), F.lit("1999-01-01").cast("date"), until, F.col("shipped")))
    return found.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("known.price").alias("catalog_price"), "known.tax_assumed", "known.pack_normalized", "found.verdict", "found.difference_pct", "found.stale_days",
    )


@query("requisite_check", r"""WITH r AS (SELECT s_suppkey, repeat('7', CAST(8 + s_suppkey % 5 AS INT)) AS inn, CASE WHEN s_suppkey % 3 > 0 THEN repeat('1', CAST(8 + s_suppkey % 3 AS INT)) END AS kpp FROM supplier),
  u AS (SELECT s_suppkey, 'inn' AS field, CASE WHEN length(inn) IN (10, 12) THEN 'ok' ELSE 'error' END AS verdict FROM r UNION ALL SELECT s_suppkey, 'kpp', CASE WHEN kpp IS NULL THEN 'missing' WHEN length(kpp) = 9 THEN 'ok' ELSE 'error' END FROM r) SELECT * FROM u""")
def requisites(t: Tables):
    key = F.col("s_suppkey")
    inn, kpp = F.expr("repeat('7', cast(8 + s_suppkey % 5 as int))"), F.when(key % 3 > 0, F.expr("repeat('1', cast(8 + s_suppkey % 3 as int))"))
    each = F.array(F.struct(F.lit("inn").alias("field"), repair.requisite(inn, [10, 12]).alias("verdict")), F.struct(F.lit("kpp").alias("field"), repair.requisite(kpp, [9]).alias("verdict")))
    return t("supplier").select("s_suppkey", F.inline(each))


@query("extraction_agreement", """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag AS number, nullif(l_linestatus, 'O') AS day, CASE WHEN l_tax > 0 THEN l_tax END AS tax FROM lineitem),
  m AS (SELECT l_orderkey, max(number) AS number, max(day) AS day, max(tax) AS tax FROM x WHERE l_linenumber = 1 GROUP BY 1), o AS (SELECT * FROM x WHERE l_linenumber > 1),
  j AS (SELECT m.l_orderkey, m.number, m.day, m.tax, count(o.l_linenumber) AS others, coalesce(bool_and(coalesce(o.number = m.number, false)), false) AS a, coalesce(bool_and(coalesce(o.day = m.day, false)), false) AS b, coalesce(bool_and(coalesce(abs(o.tax - m.tax) < 0.03, false)), false) AS c FROM m LEFT JOIN o USING (l_orderkey) GROUP BY ALL),
  s AS (SELECT DISTINCT x.l_orderkey, CASE WHEN number IS NULL OR others = 0 THEN 0.0::DOUBLE ELSE ((number IS NOT NULL AND a)::INT + (day IS NOT NULL AND b)::INT + (tax IS NOT NULL AND c)::INT) / ((number IS NOT NULL)::INT + (day IS NOT NULL)::INT + (tax IS NOT NULL)::INT)::DOUBLE END AS score FROM (SELECT DISTINCT l_orderkey FROM x) x LEFT JOIN j USING (l_orderkey))
  SELECT l_orderkey, coalesce(score, 0.0) AS score, coalesce(score >= 0.5, false) AS accepted FROM s""")
def agreement(t: Tables):
    """A document's first line against all others, as extractions; open lines lack a day, lines without tax a tax."""
    rows = t("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("number"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("day"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax")
    )
    return lifecycle.agreement(rows, ["l_orderkey"], F.col("l_linenumber") == 1, ["number"], ["number", "day", "tax"], ["tax"], threshold=0.5, room=0.03)


@query("type_detection", r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'sheet' WHEN page_id % 4 = 2 THEN 'image' ELSE 'other' END AS kind FROM pages""")
def types(t: Tables):
    """By ending, else by type, else other."""
    fourth = F.col("page_id") % 4
    name = F.when(fourth == 0, "a.b.PDF").when(fourth == 1, "noending").otherwise("x.unknown")
    mime = F.when(fourth == 1, "application/vnd.ms-excel").when(fourth == 2, "IMAGE/png").otherwise("text/x")
    kinds = repair.file_kind(name, mime, {"pdf": "pdf", "xls": "sheet"}, {"application/vnd.ms-excel": "sheet", "image/png": "image"})
    return t("pages").select("page_id", kinds.alias("kind"))


@query("tool_type_inference", "SELECT p_partkey, CASE WHEN contains(p_name, 'bolt') THEN 'fastener' WHEN contains(p_name, 'ring') THEN 'seal' WHEN contains(p_name, 'widget') THEN 'tool' ELSE 'other' END AS kind FROM part")
def tool_type(t: Tables):
    return t("part").select("p_partkey", repair.first_marker(F.col("p_name"), [("bolt", "fastener"), ("ring", "seal"), ("widget", "tool")], "other").alias("kind"))


@query("context_prefix", """SELECT doc_id, concat_ws(' | ', 'source: ' || substr(source, 1, 120), 'language: ' || substr(lang, 1, 120), CASE WHEN source IS NULL AND lang IS NULL THEN 'document ' || doc_id END) AS prefix FROM documents""")
def prefix(t: Tables):
    label = lambda name, c: F.concat(F.lit(f"{name}: "), F.substring(c, 1, 120))
    fallback = F.when(F.col("source").isNull() & F.col("lang").isNull(), F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return t("documents").select("doc_id", F.concat_ws(" | ", label("source", "source"), label("language", "lang"), fallback).alias("prefix"))


@query("event_properties_merged", """SELECT user_id, max(CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS INT) END) AS view, max(CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END) AS error FROM events GROUP BY 1""")
def merged_maps(t: Tables):
    """The greatest property of each kind of event, merged into one map for each user, and looked up by key."""
    kinds = t("events").groupBy("user_id", "event_type").agg(F.max(F.get_json_object("props", "$.k").cast("int")).alias("k"))
    maps = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "k"))).alias("m"))
    return maps.select("user_id", F.try_element_at("m", F.lit("view")).alias("view"), F.try_element_at("m", F.lit("error")).alias("error"))


@query("revision_patches", """SELECT 'p' || p_partkey AS id, p_name AS value, CASE WHEN p_size > 25 THEN 'human_approved' ELSE 'proposed' END AS assurance, CASE WHEN p_size = 50 THEN 'retracted' WHEN p_size <= 25 AND p_type = 'SMALL' THEN 'superseded' ELSE 'active' END AS state, NULL AS supersedes FROM part
  UNION ALL SELECT 'n' || p_partkey, upper(p_name), 'proposed', 'active', 'p' || p_partkey FROM part WHERE p_size <= 25 AND p_type = 'SMALL'""")
def patched(t: Tables):
    """All parts as assertions: a reader's patch replaces small proposed ones, a second try of it and a stale one fail, and a person's
    retracts approved ones."""
    parts = t("part").withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    table = revisions.Revisions(t.spark, shared_path(t.spark, "revisions"))
    first = table.create(parts.select("id", F.col("p_name").alias("value"), F.when(F.col("p_size") > 25, "human_approved").otherwise("proposed").alias("assurance")))
    none = F.lit(None).cast("string")
    small = parts.where("p_size <= 25 AND p_type = 'SMALL'")
    new = small.select(F.lit("add").alias("op"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.upper("p_name").alias("value"), F.lit("proposed").alias("assurance"), F.col("id").alias("supersedes"))
    ends = lambda rows, op: rows.select(F.lit(op).alias("op"), "id", none.alias("value"), none.alias("assurance"), none.alias("supersedes"))
    change, gone = new.unionAll(ends(small, "supersede")), ends(parts.where("p_size = 50"), "retract")
    second = table.apply(change, first, "k1", "reader")
    for again, base, key in ((change, second, "k1"), (gone, first, "k2")):
        try:
            table.apply(again, base, key, "human")
        except revisions.PatchError:
            continue
        raise AssertionError("a patch that must fail was taken")
    table.apply(gone, second, "k3", "human")
    return table.read()
