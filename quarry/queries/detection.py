"""Detectors and checks over the history."""

from __future__ import annotations


from pyspark.sql import functions as F

from quarry.operators import detectors, tolerance
from quarry.functions import checks
from quarry.plans.catalog import Tables
from quarry.queries import query


@query("detect_duplicates", "SELECT o_orderkey, o_custkey, o_orderdate, copies FROM orders JOIN (SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1) USING (o_custkey, o_orderdate)")
def duplicates(t: Tables):
    return detectors.duplicates(t("orders"), ["o_custkey", "o_orderdate"], "o_orderkey")


@query("detect_first_timers", "SELECT min(o_orderkey) AS o_orderkey, o_custkey || ' ' || o_orderpriority AS buyer FROM orders GROUP BY 2 HAVING count(*) = 1")
def first_timers(t: Tables):
    return detectors.first_timers(t("orders").withColumn("buyer", F.concat_ws(" ", F.col("o_custkey").cast("string"), "o_orderpriority")), "buyer", "o_orderkey")


@query("detect_price_spikes", """WITH p AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, o_orderdate, l_extendedprice / l_quantity AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  w AS (SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_suppkey, price) AS old_price FROM p)
  SELECT l_partkey, l_orderkey, l_linenumber, price, old_price, round((price - old_price) * 100 / old_price, 1) AS change FROM w WHERE round((price - old_price) * 100 / old_price, 1) > 20""")
def spikes(t: Tables):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    found = detectors.price_spikes(lines, "l_partkey", ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "price"], "price")
    return found.select("l_partkey", "l_orderkey", "l_linenumber", "price", "old_price", "change")


@query("detect_changed_fields", """WITH w AS (SELECT *, lag(o_orderpriority) OVER p AS a, lag(o_orderstatus) OVER p AS b FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
  SELECT o_orderkey, concat_ws(',', CASE WHEN a <> o_orderpriority THEN 'o_orderpriority' END, CASE WHEN b <> o_orderstatus THEN 'o_orderstatus' END) AS changed FROM w WHERE a <> o_orderpriority OR b <> o_orderstatus""")
def changed(t: Tables):
    found = detectors.changed_fields(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_orderstatus"])
    return found.select("o_orderkey", F.array_join("changed", ",").alias("changed"))


@query("detect_unknown_items", "SELECT l_orderkey, count(*) AS lines FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 40) ON l_partkey = p_partkey GROUP BY 1 HAVING count(p_partkey) = 0")
def unknown(t: Tables):
    joined = t("lineitem").join(t("part").where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count("p_partkey").alias("known")).where("known = 0").select("l_orderkey", "lines")


@query("offers_alignment", """WITH c AS (SELECT lower(trim(p_name)) AS item, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey IN (1, 2, 3) GROUP BY 1, 2)
  SELECT item, max(amount) FILTER (l_suppkey = 1) AS s1, max(amount) FILTER (l_suppkey = 2) AS s2, max(amount) FILTER (l_suppkey = 3) AS s3, round(max(amount) - min(amount), 2) AS savings FROM c GROUP BY 1""")
def offers(t: Tables):
    lines = t("lineitem").where("l_suppkey IN (1, 2, 3)").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = lines.groupBy(F.lower(F.trim("p_name")).alias("item"), "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    own = [F.max(F.when(F.col("l_suppkey") == i, F.col("amount"))).alias(f"s{i}") for i in (1, 2, 3)]
    return cells.groupBy("item").agg(*own, F.round(F.max("amount") - F.min("amount"), 2).alias("savings"))


@query("trust_scores", """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus <> 'P') AS known FROM orders GROUP BY 1)
  SELECT c_custkey, round(0.2::DOUBLE * CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.5 END + 0.3::DOUBLE * least(coalesce(n, 0) / 10.0::DOUBLE, 1.0) + 0.3::DOUBLE * coalesce(good / CASE WHEN known > 0 THEN CAST(known AS DOUBLE) END, 0.5) + 0.2::DOUBLE * 0.8::DOUBLE, 3) AS trust FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def trust(t: Tables):
    own = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count_if(F.col("o_orderstatus") != "P").alias("known"))
    joined = t("customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    complete = F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.5)
    approval = F.try_divide(F.col("good").cast("double"), F.col("known"))
    return joined.select("c_custkey", detectors.trust(complete, F.coalesce("n", F.lit(0)), approval, F.lit(None).cast("double")).alias("trust"))


@query("party_duplicates", """WITH a AS (SELECT s_suppkey, 'place' AS "by", min(s_suppkey) OVER w AS g, count(*) OVER w AS n FROM (SELECT *, s_nationkey || ':' || CAST(floor(s_acctbal / 500) AS BIGINT) AS k FROM supplier) WINDOW w AS (PARTITION BY k)),
  f AS (SELECT s_suppkey, "by", g FROM a WHERE n > 1), b AS (SELECT s_suppkey, 'nation' AS "by", min(s_suppkey) OVER w AS g, count(*) OVER w AS n FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM f) WINDOW w AS (PARTITION BY s_nationkey))
  SELECT s_suppkey, "by", g AS "group" FROM f UNION ALL SELECT s_suppkey, "by", g FROM b WHERE n > 1""")
def same_party(t: Tables):
    place = F.concat_ws(":", F.col("s_nationkey").cast("string"), F.floor(F.col("s_acctbal") / 500).cast("string"))
    return detectors.party_duplicates(t("supplier"), "s_suppkey", {"place": place, "nation": F.col("s_nationkey").cast("string")})


@query("stock_check", """WITH b AS (SELECT l_orderkey AS product, l_partkey AS item, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2), j AS (SELECT product, item, qty * 2.0 AS required, CAST(p_size AS DOUBLE) AS available FROM b LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON item = p_partkey)
  SELECT product, item, required, available, CASE WHEN available IS NOT NULL THEN greatest(0.0, required - available) END AS shortage,
  bool_and(coalesce(CASE WHEN available IS NOT NULL THEN greatest(0.0, required - available) END = 0, false)) OVER (PARTITION BY product) AS can_produce FROM j""")
def stock(t: Tables):
    bom = t("lineitem").groupBy(F.col("l_orderkey").alias("product"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("qty"))
    have = t("part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("available"))
    return detectors.stock_check(bom, have, 2.0)


_rules = "(VALUES (1, 1, 'BUILDING', 200000.0, true), (2, 2, NULL, 50000.0, true), (3, 3, 'MACHINERY', NULL, true), (4, 0, NULL, NULL, false)) r(rule_id, place, segment, most, active)"


@query("auto_approval", f"""SELECT o_orderkey, rule_id FROM (SELECT o_orderkey, rule_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) AS i FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN {_rules} ON active AND (segment IS NULL OR segment = c_mktsegment) AND (most IS NULL OR o_totalprice <= most)) WHERE i = 1""")
def approval(t: Tables):
    """A handful of rules, so they are folded into one expression: no join, no window."""
    rules = [(1, "BUILDING", 200000.0), (2, None, 50000.0), (3, "MACHINERY", None)]  # active ones in order
    match = [F.lit(True) if s is None else F.col("c_mktsegment") == s for _, s, _ in rules]
    match = [m if most is None else m & (F.col("o_totalprice") <= most) for m, (_, _, most) in zip(match, rules)]
    first = F.coalesce(*(F.when(m, r[0]) for m, r in zip(match, rules)))
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", first.alias("rule_id")).where("rule_id IS NOT NULL")


_room = "abs(a - b) <= greatest(1, abs(CASE WHEN total <> 0 THEN total ELSE lines END) * 0.01)"
_near = lambda a, b: _room.replace("a - b", f"({a}) - ({b})")
_by_rate = " OR ".join(f"({_near('lines', 'total')} AND {_near('tax', f'total * {r} / {1 + r}')}) OR ({_near('tax', f'lines * {r}')} AND {_near('total', f'lines * {1 + r}')})" for r in (0.2, 0.1))


@query("arithmetic_check", f"""WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS lines, CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax, count(*) AS n FROM lineitem GROUP BY 1),
  j AS (SELECT o_orderkey, n, lines, tax, unnest([o_totalprice, lines + tax, lines, lines * 1.2]) AS total, unnest([0, 1, 2, 3]) AS kind FROM orders JOIN s ON l_orderkey = o_orderkey)
  SELECT o_orderkey, kind, n, {_near('lines + tax', 'total')} OR {_by_rate} AS fits FROM j""")
def arithmetic(t: Tables):
    price = F.col("l_extendedprice")
    sums = t("lineitem").groupBy("l_orderkey").agg(checks.sum_of_cents(price).alias("lines"), checks.sum_of_cents(price * F.col("l_tax")).alias("tax"), F.count("*").alias("n"))
    joined = t("orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    totals = F.posexplode(F.array(F.col("o_totalprice"), F.col("lines") + F.col("tax"), F.col("lines"), F.col("lines") * 1.2)).alias("kind", "total")  # the given one, and some that ought to fit or not
    return joined.select("o_orderkey", "n", "lines", "tax", totals).select("o_orderkey", "kind", "n", checks.total_fits(F.col("lines"), F.col("tax"), F.col("total")).alias("fits"))


_check = " + ".join(f"CAST(substr(inn, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(checks.INN_10))


@query("checksum_inn", f"SELECT s_suppkey, inn, CASE WHEN regexp_full_match(inn, '[0-9]{{10}}') THEN ({_check}) % 11 % 10 = CAST(substr(inn, 10, 1) AS INT) ELSE false END AS valid FROM (SELECT s_suppkey, lpad(CAST(s_suppkey * 7919 + 7707083893 AS VARCHAR), 10, '0') AS inn FROM supplier)")
def checksum(t: Tables):
    inn = F.lpad((F.col("s_suppkey") * 7919 + F.lit(7707083893)).cast("string"), 10, "0")
    return t("supplier").select("s_suppkey", inn.alias("inn")).select("s_suppkey", "inn", checks.inn_valid(F.col("inn")).alias("valid"))


@query("stale_and_due", """SELECT event_id, event_type, CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 HOUR THEN 'stale' ELSE 'due' END AS alert FROM events e
  WHERE (event_type = 'error' AND ts < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 1 HOUR AND value > 50) OR (event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-27 23:00:00' AND TIMESTAMP '2024-01-30 23:00:00'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= TIMESTAMP '2024-01-29'))""")
def alerts(t: Tables):
    """Alerts at a fixed clock: old errors, and sign-ups of the last days whose user has bought nothing since."""
    events = t("events")
    stale = events.where("event_type = 'error' AND ts < timestamp '2024-01-30 22:00:00' AND value > 50").select("event_id", "event_type", F.lit("stale").alias("alert"))
    bought = events.where("event_type = 'purchase' AND ts >= timestamp '2024-01-29'").select("user_id").distinct()
    due = events.where("event_type = 'signup' AND ts BETWEEN timestamp '2024-01-27 23:00:00' AND timestamp '2024-01-30 23:00:00'").join(bought, "user_id", "left_anti")
    return stale.unionAll(due.select("event_id", "event_type", F.lit("due").alias("alert")))


@query("risk_flags", """SELECT conv_id, turn, concat_ws(',', CASE WHEN regexp_matches(lower(text), '(password|token|secret)') THEN 'sensitive' END, CASE WHEN regexp_matches(text, '[0-9]{3,}[ .,]?[0-9]{3}') THEN 'amount' END,
  CASE WHEN length(text) > 1000 THEN 'long' END) AS flags FROM conversations""")
def risks(t: Tables):
    text = F.col("text")
    flags = [F.when(F.lower(text).rlike("(password|token|secret)"), "sensitive"), F.when(text.rlike("[0-9]{3,}[ .,]?[0-9]{3}"), "amount"), F.when(F.length(text) > 1000, "long")]
    return t("conversations").select("conv_id", "turn", F.concat_ws(",", *flags).alias("flags"))


@query("keyword_compliance", """WITH r AS (SELECT unnest(['license', 'copyright', 'password']) AS keyword) SELECT keyword, count(*) FILTER (NOT contains(lower(text), keyword)) AS missing FROM documents, r GROUP BY 1""")
def compliance(t: Tables):
    """A fixed list of requirements, all counted in one pass over the texts."""
    words = ("license", "copyright", "password")
    counts = t("documents").agg(*(F.count_if(~F.contains(F.lower("text"), F.lit(w))).alias(w) for w in words))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(w).alias("keyword"), F.col(w).alias("missing")) for w in words))).alias("x")).select("x.*")




@query("dedup_within_tolerance", """WITH RECURSIVE f AS (SELECT p_brand AS kind, 100.0::DOUBLE + p_size AS value, p_partkey AS seq, (p_partkey * 37 % 101) / 101.0::DOUBLE AS sure, p_type AS view FROM part),
  d AS (SELECT kind, value, min(seq) AS seq FROM f GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS n FROM d),
  r(kind, n, value, head, heads) AS (SELECT kind, n, value, value, [value] FROM o WHERE n = 1 UNION ALL
    SELECT kind, n, value, coalesce(list_filter(heads, lambda h: abs(h - value) / greatest(h, value) < 0.02)[1], value), CASE WHEN len(list_filter(heads, lambda h: abs(h - value) / greatest(h, value) < 0.02)) > 0 THEN heads ELSE list_append(heads, value) END
    FROM (SELECT o.kind, o.n, o.value, r.heads FROM r JOIN o ON o.kind = r.kind AND o.n = r.n + 1)),
  g AS (SELECT f.*, head, row_number() OVER (PARTITION BY f.kind, head ORDER BY sure DESC, f.seq) AS place FROM f JOIN r ON f.kind = r.kind AND f.value = r.value),
  s AS (SELECT kind, head, count(*) AS votes, string_agg(DISTINCT view, ',' ORDER BY view) AS views FROM g GROUP BY 1, 2)
  SELECT kind, seq, value, round(CASE WHEN votes >= 2 THEN least(1.0, sure + 0.1) ELSE sure END, 3) AS confidence, views, votes FROM g JOIN s USING (kind, head) WHERE place = 1""")
def within_tolerance(t: Tables):
    """Sizes of a brand that are the same within two percent: the surest, who says so, and how many."""
    rows = t("part").select(F.col("p_brand").alias("kind"), (F.lit(100.0) + F.col("p_size")).alias("value"), F.col("p_partkey").alias("seq"), ((F.col("p_partkey") * 37 % 101) / 101.0).alias("sure"), F.col("p_type").alias("view"))
    found = tolerance.same_within(rows, "kind", "value", "seq", "sure", "view")
    return found.select("kind", "seq", "value", "confidence", F.array_join("views", ",").alias("views"), "votes")
