"""Best matches, searches with several branches, pivots and paths over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import repair, text
from quarry.operators import matching, retrieval, setjoin
from quarry.plans.catalog import Tables
from quarry.queries import query

# ---- matches

def _key(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


@query("match_best_catalog_entry", f"""WITH l AS (SELECT DISTINCT {_key("p_brand || ' ' || p_name || ' ' || p_type")} AS key FROM part),
  n AS (SELECT {_key("p_name || ' fine'")} AS name, min(p_partkey) AS entry FROM part GROUP BY 1), r AS (SELECT {_key("p_brand")} AS name, min(p_partkey) AS entry FROM part WHERE p_brand LIKE '%3' GROUP BY 1),
  s AS (SELECT key, entry, len(list_intersect(string_split(key, ' '), string_split(name, ' '))) / CAST(len(list_distinct(string_split(name, ' '))) AS DOUBLE) AS score FROM l JOIN n ON true
        UNION ALL SELECT key, entry, 1.0::DOUBLE FROM l JOIN r ON contains(key, r.name)),
  b AS (SELECT key, entry, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, entry) AS place FROM s WHERE score >= 0.5)
  SELECT p_partkey AS line, entry, score FROM part JOIN b ON key = {_key("p_brand || ' ' || p_name || ' ' || p_type")} WHERE place = 1""")
def best_entry(t: Tables):
    """Of each line the entry of which it holds most words, or whose number stands in it."""
    line = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    lines = t("part").select(F.col("p_partkey").alias("line"), text.match_tokens(line).alias("tokens"), text.match_key(line).alias("text"))
    number = F.when(F.col("p_brand").endswith("3"), text.match_key(F.col("p_brand")))
    entries = t("part").select(F.col("p_partkey").alias("entry"), text.match_tokens(F.concat("p_name", F.lit(" fine"))).alias("tokens"), number.alias("part"))
    return setjoin.best_entries(lines, entries)


@query("match_canonical_threshold", f"""WITH e AS (SELECT p_name AS name, min(p_partkey) AS entry FROM part GROUP BY 1 UNION ALL SELECT p_type || ' ' || split_part(p_name, ' ', 2) || ' no. ' || p_size % 5, min(p_partkey) FROM part GROUP BY 1),
  l AS (SELECT DISTINCT p_name || ' X ' || p_type || ' extra' AS name FROM part), w AS (SELECT name, list_filter(list_distinct(string_split({_key("name")}, ' ')), lambda x: length(x) > 1) AS a FROM l), v AS (SELECT entry, list_filter(list_distinct(string_split({_key("name")}, ' ')), lambda x: length(x) > 1) AS b FROM e),
  s AS (SELECT name, entry, a, b, len(list_intersect(a, b)) AS n FROM w JOIN v ON true), r AS (SELECT name, entry, round(0.7::DOUBLE * (n / CAST(len(b) AS DOUBLE)) + 0.3::DOUBLE * (n / CAST(len(a) + len(b) - n AS DOUBLE)), 3) AS score FROM s),
  b AS (SELECT name, entry, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, entry) AS place FROM r WHERE score >= 0.5)
  SELECT name, entry, score, CASE WHEN score >= 0.75 THEN 'auto' WHEN score IS NULL THEN 'none' ELSE 'review' END AS verdict FROM l LEFT JOIN (SELECT * FROM b WHERE place = 1) USING (name)""")
def canonical(t: Tables):
    """Names and their other names against lines; what reaches no threshold has no entry."""
    own = t("part")
    other = F.concat("p_type", F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" no. "), (F.col("p_size") % 5).cast("string"))
    entries = own.select(F.col("p_partkey").alias("entry"), F.explode(F.array("p_name", other)).alias("name")).select("entry", text.match_tokens(F.col("name"), 2).alias("tokens"))
    names = t("part").select(F.concat("p_name", F.lit(" X "), "p_type", F.lit(" extra")).alias("line")).distinct()
    best = setjoin.best_entries(names.select("line", text.match_tokens(F.col("line"), 2).alias("tokens")), entries, setjoin.weighted_score)
    verdict = F.when(F.col("score") >= 0.75, "auto").when(F.col("score").isNull(), "none").otherwise("review")
    return names.join(best, "line", "left").select(F.col("line").alias("name"), "entry", "score", verdict.alias("verdict"))


@query("match_part_number", """WITH l AS (SELECT p_partkey, p_name, p_brand, replace(p_brand, '#', ' ') || ' ' || p_name AS line FROM part), b AS (SELECT *, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS bare, list_distinct(string_split(p_name, ' ')) AS own FROM l)
  SELECT p_partkey, CASE WHEN contains(bare, regexp_replace(lower(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END), '[^a-z0-9]', '', 'g')) THEN 1.0::DOUBLE ELSE len(list_intersect(own, ['blue', 'bolt'])) / CAST(len(own) AS DOUBLE) END AS score FROM b""")
def part_number(t: Tables):
    line = F.concat(F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" "), "p_name")
    number = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("none")
    return t("part").select("p_partkey", repair.containment(number, line, F.lit(["blue", "bolt"]), text.tokens(F.col("p_name"))).alias("score"))


@query("match_jaccard_suggest", """WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_name ILIKE '%bolt%'), k AS (SELECT p_name, list_distinct(string_split(p_name, ' ')) AS a, ['large', 'bolt'] AS b FROM n)
  SELECT p_name, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 3) AS score FROM k""")
def jaccard(t: Tables):
    own, wanted = text.tokens(F.col("p_name")), F.lit(["large", "bolt"])
    names = t("part").where(F.col("p_name").ilike("%bolt%")).select("p_name").distinct()
    return names.select("p_name", F.round(F.size(F.array_intersect(own, wanted)) / F.size(F.array_union(own, wanted)), 3).alias("score"))


@query("canonical_expansion", """WITH i AS (SELECT p_partkey FROM part WHERE (p_name ILIKE '%bolt%' OR p_type ILIKE '%bolt%') AND (p_name ILIKE '%promo%' OR p_type ILIKE '%promo%') ORDER BY p_partkey LIMIT 200)
  SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM i)""")
def expansion(t: Tables):
    items = matching.expanded(t("part"), ["bolt", "promo"], ["p_name", "p_type"], "p_partkey")
    return t("lineitem").join(F.broadcast(items), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")  # 200 keys at most


@query("catalog_price_conflict", """WITH p AS (SELECT p_name, p_brand, max(p_retailprice) AS price FROM part GROUP BY 1, 2), m AS (SELECT p_name, min(price) AS low, max(price) AS high, min_by(p_brand, (price, p_brand)) AS low_brand, max_by(p_brand, (price, p_brand)) AS high_brand FROM p GROUP BY 1)
  SELECT p_name, low, high, low_brand, high_brand FROM m WHERE (high - low) / greatest(low, 1) > 0.05 AND low_brand <> high_brand""")
def conflict(t: Tables):
    """The widest gap between sources of one article, by the ends of its prices: no pairs of sources are made."""
    own = t("part").groupBy("p_name", "p_brand").agg(F.max("p_retailprice").alias("price"))
    ends = own.groupBy("p_name").agg(F.min(F.struct("price", "p_brand")).alias("a"), F.max(F.struct("price", "p_brand")).alias("b"))
    wide = (F.col("b.price") - F.col("a.price")) / F.greatest(F.col("a.price"), F.lit(1.0)) > 0.05
    return ends.where(wide & (F.col("a.p_brand") != F.col("b.p_brand"))).select("p_name", F.col("a.price").alias("low"), F.col("b.price").alias("high"), F.col("a.p_brand").alias("low_brand"), F.col("b.p_brand").alias("high_brand"))


@query("join_where_used", "SELECT DISTINCT p_partkey, l_orderkey FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_name ILIKE '%bolt%' ORDER BY l_orderkey, p_partkey LIMIT 500")
def where_used(t: Tables):
    lines = t("lineitem").join(t("part").where(F.col("p_name").ilike("%bolt%")), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select("p_partkey", "l_orderkey").distinct().orderBy("l_orderkey", "p_partkey").limit(500)


@query("join_three_way", "SELECT o_orderkey, c_name, n_name, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 1, 2, 3")
def three_way(t: Tables):
    orders = t("orders").where("o_orderstatus = 'P'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "c_name", "n_name").agg(F.count("*").alias("lines"))


@query("join_positional", "WITH r AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS place FROM part) SELECT place, p_partkey, p_name FROM r JOIN part USING (p_partkey)")
def positional(t: Tables):
    """Rows of a table in the places that a ranking gives their keys."""
    places = retrieval.ranked(t("part").select("p_partkey", "p_retailprice"), [-F.col("p_retailprice"), F.col("p_partkey")], "place")
    return places.select("p_partkey", "place").join(t("part"), "p_partkey").select("place", "p_partkey", "p_name")


@query("join_polymorphic_key", "SELECT event_id, o_orderkey, o_totalprice FROM events JOIN orders ON event_id = o_orderkey WHERE event_type = 'purchase'")
def polymorphic(t: Tables):
    return t("events").where("event_type = 'purchase'").join(t("orders"), F.col("event_id") == F.col("o_orderkey")).select("event_id", "o_orderkey", "o_totalprice")


# ---- order and pages


@query("order_virtual", "SELECT CAST(row_number() OVER (ORDER BY k IS NULL DESC, k DESC, p_partkey) AS BIGINT) AS place, p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_size END AS k FROM part)")
def virtual_order(t: Tables):
    """Descending with what has no value first, as both the value and its absence are turned round."""
    rows = t("part").select("p_partkey", F.when(F.col("p_size") % 7 > 0, F.col("p_size")).alias("k"))
    return retrieval.ranked(rows, [F.col("k").isNotNull(), -F.col("k"), F.col("p_partkey")], "place").select("place", "p_partkey")


@query("order_cursor_page", "SELECT o_orderkey, 'paged' AS coverage, '150' AS next_cursor FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def cursor_page(t: Tables):
    """A page behind a cursor (an offset as text; what is none counts as 0), with the cursor of the next page, if there is one."""
    cursor, size = "100", 50
    begin = int(cursor) if cursor.isdigit() else 0
    rows = t("orders").orderBy("o_totalprice", "o_orderkey").offset(begin).limit(size + 1)
    more = rows.agg((F.count("*") > size).alias("more"))
    page = rows.orderBy("o_totalprice", "o_orderkey").limit(size).join(F.broadcast(more))  # one row
    return page.select("o_orderkey", F.when(F.col("more"), "paged").otherwise("complete").alias("coverage"), F.when(F.col("more"), str(begin + size)).alias("next_cursor"))


# ---- pivots of the three dimensions beside supplier, month and status columns

_pivot = """count(*) AS item_count, count(DISTINCT o_orderkey) AS invoice_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_amount,
  min(l_extendedprice) AS min_amount, max(l_extendedprice) AS max_amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS currencies,
  string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, count(DISTINCT l_suppkey) AS supplier_count"""
_lines = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


def pivot(t: Tables, dimension):
    """dimension: of a line and its part. Lines are summed for each value and order first, so that orders are counted as rows, and the
    few columns of orders are met after that; suppliers are counted from distinct pairs."""
    lines = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).withColumn("dimension", dimension)
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    by_order = lines.groupBy("dimension", "l_orderkey").agg(
        F.count("*").alias("n"), exact("l_extendedprice").alias("amount"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"), exact("l_quantity").alias("pieces"),
        F.array_sort(F.collect_set("l_returnflag")).alias("flags"),
    )
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    total, n = F.sum("amount").cast("double"), F.sum("n")
    found = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("dimension").agg(
        n.alias("item_count"), F.count("*").alias("invoice_count"), total.alias("total_amount"), (total / n).alias("avg_amount"), F.min("least").alias("min_amount"), F.max("most").alias("max_amount"),
        F.sum("pieces").cast("double").alias("quantity"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))), ", ").alias("currencies"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ", ").alias("statuses"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
    )
    suppliers = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("dimension", "l_suppkey").distinct()
    suppliers = suppliers.groupBy(F.col("dimension").alias("of")).agg(F.count("l_suppkey").alias("supplier_count"))
    return found.join(suppliers, F.col("dimension").eqNullSafe(F.col("of"))).drop("of")


@query("pivot_item", f"SELECT p_name AS dimension, {_pivot} FROM {_lines} GROUP BY 1")
def pivot_item(t: Tables):
    return pivot(t, F.col("p_name")).orderBy(F.desc("item_count"), "dimension")


@query("pivot_currency", f"SELECT coalesce(l_returnflag, '—') AS dimension, {_pivot} FROM {_lines} GROUP BY 1")
def pivot_currency(t: Tables):
    return pivot(t, F.coalesce("l_returnflag", F.lit("—"))).orderBy(F.lower("dimension"))


@query("pivot_invoice", f"SELECT CAST(o_orderkey AS VARCHAR) AS dimension, {_pivot} FROM {_lines} GROUP BY 1")
def pivot_invoice(t: Tables):
    return pivot(t, F.col("l_orderkey").cast("string"))


# ---- searches

_terms = ("the", "and", "tion")
_tf = ", ".join(f"len(list_filter(w, lambda x: x = '{x}')) AS tf{i}" for i, x in enumerate(_terms))
_bm25 = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / mean))" for i in range(3))


@query("document_search", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents), s AS (SELECT doc_id, len(w) AS length, {_tf} FROM w),
  t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))} FROM s),
  r AS (SELECT doc_id, round({_bm25}, 6) AS score FROM s, t WHERE tf0 + tf1 + tf2 > 0) SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 50""")
def document_search(t: Tables):
    return matching.document_search(t("documents"), "doc_id", "text", list(_terms))


@query("grid_keyword_search", """SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_name ILIKE '%urgent%' OR c_mktsegment ILIKE '%urgent%')
  OR o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%bolt%')""")
def grid_search(t: Tables):
    """An order, its customer or any of its lines; each branch is a slim set of keys."""
    own = t("orders").where(F.col("o_orderpriority").ilike("%urgent%")).select("o_orderkey")
    names = t("customer").where(F.col("c_name").ilike("%urgent%") | F.col("c_mktsegment").ilike("%urgent%"))
    by_name = t("orders").join(names, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    lines = t("lineitem").join(t("part").where(F.col("p_name").ilike("%bolt%")), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return own.union(by_name).union(lines.select("l_orderkey")).distinct()


@query("graph_node_search", """WITH n AS (SELECT p_partkey, greatest(CASE WHEN p_name ILIKE '%bolt%' THEN 0.6 ELSE 0 END, len(list_intersect(string_split(p_name, ' '), ['blue', 'bolt'])) / 2.0::DOUBLE, CASE WHEN p_brand ILIKE '%#7%' THEN 0.3 ELSE 0 END) AS score FROM part)
  SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM n WHERE score > 0""")
def node_search(t: Tables):
    overlap = F.size(F.array_intersect(F.split("p_name", " "), F.lit(["blue", "bolt"]))) / 2.0
    score = F.greatest(F.when(F.col("p_name").ilike("%bolt%"), 0.6).otherwise(0.0), overlap, F.when(F.col("p_brand").ilike("%#7%"), 0.3).otherwise(0.0))
    return t("part").select("p_partkey", score.alias("score")).where("score > 0")


@query("search_within_budget", """WITH a AS (SELECT 0 AS b, 'exact' AS branch, p_partkey, p_retailprice AS o FROM part WHERE p_name = 'blue bolt'), c AS (SELECT 1 AS b, 'prefix' AS branch, p_partkey, p_retailprice AS o FROM part WHERE p_name LIKE 'blue%' AND p_name <> 'blue bolt'),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT 2, 'word', p_partkey, p_retailprice FROM part WHERE p_name LIKE '%bolt' AND p_name NOT LIKE 'blue%') SELECT branch, p_partkey FROM u ORDER BY b, o, p_partkey LIMIT 120""")
def budget(t: Tables):
    part, name = t("part"), F.col("p_name")
    branches = [("exact", part.where(name == "blue bolt")), ("prefix", part.where(name.startswith("blue") & (name != "blue bolt"))), ("word", part.where(name.endswith("bolt") & ~name.startswith("blue")))]
    return matching.within_budget(branches, "p_partkey", [F.col("p_retailprice"), F.col("p_partkey")], 120)


_hits = "SELECT p_partkey, 'text' AS branch, p_size / 50.0::DOUBLE AS score, p_size AS text_part, CAST(NULL AS DOUBLE) AS price_part FROM part WHERE p_name ILIKE '%bolt%' UNION ALL SELECT p_partkey, 'price', 0.5::DOUBLE, NULL, p_retailprice FROM part WHERE p_type = 'PROMO'"


def hits(t: Tables):
    by_text = t("part").where(F.col("p_name").ilike("%bolt%")).select("p_partkey", F.lit("text").alias("branch"), (F.col("p_size") / 50.0).alias("score"), F.col("p_size").alias("text_part"), F.lit(None).cast("double").alias("price_part"))
    by_price = t("part").where("p_type = 'PROMO'").select("p_partkey", F.lit("price"), F.lit(0.5), F.lit(None).cast("int"), "p_retailprice")
    return by_text.unionAll(by_price)


@query("hits_merged", f"SELECT p_partkey, max(score) AS score, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches, max(text_part) AS text_part, max(price_part) AS price_part FROM ({_hits}) GROUP BY 1")
def merged(t: Tables):
    return matching.merged_hits(hits(t), ["p_partkey"], ["text_part", "price_part"]).withColumn("branches", F.array_join("branches", ","))


@query("evidence_pack", f"WITH r AS (SELECT p_partkey, branch, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, branch) AS place FROM ({_hits})) SELECT p_partkey, branch, score FROM r WHERE place = 1 ORDER BY score DESC, p_partkey LIMIT 40")
def evidence(t: Tables):
    """Each item once, by its best hit, in the order of scores."""
    best = hits(t).groupBy("p_partkey").agg(F.min(F.struct((-F.col("score")).alias("s"), "branch")).alias("b"))
    return best.select("p_partkey", "b.branch", (-F.col("b.s")).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)


@query("exact_branch", "SELECT p_partkey FROM part WHERE p_brand ILIKE '%#12%' OR replace(p_brand, ' ', '') LIKE 'Brand#1%' ORDER BY p_partkey LIMIT 50")
def exact(t: Tables):
    asked = "Brand #1"
    rows = t("part").where(F.col("p_brand").ilike("%#12%") | F.replace("p_brand", F.lit(" "), F.lit("")).startswith(asked.replace(" ", "")))
    return rows.select("p_partkey").orderBy("p_partkey").limit(50)


_similarity = "list_inner_product(e.embedding, q.v) / (sqrt(list_inner_product(e.embedding, e.embedding)) * sqrt(list_inner_product(q.v, q.v)))"


@query("similar_entities", f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(CAST({_similarity} AS DOUBLE), 3) AS score FROM embeddings e, q WHERE vec_id <> 7 AND {_similarity} >= 0.1")
def similar(t: Tables):
    """What is like one entity, which is left out itself."""
    one = [float(x) for x in t("embeddings").where("vec_id = 7").first().embedding]
    score = retrieval.cosine(F.col("embedding"), F.lit(one))
    return t("embeddings").where((F.col("vec_id") != 7) & (score >= 0.1)).select("vec_id", F.round(score, 3).alias("score"))


# ---- graphs

_edges = "SELECT DISTINCT p_size AS source, p_partkey % 50 + 1 AS target FROM part WHERE p_size <> p_partkey % 50 + 1"


@query("graph_impact_paths", f"""WITH RECURSIVE e AS ({_edges}), r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, [CAST(1 AS BIGINT)] AS path UNION ALL SELECT e.target, r.depth + 1, list_append(r.path, e.target) FROM r JOIN e ON r.node = e.source WHERE r.depth < 3)
  SELECT node, depth, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS place FROM r) WHERE place = 1""")
def impact(t: Tables):
    edges = t("part").select(F.col("p_size").cast("long").alias("source"), (F.col("p_partkey") % 50 + 1).alias("target")).where("source <> target").distinct()
    starts = edges.sparkSession.range(1, 2).select(F.col("id").alias("node"))
    found = matching.reached(edges, starts, 3)
    return found.select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
