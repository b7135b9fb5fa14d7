"""Graph queries over edges derived from orders and lines: customer, order, supplier, nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import communities, graph, typed_graph
from quarry.plans.catalog import Tables
from quarry.queries import query


def edges(t: Tables) -> DataFrame:
    """Customers and nations, suppliers and nations, nations and regions."""
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return link(t("customer"), "c", "c_custkey", "n", "c_nationkey").unionAll(link(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionAll(link(t("nation"), "n", "n_nationkey", "r", "n_regionkey"))


_edges = "e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("graph_neighbourhood", f"WITH {_edges}, h1 AS (SELECT dst AS node FROM u WHERE src = 's1'), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node), h3 AS (SELECT DISTINCT dst AS node FROM u JOIN h2 ON src = node), a AS (SELECT 's1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) SELECT node, min(hop) AS hop FROM a GROUP BY 1")
def neighbourhood(t: Tables):
    e = edges(t)
    return graph.hops(e, e.select(F.lit("s1").alias("node")).limit(1), 3)


@query("graph_degrees", f"WITH {_edges}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), d AS (SELECT a AS node FROM p UNION ALL SELECT b FROM p) SELECT node, count(*) AS degree FROM d GROUP BY 1 HAVING count(*) >= 2")
def degrees(t: Tables):
    return graph.degrees(edges(t)).where("degree >= 2")


@query("graph_rare_pairs", f"""WITH {_edges}, x AS (SELECT DISTINCT src, dst, substr(src, 1, 1) || '|' || dst AS pair FROM e WHERE substr(src, 1, 1) = 's') SELECT src, dst, pair FROM x JOIN (SELECT pair FROM x GROUP BY 1 HAVING count(*) <= 2) USING (pair)""")
def rare(t: Tables):
    e = edges(t).where("src LIKE 's%'")
    domains = e.select(F.col("src").alias("node"), F.lit("s").alias("domain")).unionAll(e.select(F.col("dst"), F.col("dst"))).distinct()
    found = graph.rare_pairs(e, domains)
    return found.select("src", "dst", F.concat_ws("|", "src_domain", "dst_domain").alias("pair"))


@query("graph_closure", f"WITH {_edges} SELECT src, dst, min(hop) AS hop FROM (SELECT src, dst, 1 AS hop FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src) GROUP BY 1, 2")
def closure(t: Tables):
    return graph.closure(edges(t), 3)


@query("graph_shortest_path", f"""WITH {_edges}, p AS (SELECT u1.dst AS a, u2.dst AS b, u3.dst AS c FROM u u1 JOIN u u2 ON u2.src = u1.dst JOIN u u3 ON u3.src = u2.dst WHERE u1.src = 's1')
  SELECT 3 AS hop, 's1/' || a || '/' || b || '/' || c AS path FROM p WHERE c = (SELECT min('n' || n_nationkey) FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 1) AND n_nationkey <> (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)) AND b LIKE 'r%'""")
def path(t: Tables):
    """From a supplier to the first other nation of its region."""
    home = t("supplier").where("s_suppkey = 1").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()
    target = t("nation").where((F.col("n_regionkey") == home.n_regionkey) & (F.col("n_nationkey") != home.s_nationkey)).agg(F.min(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))).first()[0]
    return graph.shortest_path(edges(t), "s1", target).select("hop", F.array_join("path", "/").alias("path"))


@query("graph_ready_steps", """WITH s AS (SELECT o_orderkey AS step, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, o_orderkey - 1 AS need FROM orders)
  SELECT a.step FROM s a LEFT JOIN s b ON a.need = b.step WHERE a.status = 'pending' AND b.status = 'succeeded'""")
def ready(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return graph.ready(t("orders").select(F.col("o_orderkey").alias("step"), status.alias("status"), F.array(F.col("o_orderkey") - 1).alias("needs")))


@query("graph_layers", f"WITH {_edges} SELECT DISTINCT node, CASE substr(node, 1, 1) WHEN 'r' THEN 2 WHEN 'n' THEN CASE WHEN EXISTS (SELECT 1 FROM e WHERE dst = node) THEN 1 ELSE 0 END ELSE 0 END AS layer FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")
def layers(t: Tables):
    return graph.layers(edges(t), 4)


@query("graph_entity_edges", f"WITH {_edges} SELECT src, dst, CASE WHEN src = 'n3' THEN 'out' ELSE 'in' END AS side FROM e WHERE src = 'n3' OR dst = 'n3'")
def entity_edges(t: Tables):
    return edges(t).where("src = 'n3' OR dst = 'n3'").select("src", "dst", F.when(F.col("src") == "n3", "out").otherwise("in").alias("side"))


@query("graph_conflicts", """WITH v AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_orderkey, a.l_suppkey AS first, b.l_suppkey AS second FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey""")
def conflicts(t: Tables):
    """Different values of one document, each with the next one: within a document's own short sorted list."""
    values = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("v")).where(F.size("v") > 1)
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return values.select("l_orderkey", F.explode(pairs).alias("p")).select("l_orderkey", "p.first", "p.second")


_typed = "t AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'depends_on' AS type FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'mates_with' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation), a AS (SELECT source, target FROM t WHERE type = 'mates_with' UNION SELECT target, source FROM t)"


@query("graph_typed_impact", f"""WITH RECURSIVE {_typed}, w(node, depth, path) AS (SELECT 'r1', 0, ['r1'] UNION ALL SELECT a.target, depth + 1, list_append(path, a.target) FROM w JOIN a ON a.source = w.node WHERE NOT list_contains(path, a.target)),
  b AS (SELECT node, depth, path, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS place FROM w)
  SELECT node, CASE substr(node, 1, 1) WHEN 'c' THEN 'Artifact' WHEN 's' THEN 'View' WHEN 'n' THEN 'Component' ELSE 'System' END AS type, CAST(depth AS INT) AS depth, array_to_string(path, '>') AS path, depth = 1 AS direct FROM b WHERE place = 1""")
def typed_impact(t: Tables):
    """What a change of a region affects, to any depth, with the way there; cycles of mates included."""
    e = edges(t)
    kind = F.when(F.col("src").startswith("c"), "depends_on").when(F.col("src").startswith("s"), "mates_with").otherwise("part_of")
    typed = e.select(F.col("src").alias("source"), F.col("dst").alias("target"), kind.alias("type"))
    nodes = e.select("src").unionAll(e.select("dst")).distinct().withColumnRenamed("src", "node")
    what = F.when(F.col("node").startswith("c"), "Artifact").when(F.col("node").startswith("s"), "View").when(F.col("node").startswith("n"), "Component").otherwise("System")
    found = typed_graph.impact_report(nodes.withColumn("type", what), typed, nodes.where("node = 'r1'"))
    return found.select("node", "type", "depth", F.array_join("path", ">").alias("path"), "direct")


@query("graph_components", "WITH e AS (SELECT p_partkey AS src, p_partkey + p_size * 97 AS dst FROM part), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT count(*) AS nodes, count(DISTINCT node) AS names FROM (SELECT src AS node FROM u UNION SELECT dst FROM u)")
def component_nodes(t: Tables):
    """Every node of the edges between parts has one component."""
    e = t("part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") * 97).alias("dst"))
    return communities.components(e).agg(F.count("*").alias("nodes"), F.count_distinct("node").alias("names"))


@query("graph_communities")
def community_sizes(t: Tables):
    """Communities of all customers, suppliers and places by modularity, with their sizes."""
    found = communities.communities(edges(t))
    return found.groupBy("component", "community").agg(F.count("*").alias("size"))
