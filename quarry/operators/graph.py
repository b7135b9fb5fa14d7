"""Graphs as two-column tables of edges. Each hop is a join; frontiers hold distinct nodes only. Rounds are stored, so that plans
stay small however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge (src, dst), distinct."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, hop: the least number of edges (up to depth) from any start node (column node)."""
    both = cut(undirected(edges))
    seen = start.select("node", F.lit(0).alias("hop"))
    for d in range(1, depth + 1):
        front = seen.where(F.col("hop") == d - 1).select(F.col("node").alias("src"))
        new = both.join(front, "src").select(F.col("dst").alias("node"), F.lit(d).alias("hop"))
        seen = cut(seen.unionAll(new).groupBy("node").agg(F.min("hop").alias("hop")))
    return seen


def shortest_path(edges: DataFrame, source, target, depth: int = 8) -> DataFrame:
    """One row: hop count and path (array of nodes) of the first shortest path by node order; none if it is farther than depth."""
    both = cut(undirected(edges))
    front = both.sparkSession.createDataFrame([(source, [source])], both.select(F.col("src").alias("node"), F.array("src").alias("path")).schema)
    seen, found = front.select("node"), front.where(F.col("node") == F.lit(target)).select(F.lit(0).alias("hop"), "path")
    for d in range(1, depth + 1):
        step = front.join(both, front.node == both.src).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        hit = front.where(F.col("node") == F.lit(target)).select(F.lit(d).alias("hop"), "path")
        if hit.head(1):
            return hit
        seen = seen.unionAll(front.select("node"))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: neighbours in the simple graph, where parallel edges are one and a loop counts twice."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, hop for everything reachable along directed edges within depth; cycles do no harm."""
    base = edges.select("src", "dst").distinct()
    reach = base.withColumn("hop", F.lit(1))
    for d in range(2, depth + 1):
        far = reach.where(F.col("hop") == d - 1).select(F.col("src").alias("from"), F.col("dst").alias("via"))
        new = far.join(base, F.col("via") == F.col("src")).select(F.col("from").alias("src"), "dst", F.lit(d).alias("hop"))
        reach = cut(reach.unionAll(new).groupBy("src", "dst").agg(F.min("hop").alias("hop")))
    return reach


def rare_pairs(edges: DataFrame, domains: DataFrame, most: int = 2) -> DataFrame:
    """Edges between different domains (node, domain) whose pair of domains occurs `most` times at most."""
    a, b = domains.select(F.col("node").alias("src"), F.col("domain").alias("src_domain")), domains.select(F.col("node").alias("dst"), F.col("domain").alias("dst_domain"))
    crossing = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("src_domain <> dst_domain")
    crossing = crossing.withColumn("pair", F.concat_ws("|", F.least("src_domain", "dst_domain"), F.greatest("src_domain", "dst_domain")))
    few = crossing.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return crossing.join(few, "pair")


def ready(steps: DataFrame) -> DataFrame:
    """steps: step, status, needs (array). Pending steps all of whose needs succeeded."""
    needs = steps.where("status = 'pending'").select("step", F.explode_outer("needs").alias("need"))
    done = steps.select(F.col("step").alias("need"), (F.col("status") == "succeeded").alias("ok"))
    joined = needs.join(done, "need", "left")
    return joined.groupBy("step").agg(F.bool_and(F.col("need").isNull() | F.coalesce("ok", F.lit(False))).alias("ready")).where("ready").select("step")


def layers(edges: DataFrame, depth: int) -> DataFrame:
    """node, layer of a directed acyclic graph by peeling; nodes on cycles (or deeper than depth) have no row."""
    nodes = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).distinct()
    left, out, rest = nodes, None, edges.select("src", "dst").distinct()
    for d in range(depth):
        free = cut(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        layer = free.withColumn("layer", F.lit(d))
        out = layer if out is None else out.unionAll(layer)
        left, rest = cut(left.join(free, "node", "left_anti")), cut(rest.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    return out
