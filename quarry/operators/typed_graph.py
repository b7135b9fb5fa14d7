"""Reach along typed edges, to any depth: what a change affects, and what is critical to a target.

Types of edges say which way an influence goes: from source to target, from target to source, or both. A search goes on, a level a
round, until a round finds nothing new, so cycles do no harm; each node keeps its shortest path (the smallest of several), and only
new nodes are joined with the edges.

Defined results: nodes that no edge names are reached only as starts; unknown types of edges are not followed; null ends are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.shared import cut

#: Types of edges by the way an influence goes.
BOTH = ("same_object_across_views", "mates_with", "connects_to")
ALONG = ("contains", "represented_by", "defines", "constrains", "applies_to", "opens_in", "maps_to_topology")
AGAINST = ("part_of", "instance_of", "located_in", "depends_on", "generated_by", "realizes")
#: Types that tie assertions to a target, followed both ways, and impacts that count from a magnitude on.
TIES = ("depends_on", "constrains", "defines", "applies_to", "part_of", "contains")
MEASURED = ("mass", "material_quantity")


def adjacency(edges: DataFrame, along: tuple[str, ...] = ALONG, against: tuple[str, ...] = AGAINST, both: tuple[str, ...] = BOTH) -> DataFrame:
    """source, target of each step that edges (source, target, type) allow, once."""
    kind = F.col("type")
    steps = F.when(kind.isin(*both), F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    steps = steps.when(kind.isin(*along), F.array(F.struct("source", "target"))).when(kind.isin(*against), F.array(F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    return edges.where("source IS NOT NULL AND target IS NOT NULL").select(F.explode(steps).alias("s")).select("s.source", "s.target").distinct()


def reached(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """node, depth, path (from a start) of all that steps (source, target) lead to from starts (node)."""
    steps = cut(steps)
    front = cut(starts.select("node", F.lit(0).alias("depth"), F.array("node").alias("path")).where("node IS NOT NULL").distinct())
    levels, seen, depth = [front], front.select("node"), 0
    while front.head(1):
        depth += 1
        further = front.join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        new = further.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        front = cut(new.select("node", F.lit(depth).alias("depth"), "path"))
        levels.append(front)
        seen = cut(seen.unionAll(front.select("node")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


@dataclass(frozen=True)
class Target:
    """What is to be built: its roots, the assertions that its requirements name, impacts that are critical to it."""

    roots: DataFrame  # node
    required: DataFrame  # assertion
    impacts: tuple[str, ...]
    tolerance_percent: float = 1.0


def critical(assertions: DataFrame, edges: DataFrame, target: Target) -> DataFrame:
    """assertion: the active ones that a requirement names, or that have a critical impact on what is tied to the target. assertions:
    assertion, subject, state, impacts (an array of name, percent: how large the impact is, null where it isn't known)."""
    tied = reached(adjacency(edges, (), (), TIES), target.roots).select(F.col("node").alias("subject"))
    active = assertions.where("state = 'active'")
    small = lambda i: i["name"].isin(*MEASURED) & F.coalesce(i["percent"] <= target.tolerance_percent, F.lit(False))
    counts = F.exists("impacts", lambda i: i["name"].isin(*target.impacts) & ~small(i))
    by_impact = active.where(counts).join(tied, "subject", "left_semi").select("assertion")
    return active.join(target.required, "assertion", "left_semi").select("assertion").unionAll(by_impact).distinct()


def impact_report(nodes: DataFrame, edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """What changes of subjects (node) affect: node, type, depth, path, direct (one step away). nodes: node, type."""
    found = reached(adjacency(edges), subjects)
    return found.join(nodes.select("node", "type"), "node", "left").select("node", "type", "depth", "path", (F.col("depth") == 1).alias("direct"))
