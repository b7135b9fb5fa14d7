"""Components and communities of large graphs, and runs that take up only what has changed.

Communities raise modularity by moves and contraction. Each component is a graph of its own (its own total weight), so that what
happens in one does not touch the others. In a round each node adds up its weights to the communities around it and names the one
where it would gain most. Half of the nodes, chosen by a hash of node and round, may move, so that neighbours seldom change places;
of nodes that are alone, the one with the greater name joins the other. When a level comes to rest, its communities become the nodes
of the next, until none joins another. A round that loses modularity in a component is taken back there, and the component rests.

No node, community or component is gathered: sums by node, community and component are partial sums first.

Defined results: edges with a null end or a weight that isn't positive are left out, repeated edges add up, loops count to a node's
weight alone; isolated nodes (a loop, at most) are communities of their own; a community is named after its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import cut


def _beside(df: DataFrame) -> DataFrame:
    """A table of nodes or communities for a join: dealt like the other side, never sent whole through the driver."""
    return df.hint("merge")


def _simple(links: DataFrame) -> DataFrame:
    """Each link between two nodes once, the lesser node first."""
    return links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _rooted(links: DataFrame) -> DataFrame:
    """node, root of simple links: each node leads to its least neighbour. Every such path ends in two nodes that lead to each other, of
    which the lesser is the root. Paths are doubled until all have come to their roots."""
    both = links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")))
    back = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
    is_root = (F.col("further") == F.col("node")) & (F.col("node") < F.col("to"))
    paths = cut(least.join(_beside(back), "to").select("node", F.when(is_root, F.col("node")).otherwise(F.col("to")).alias("to"), is_root.alias("done")))
    while paths.where("NOT done").head(1):
        ahead = paths.select(F.col("node").alias("to"), F.col("to").alias("further"))
        stepped = paths.where("NOT done").join(_beside(ahead), "to").select("node", F.col("further").alias("to"), (F.col("to") == F.col("further")).alias("done"))
        paths = cut(paths.where("done").unionAll(stepped))
    return paths.select("node", F.col("to").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes of edges (src, dst). Each round makes one node of a root and all that lead to it, so
    that half of the nodes at most are left that still have links: rounds, and steps in a round, grow with the logarithm of the nodes,
    however long the paths are."""
    pairs = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    links, rounds = cut(_simple(pairs)), []
    while links.head(1):
        rooted = _rooted(links)
        rounds.append(rooted)
        ends = (rooted.select(F.col("node").alias(end), F.col("root").alias(f"{end} root")) for end in ("src", "dst"))
        for end in ends:
            links = links.join(_beside(end), end.columns[0])
        links = cut(_simple(links.select(F.col("src root").alias("src"), F.col("dst root").alias("dst"))))
    if not rounds:
        return nodes.select("node", F.col("node").alias("component"))
    found = rounds.pop()
    while rounds:  # from the last and smallest round back to all nodes
        further = found.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = cut(rounds.pop().join(_beside(further), "root", "left").select("node", F.coalesce("further", "root").alias("root")))
    named = found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
    return cut(nodes.join(_beside(named), "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """component, modularity of a division (node, component, community) of edges (src, dst, weight; each once, loops too)."""
    named = edges.join(found.select(F.col("node").alias("src"), "component", F.col("community").alias("a")), "src").join(found.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    total = named.groupBy("component").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    ends = named.select("component", F.explode(F.array("a", "b")).alias("community"), "weight").groupBy("component", "community").agg(F.sum("weight").alias("k"))
    squares = ends.groupBy("component").agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return total.join(squares, "component").select("component", (F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _level(edges: DataFrame, nodes: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Moves of one level. edges: src, dst, weight, both directions, no loops; nodes: node, component, k (weight), m (of the component).
    The nodes with their communities, and whether any moved."""
    state = cut(nodes.withColumn("community", F.col("node")))
    moved = False
    resting = 0
    for r in range(rounds):
        around = edges.join(_beside(state.select(F.col("node").alias("dst"), F.col("community").alias("to"))), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
        totals = state.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("total"), F.count("*").alias("size"))
        own = state.join(_beside(totals.select(F.col("to").alias("community"), F.col("total").alias("own_total"), F.col("size").alias("own_size"))), "community")
        offers = around.join(_beside(totals), "to").join(_beside(own), "node")
        is_own = F.col("to") == F.col("community")
        gain = F.col("w") - F.col("k") * (F.col("total") - F.when(is_own, F.col("k")).otherwise(0.0)) / (2 * F.col("m"))
        alone = (F.col("size") == 1) & (F.col("own_size") == 1) & (F.col("to") > F.col("node"))
        scored = offers.select("node", "to", is_own.alias("is_own"), gain.alias("gain"), alone.alias("alone"))
        best = scored.groupBy("node").agg(
            F.max(F.when(F.col("is_own"), F.col("gain"))).alias("stay"), F.max(F.when(~F.col("is_own") & ~F.col("alone"), F.struct("gain", "to"))).alias("best")
        )
        nothing = -F.col("k") * (F.col("own_total") - F.col("k")) / (2 * F.col("m"))  # no edge to one's own community
        chosen = own.join(_beside(best), "node", "left")
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        moves = turn & (F.col("best.gain") > F.coalesce("stay", nothing) + 1e-12)
        stepped = cut(chosen.select("node", "component", "k", "m", "community", F.coalesce(F.when(moves, F.col("best.to")), F.col("community")).alias("next"), F.coalesce(moves, F.lit(False)).alias("moved")))
        if not stepped.where("moved").head(1):
            resting += 1
            if resting == 2:  # neither half moves
                break
            continue
        resting = 0
        # a component that loses by this round stays as it was

        def worth(column: str) -> DataFrame:
            inside = edges.join(_beside(stepped.select(F.col("node").alias("src"), "component", F.col(column).alias("a"))), "src").join(_beside(stepped.select(F.col("node").alias("dst"), F.col(column).alias("b"))), "dst")
            inside = inside.where("a = b").groupBy("component").agg(F.sum("weight").alias("inside"))
            squares = stepped.groupBy("component", column, "m").agg(F.sum("k").alias("k")).groupBy("component", "m").agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
            return squares.join(inside, "component", "left").select("component", (F.coalesce("inside", F.lit(0.0)) - F.col("squares") / (2 * F.col("m"))).alias(f"worth {column}"))

        better = worth("community").join(worth("next"), "component").where(F.col("worth next") > F.col("worth community")).select("component", F.lit(True).alias("better"))
        kept = stepped.join(better, "component", "left")
        state = cut(kept.select("node", "component", "k", "m", F.when(F.col("better"), F.col("next")).otherwise(F.col("community")).alias("community"), (F.col("better") & F.col("moved")).alias("moved")))
        if not state.where("moved").head(1):
            resting += 1
            state = state.drop("moved")
            continue
        moved, state = True, state.drop("moved")
    return state, moved


def communities(edges: DataFrame, levels: int = 4, rounds: int = 10) -> DataFrame:
    """node, component, community of edges (src, dst, and weight where there is one), taken as undirected."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    simple = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL AND weight > 0")
    simple = cut(simple.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    found = components(simple)
    ends = simple.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("k"))
    nodes = found.join(_beside(ends), "node")
    halves = nodes.groupBy("component").agg((F.sum("k") / 2).alias("m"))
    nodes = cut(nodes.join(halves, "component").select("node", "component", "k", "m"))
    links = simple.where("src <> dst")
    links = cut(links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    names = cut(nodes.select("node", "component", F.col("node").alias("community")))
    for _ in range(levels):
        state, moved = _level(links, nodes, rounds)
        if not moved:
            break
        into = state.select("node", F.col("community").alias("joined"))
        names = cut(names.join(_beside(into.withColumnRenamed("node", "community")), "community").select("node", "component", F.col("joined").alias("community")))
        links = links.join(_beside(into.select(F.col("node").alias("src"), F.col("joined").alias("a"))), "src").join(_beside(into.select(F.col("node").alias("dst"), F.col("joined").alias("b"))), "dst")
        links = cut(links.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
        nodes = cut(state.groupBy(F.col("community").alias("node"), "component", "m").agg(F.sum("k").alias("k")).select("node", "component", "k", "m"))
    least = names.groupBy("component", "community").agg(F.min("node").alias("least"))
    return names.join(_beside(least), ["component", "community"]).select("node", "component", F.col("least").alias("community"))


def incremental(known: DataFrame, edges: DataFrame, since, changed: str = "changed_at") -> tuple[DataFrame, DataFrame]:
    """The communities after changes, and the edges that were taken up anew.

    known: node, component, community of the last run, up to `since`; edges: src, dst (weight), `changed`, and `gone` (a boolean:
    edges that were removed, which stay as rows). Components that an edge changed after `since` touches are worked out again, with all
    their edges; the others stay as they are. If nothing has changed, nothing is read but the changes."""
    new = edges.where(F.col(changed) > F.lit(since))
    ends = cut(new.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct())
    if not ends.head(1):
        return known, edges.limit(0)
    touched = cut(known.join(ends, "node", "left_semi").select("component").distinct())
    nodes = cut(known.join(touched, "component", "left_semi").select("node").unionAll(ends).distinct())
    # an edge has both its ends in one component or is new
    taken = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").where(~F.coalesce(F.col("gone"), F.lit(False)) if "gone" in edges.columns else F.lit(True))
    taken = cut(taken)
    rest = known.join(touched, "component", "left_anti").select("node", "component", "community")
    return rest.unionAll(communities(taken)), taken


def ranked_communities(found: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """community, size, place of the largest communities of `least` nodes or more, ties to the smaller name."""
    sizes = found.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    top = sizes.orderBy(F.desc("size"), "community").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "community")))
