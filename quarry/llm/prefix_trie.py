"""The prefix trie of conversations, summed up by centroid decomposition.

A conversation is a sequence of turns; each distinct beginning of a sequence is a node of the trie. A beginning is known by its depth
and by four sums over its turns of 32 bits each of the SHA-256 of (place, turn): running sums by ranges of the order, so that one
conversation, however long, is spread over tasks. A node's name is its smallest member and its depth, which no other node shares.

Sums over subtrees (`subtree_sums`) come by centroid decomposition of the forest of parent edges. Each node weighs as much as it has
members, so the weight below a node is known from the start: the turns that its members have from there on. In each round every
component is split at its centroid, the deepest node with more than half of the component's weight below it; the nodes with more
than half are just the path from the centroid to the component's top. Each child of the centroid becomes the top of a component of
its own, what isn't below the centroid stays one. The components' totals are aggregated, and what lay below the centroid, with the
centroid, is added to every node of the path. Weights halve from round to round, so there are log2 of the weight rounds at most,
whatever the depth of the trie, and a path never has to be walked: which component a node falls to is looked up by its smallest
member's node just below the centroid's depth.

The ends of a node (its members that have no further turn) are hashed in the order of their ids: they are joined to pieces of at
most TOGETHER ids by ranges of the order, and a node's pieces run through SHA-256 one after the other, never gathered.

Defined results: null role or text is empty; turns with the same number follow in the order of role and of the text's digest; rows
whose conv_id is null belong to no conversation and take no part; repeated rows are turns of their own; an empty table gives just no
row; other columns are ignored, whatever their names are. `conv_id % 100` has the sign of conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import drop_tables, prefix_sums, saved, scope, whole

#: Ids of one piece of a node's ends.
TOGETHER = 1000
LANES = ("lane0", "lane1", "lane2", "lane3")
NODE = "conv long, depth long"


def turns(conversations: DataFrame) -> DataFrame:
    """Columns conv, place (from 0), digest (of role and text), chars (of the text), in the order of turns."""
    role, text = whole("role"), whole("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    order = [F.col("conv"), F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("digest")]
    placed = saved(prefix_sums(given, order, {"before": F.lit(1)}).select("conv", "digest", "chars", F.col("before").cast("long").alias("before")), "turns")
    starts = placed.groupBy("conv").agg(F.min("before").alias("start"))
    return placed.join(starts, "conv").select("conv", (F.col("before") - F.col("start")).alias("place"), "digest", "chars")


def rebuilt(found: DataFrame, convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Columns conv, depth (from 1), digest, chars. Every conversation of convs begins with the first h turns of the one that its
    block of ids begins with, and goes on with its own turns after its first h; h: crc32 of its id modulo `most`."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    wants = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    heads = found.where(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    taken = wants.join(heads, "base").where("place < h").select("conv", (F.col("place") + 1).alias("depth"), "digest", "chars")
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    ahead = wants.join(sizes, "base", "left").select("conv", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("ahead"))
    own = found.join(ahead, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("ahead") + 1).alias("depth"), "digest", "chars")
    return taken.unionAll(own)


def members(found: DataFrame) -> DataFrame:
    """Columns conv, depth, chars, node (the smallest member of the conversation's node at that depth), n_convs, below (the turns that
    the node's members have from there on) of every turn of the sequences in `found` (conv, depth, digest, chars)."""
    hashed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    part = lambda i: F.conv(F.substr(hashed, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long")
    rows = found.select("conv", "depth", "chars", *(part(i).alias(f"{n} own") for i, n in enumerate(LANES)))
    summed = saved(prefix_sums(rows, [F.col("conv"), F.col("depth")], {n: F.col(f"{n} own") for n in LANES}).select(
        "conv", "depth", "chars", *((F.col(n) + F.col(f"{n} own")).alias(n) for n in LANES)
    ), "sums")
    # sums at the beginning of a conversation go, and its length comes
    first = F.col("depth") == 1
    own = {n: F.max(F.when(first, F.col(n))) for n in LANES}
    starts = summed.groupBy("conv").agg(F.max("depth").alias("size"), *(c.alias(f"{n} start") for n, c in own.items()))
    # what the first turn adds is taken off with what came before it: depth 1 is then told apart by its own digest alone
    named = saved(summed.join(starts, "conv").join(rows.where(first).select("conv", *(F.col(f"{n} own").alias(f"{n} first") for n in LANES)), "conv").select(
        "conv", "depth", "chars", "size", *((F.col(n) - F.col(f"{n} start") + F.col(f"{n} first")).alias(n) for n in LANES)
    ), "prefixes")
    key = ["depth", *LANES]
    below = F.sum(F.col("size") - F.col("depth") + 1).alias("below")
    # a table of its own, so that adaptive execution can split the rows of a node that many conversations share
    nodes = saved(named.groupBy(key).agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), below), "named-nodes")
    return named.join(nodes, key).select("conv", "depth", "chars", "size", "node", "n_convs", "below")


def subtree_sums(nodes: DataFrame, lookup: DataFrame, values: list[str]) -> DataFrame:
    """Columns conv, depth and, under the names in `values`, the sums of these columns over each node's subtree, the node included.

    nodes: conv, depth (0 for a root), parent (the parent's conv; null for a root), below (the positive weight of its subtree) and the
    values. lookup: conv, depth, node for the smallest members' whole paths, depth 1 and more."""
    spark = nodes.sparkSession
    lookup = lookup.select("conv", F.col("depth").alias("at"), F.col("node").alias("child"))
    with scope() as written:
        # at first a component for each root
        live = saved(nodes.select("conv", "depth", "parent", "below", *values, F.lit(-1).cast("long").alias("top_conv"), F.lit(-1).cast("long").alias("top_depth")), "live")
    added, top = None, ["top_conv", "top_depth"]
    while not live.isEmpty():
        with scope() as kept:
            totals = live.groupBy(top).agg(F.max("below").alias("total"))
            path = saved(live.join(totals, top).where(F.col("below") * 2 > F.col("total")).select(*top, "conv", "depth", "below"), "path")
        centroid = path.groupBy(top).agg(F.max_by(F.struct("conv", "depth", "below"), "depth").alias("centroid"))
        # which child of the centroid a node is or lies below, if any
        with scope() as new:
            at = live.join(centroid, top).withColumn("at", F.when(F.col("depth") > F.col("centroid.depth"), F.col("centroid.depth") + 1))
            parents = live.select(F.col("conv").alias("child"), F.col("depth").alias("at"), F.col("parent").alias("child_parent"))
            tops = at.where("at IS NOT NULL").join(lookup, ["conv", "at"]).join(parents, ["child", "at"]).where(F.col("child_parent") == F.col("centroid.conv"))
            below = tops.select("conv", "depth", "child", "at")
            split = saved(at.drop("at").join(below, ["conv", "depth"], "left"), "split")
        is_centroid = (F.col("conv") == F.col("centroid.conv")) & (F.col("depth") == F.col("centroid.depth"))
        gone = is_centroid | F.col("child").isNotNull()
        component = split.where(gone).groupBy(*top, "child", "at").agg(*(F.sum(v).alias(v) for v in values))
        sums = component.groupBy(top).agg(*(F.sum(v).alias(v) for v in values))
        more = saved(path.select(*top, "conv", "depth").join(sums, top).select("conv", "depth", *values), "added")
        added = more if added is None else added.unionAll(more)
        with scope() as next_written:
            on_path = path.select("conv", "depth", F.lit(True).alias("on_path"))
            left = split.where(~is_centroid).join(on_path, ["conv", "depth"], "left")
            lighter = F.when(F.col("on_path") & F.col("child").isNull(), F.col("below") - F.col("centroid.below")).otherwise(F.col("below"))
            live = saved(left.select(
                "conv", "depth", "parent", lighter.alias("below"), *values,
                F.coalesce("child", "top_conv").alias("top_conv"), F.coalesce("at", "top_depth").alias("top_depth"),
            ), "live")
        drop_tables(spark, [*written, *new])
        written = [*next_written, *kept]
    drop_tables(spark, written)
    if added is None:
        return nodes.select("conv", "depth", *values)
    return added.groupBy("conv", "depth").agg(*(F.sum(v).alias(v) for v in values))


def ends_digest(ends: DataFrame) -> DataFrame:
    """Columns conv, depth, ends_sha256 from rows node, depth, conv: the digest of each node's ids, ascending, with commas between."""
    order = [F.col("node"), F.col("depth"), F.col("conv")]
    ranged = ends.select("node", "depth", "conv").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = saved(ranged, "ends")
    place = F.row_number().over(Window.partitionBy("range", "node", "depth").orderBy("conv"))
    pieces = ranged.withColumn("piece", F.floor((place - 1) / TOGETHER)).groupBy("node", "depth", "range", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )
    schema = T.StructType([T.StructField("conv", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, done = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("node", "depth", "ids"))):
                if (node, depth) == own:
                    state.update(b"," + ids.encode())
                    continue
                if own:
                    done.append((*own, state.hexdigest()))
                own, state = (node, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], names=schema.names)
                done = []
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*own, state.hexdigest())], names=schema.names)

    dealt = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "range", "piece")
    return dealt.select("node", "depth", "ids").mapInArrow(run, schema)


def trie(found: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the sequences `found` (conv, depth from 1, digest, chars) of all `convs` (conv, distinct): columns
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = saved(members(found), "members")
    heads = paths.where(F.col("conv") == F.col("node")).select("conv", "depth", "chars", "n_convs", "below")
    root = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n_convs")).where("root IS NOT NULL")
    turns_of_all = paths.agg(F.coalesce(F.count("*"), F.lit(0)).alias("n"))
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    inner = heads.join(above, ["conv", "depth"], "left").withColumn("level", F.when(F.col("depth") > 1, F.lit(None)).otherwise(F.lit(0)))
    one_root = F.broadcast(root.select("root"))
    inner = inner.join(one_root).select("conv", "depth", F.coalesce("parent", F.when(F.col("level") == 0, F.col("root"))).alias("parent"), "chars", "n_convs", "below")
    top = root.join(F.broadcast(turns_of_all)).select(
        F.col("root").alias("conv"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("chars"), "n_convs",
        (F.col("n") + F.col("n_convs")).alias("below"),
    )
    nodes = saved(inner.unionByName(top), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    weighed = saved(nodes.join(children, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n_convs", "below", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ), "weighed")
    values = ["n_leaves", "saved_tokens"]
    summed = subtree_sums(weighed.select("conv", "depth", "parent", "below", *values), paths, values)
    ends = paths.where(F.col("depth") == F.col("size")).select("node", "depth", "conv")
    turnless = convs.join(paths.where("depth = 1").select("conv"), "conv", "left_anti").join(one_root).select(F.col("root").alias("node"), F.lit(0).cast("long").alias("depth"), "conv")
    digests = ends_digest(ends.unionByName(turnless))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        weighed.drop(*values)
        .join(summed, ["conv", "depth"])
        .join(digests, ["conv", "depth"], "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see `rebuilt`) of a table conv_id, turn, role, text."""
    found = saved(turns(conversations), "placed")
    convs = saved(found.select("conv").distinct(), "convs")
    return trie(saved(rebuilt(found, convs), "rebuilt"), convs)


_digest = "sha256(strlen(role) || ':' || role || text)"
_crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
#: The same in SQL, by a walk up from every node.
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_digest}) - 1 AS place
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
v AS (SELECT c, {_crc} % 6 AS h FROM (SELECT DISTINCT c FROM t)), m AS (SELECT c AS base, count(*) AS size FROM t GROUP BY 1),
r AS (SELECT v.c, place + 1 AS d, role, text FROM v JOIN t ON t.c = v.c - v.c % 100 WHERE place < h
      UNION ALL SELECT v.c, place - h + least(h, coalesce(size, 0)) + 1, role, text FROM v JOIN t ON t.c = v.c AND place >= h LEFT JOIN m ON base = v.c - v.c % 100),
k AS (SELECT c, d, text, md5(string_agg({_digest}, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key FROM r),
n AS (SELECT key, d, min(c) AS node, count(*) AS n_convs, length(any_value(text)) AS chars FROM k GROUP BY 1, 2),
o AS (SELECT min(c) AS root, count(*) AS n_convs FROM v HAVING count(*) > 0),
up AS (SELECT k.c, k.d, node FROM k JOIN n ON n.key = k.key AND n.d = k.d UNION ALL SELECT c, 0, root FROM v, o),
nodes AS (SELECT node, d, n_convs, chars FROM n UNION ALL SELECT root, 0, n_convs, 0 FROM o),
p AS (SELECT nodes.*, up.node AS parent FROM nodes LEFT JOIN up ON up.c = nodes.node AND up.d = nodes.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY 1, 2),
w AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN kids ON kids.node = p.node AND kids.d = p.d),
s AS (SELECT up.node, up.d, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM w JOIN up ON up.c = w.node AND up.d <= w.d GROUP BY 1, 2),
e AS (SELECT up.node, up.d, sha256(string_agg(CAST(up.c AS VARCHAR), ',' ORDER BY up.c)) AS ends FROM up JOIN (SELECT c, max(d) AS d FROM up GROUP BY 1) l ON l.c = up.c AND l.d = up.d GROUP BY 1, 2)
SELECT w.node AS conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN s ON s.node = w.node AND s.d = w.d LEFT JOIN e ON e.node = w.node AND e.d = w.d
"""
