"""Communities against a plain greedy run, components against a plain walk, and runs over changes against full ones."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators.communities import communities, components, incremental, modularity, ranked_communities
from quarry.sources.shared import cut


def plain_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def plain_modularity(edges, community):
    m, inside, k = len(edges), 0, {}
    for a, b in edges:
        inside += community[a] == community[b]
        for x in (a, b):
            k[community[x]] = k.get(community[x], 0) + 1
    return inside / m - sum(v * v for v in k.values()) / (4 * m * m)


def plain_greedy(edges):
    """Joins the two communities that gain most, until none gains."""
    community = {x: x for e in edges for x in e}
    best = plain_modularity(edges, community)
    while True:
        tries = []
        for a, b in {(community[a], community[b]) for a, b in edges if community[a] != community[b]}:
            joined = {x: a if c == b else c for x, c in community.items()}
            tries.append((plain_modularity(edges, joined), min(a, b), max(a, b), joined))
        if not tries or max(tries, key=lambda t: t[:3])[0] <= best:
            return best
        best, _, _, community = max(tries, key=lambda t: t[:3])


def planted(rng, groups, size, inside, across):
    edges = set()
    for g in range(groups):
        for i in range(size):
            for j in range(i):
                if rng.random() < inside:
                    edges.add((g * size + j, g * size + i))
    for _ in range(across):
        a, b = rng.randrange(groups * size), rng.randrange(groups * size)
        if a != b:
            edges.add((min(a, b), max(a, b)))
    for g in range(1, groups):
        edges.add((0, g * size))
    return sorted(edges)


def test_against_a_greedy_run(spark):
    """Connected graphs of planted groups: at least 0.95 of the modularity of a plain greedy run."""
    rng = random.Random(2)
    for edges in (planted(rng, 4, 7, 0.7, 8),):
        frame = spark.createDataFrame(edges, "src long, dst long")
        found = communities(frame)
        got = {r.node: r.community for r in found.collect()}
        mine = plain_modularity(edges, got)
        assert mine >= 0.95 * plain_greedy(edges), (mine, plain_greedy(edges))
        computed = modularity(frame.withColumn("weight", F.lit(1.0)), found).collect()
        assert len(computed) == 1 and abs(computed[0].modularity - mine) < 1e-9
        assert all(c == min(x for x in got if got[x] == c) for c in got.values())


def test_components_and_odd_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500)]
    frame = spark.createDataFrame([*edges, (None, 1), (3, None)], "src long, dst long")
    assert {r.node: r.component for r in components(frame).collect()} == plain_components(edges)
    assert components(frame.limit(0)).count() == 0 and communities(frame.limit(0)).count() == 0


def test_rounds_of_components_follow_the_logarithm_of_a_path(spark, monkeypatch):
    """A path in order, and one whose names are dealt: few tables are stored, however long it is."""
    from quarry.operators import communities as module

    stored = []

    def counted(df):
        stored.append(df)
        assert len(stored) <= 40
        return cut(df)

    monkeypatch.setattr(module, "cut", counted)
    names = list(range(600))
    random.Random(6).shuffle(names)
    for n in (list(range(600)), names):
        stored.clear()
        edges = list(zip(n[:300], n[1:300])) + list(zip(n[300:], n[301:]))
        assert {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()} == plain_components(edges)


def test_tables_of_nodes_are_never_broadcast(spark, monkeypatch):
    """Only sums of components may be sent through the driver, small as the tables of this test are."""
    from quarry.operators import communities as module

    keys = set()

    def read(df):
        keys.update(re.findall(r"BroadcastHashJoin \[(\w+)#", df._jdf.queryExecution().executedPlan().toString()))
        return cut(df)

    monkeypatch.setattr(module, "cut", read)
    found = communities(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)], "src long, dst long"), levels=1, rounds=2)
    assert read(found).count() == 6 and keys <= {"component", "root"}


def test_runs_over_changes(spark):
    """Three changes: an edge between two components, an edge that goes, a component that is new. Each run equals a full one."""
    rng = random.Random(4)
    first = [(a + 100 * c, b + 100 * c, 1, False) for c in range(3) for a, b in planted(rng, 2, 4, 0.9, 1)]
    schema = "src long, dst long, changed_at int, gone boolean"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    as_set = lambda df: {(r.node, r.component, r.community) for r in df.select("node", "component", "community").collect()}
    known = communities(frame(first))
    same, read = incremental(known, frame(first), 1)
    assert as_set(same) == as_set(known) and read.count() == 0
    for step, change in enumerate(([(3, 104, 2, False)], [(*first[0][:2], 3, True)], [(900, 901, 4, False), (901, 902, 4, False)]), 2):
        first = [r for r in first if r[:2] not in {c[:2] for c in change}] + change
        known, read = incremental(known, frame(first), step - 1)
        left = [r for r in first if not r[3]]
        assert as_set(known) == as_set(communities(frame(left)))
        assert 0 < read.count() < len(left)


def test_ranked(spark):
    found = spark.createDataFrame([(i, 0, i // 4 * 4) for i in range(18)], "node long, component long, community long")
    assert [tuple(r) for r in ranked_communities(found, 3, 2).collect()] == [(0, 4, 1), (4, 4, 2)]
