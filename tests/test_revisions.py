"""Patches that make revisions or fail with all their errors, and reach along typed edges."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.typed_graph import Target, adjacency, critical, impact_report, reached
from quarry.sources.revisions import PATCH, PatchError, Revisions, digest_of
from quarry.sources.shared import shared_path


@pytest.fixture
def table(spark):
    found = Revisions(spark, shared_path(spark, "revisions"))
    found.create(spark.createDataFrame([("a", "1", "proposed"), ("b", "2", "human_approved"), ("c", "3", "proposed")], "id string, value string, assurance string"))
    return found


def patch(spark, *rows):
    return spark.createDataFrame(rows, PATCH)


def test_patches(spark, table):
    first = table.head()
    change = patch(spark, ("add", "a2", "10", "proposed", "a"), ("supersede", "a", None, None, None), ("retract", "c", None, None, None))
    second = table.apply(change, first, "k1", "reader")
    assert second[0] == 2 and table.head() == second
    assert sorted((r.id, r.state) for r in table.read().collect()) == [("a", "superseded"), ("a2", "active"), ("b", "active"), ("c", "retracted")]
    assert sorted((r.id, r.state) for r in table.read(1).collect()) == [("a", "active"), ("b", "active"), ("c", "active")]
    with pytest.raises(PatchError) as e:  # everything that is wrong at once
        table.apply(patch(spark, ("add", "x", "1", "constraint_validated", None), ("add", "a2", "1", "proposed", None), ("retract", "b", None, None, None), ("supersede", "zz", None, None, None), ("fly", "a", None, None, None)), first, "k1", "reader")
    assert e.value.errors == [
        "stale_base_revision", "duplicate_idempotency_key", "producer_cannot_validate_or_approve", "unknown_assertions:zz", "confirmed_assertions_require_human:b",
        "supersede_requires_replacement_assertion", "graph_integrity:a2", "unknown_operation",
    ]
    assert table.head() == second
    same = patch(spark, ("add", "b2", "2", "proposed", "b"), ("supersede", "b", None, None, None))
    assert table.apply(same, second, "k2", "reader")[0] == 3  # the same value
    with pytest.raises(PatchError):
        table.apply(patch(spark, ("retract", "b", None, None, None)), table.head(), "k3", "system")
    assert table.apply(patch(spark, ("retract", "b2", None, None, None)), table.head(), "k3", "human")[0] == 4


def test_of_two_writers_one_fails(spark, table):
    base = table.head()
    table._write(table.read(), 2, "other", "human")  # someone else was first
    with pytest.raises(PatchError) as e:
        table.apply(patch(spark, ("retract", "a", None, None, None)), base, "k", "human")
    assert e.value.errors == ["stale_base_revision"]


def test_digests(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "x string, y int")
    assert digest_of(rows.repartition(3)) == digest_of(rows.orderBy(F.desc("x"))) != digest_of(rows.distinct())


def plain_reach(steps, starts):
    """Breadth first, neighbours in order."""
    found, queue = {s: [s] for s in sorted(starts)}, sorted(starts)
    while queue:
        now = queue.pop(0)
        for b in sorted({b for a, b in steps if a == now}):
            if b not in found:
                found[b] = [*found[now], b]
                queue.append(b)
    return found


def test_reach(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", rng.choice(["contains", "depends_on", "mates_with", "unknown"])) for _ in range(60)] + [(None, "n01", "contains")]
    steps = {(a, b) for a, b, k in edges if a and k in ("contains", "mates_with")} | {(b, a) for a, b, k in edges if a and k in ("depends_on", "mates_with")}
    frame = spark.createDataFrame(edges, "source string, target string, type string")
    assert {tuple(r) for r in adjacency(frame).collect()} == steps
    starts = spark.createDataFrame([("n03",), ("alone",)], "node string")
    assert {r.node: r.path for r in reached(adjacency(frame), starts).collect()} == plain_reach(steps, ["n03", "alone"])
    nodes = spark.createDataFrame([(f"n{i:02d}", "Artifact" if i % 2 else "View") for i in range(40)], "node string, type string")
    report = impact_report(nodes, frame, starts.where("node = 'n03'")).collect()
    assert {r.node for r in report if r.direct} == {b for a, b in steps if a == "n03" and b != "n03"} and all(r.depth == len(r.path) - 1 for r in report)


def test_critical(spark):
    edges = spark.createDataFrame([("f", "p", "part_of"), ("p", "q", "mates_with"), ("p", "c", "contains")], "source string, target string, type string")
    impact = lambda name, percent=None: [(name, percent)]
    rows = [
        ("a1", "f", "active", impact("safety")), ("a2", "q", "active", impact("safety")), ("a3", "c", "active", impact("mass", 0.5)), ("a4", "c", "active", impact("mass", 2.0)), ("a5", "c", "active", impact("mass")),
        ("a6", "q", "active", []), ("a7", "f", "retracted", impact("safety")), ("a8", "p", "active", impact("color")), ("a9", "p", "active", [("mass", 0.1), ("safety", None)]),
    ]
    frame = spark.createDataFrame(rows, "assertion string, subject string, state string, impacts array<struct<name: string, percent: double>>")
    target = Target(spark.createDataFrame([("f",)], "node string"), spark.createDataFrame([("a6",), ("a7",)], "assertion string"), ("safety", "mass"))
    assert {r.assertion for r in critical(frame, edges, target).collect()} == {"a1", "a4", "a5", "a6", "a9"}
