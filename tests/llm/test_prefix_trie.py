"""The trie, its sums and its digests equal a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from quarry.llm.prefix_trie import ORACLE, conversation_trie, ends_digest, subtree_sums
from quarry.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, row string, node long, depth string, place long"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p)))) for p, m in members.items()}
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    }


def check(spark, rows):
    got = [tuple(r) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_random_conversations(spark):
    rng, rows = random.Random(2), []
    for c in [*range(0, 30), *range(100, 112), 205, 206, -3, -150, 10**12 + 7]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 9])):
            rows.append((c, turn, rng.choice(["user", "tool"]), rng.choice(["a", "bb", "Ü😀"]), "x", 1, "y", 2))
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_ties_repeats_and_long_ones(spark):
    rows = [(7, t, "user" if t % 2 else None, f"turn {t}", None, None, None, None) for t in range(150)]  # one long chain
    rows += [(8, t, "user" if t % 2 else None, f"turn {t}", None, None, None, None) for t in range(140)]
    rows += [(None, 1, "user", "no conversation"), (9, None, "user", "null is first"), (9, 0, "user", "z"), (9, 0, "user", "z"), (9, 0, "a", "z"), (9, None, None, None), (10, 5, "", "x" * 200_000)]
    rows += [(100 + i, t, "user", f"copy {t}") for i in range(60) for t in range(3)]  # many copies
    check(spark, [(*r, *([None] * 8))[:8] for r in rows])


def test_empty(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None, None)], SCHEMA)).count() == 0


def test_a_star_a_chain_and_two_trees(spark):
    """subtree_sums by itself, over forests whose weights are its nodes' members."""
    for paths in ([[i] for i in range(40)], [[*range(60)]], [[1, 2, 3], [1, 2, 4], [1, 5], [6, 7], [6, 7, 8, 9], [6, 7, 8, 10]]):
        members = defaultdict(list)
        for c, p in enumerate(paths):
            for d in range(1, len(p) + 1):
                members[tuple(p[:d])].append(c)
        below = {p: sum(len(paths[c]) - len(p) + 1 for c in m) for p, m in members.items()}
        value = {p: p[-1] + 1 for p in members}
        nodes = [(min(m), len(p), min(members[p[:-1]]) if len(p) > 1 else None, below[p], value[p]) for p, m in members.items()]
        lookup = [(c, d, min(members[tuple(p[:d])])) for c, p in enumerate(paths) for d in range(1, len(p) + 1)]
        # one component for each root: an edge to a common root of weight one more
        nodes = [(c, d, 0 if parent is None else parent, w, v) for c, d, parent, w, v in nodes] + [(0, 0, None, sum(below[p] for p in members if len(p) == 1) + 1, 0)]
        got = subtree_sums(spark.createDataFrame(nodes, "conv long, depth long, parent long, below long, v long"), spark.createDataFrame(lookup, "conv long, depth long, node long"), ["v"])
        want = {(min(m), len(p)): sum(value[q] for q in members if q[: len(p)] == p) for p, m in members.items()} | {(0, 0): sum(value.values())}
        assert {(r.conv, r.depth): r.v for r in got.collect()} == want


def test_ends_in_pieces(spark, monkeypatch):
    from quarry.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "TOGETHER", 7)
    ends = spark.range(500).select((F.col("id") % 3).alias("node"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv"))
    got = {r.conv: r.ends_sha256 for r in ends_digest(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 500, 3))).encode()).hexdigest() for k in range(3)}


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_prefix_trie"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert {tuple(r) for r in QUERIES["op12_prefix_trie"](spark, data).collect()} == set(con.execute(ORACLE).fetchall())
