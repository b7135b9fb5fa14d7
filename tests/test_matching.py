"""Matches, ranks and paths against plain Python, with ties, nulls and rows that share nothing."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from quarry.functions import repair, text
from quarry.operators import lifecycle, matching, retrieval, setjoin


def all_pairs(lines, entries, score, least):
    found = {}
    for a in {tuple(sorted(set(x))) for x in lines}:
        for b in {tuple(sorted(set(x))) for x in entries}:
            both = len(set(a) & set(b))
            if both and score(both, len(a), len(b)) >= least:
                found[a, b] = round(score(both, len(a), len(b)), 9)
    return found


COVERAGE = lambda n, a, b: n / b
WEIGHTED = lambda n, a, b: float(Decimal(repr(0.7 * (n / b) + 0.3 * (n / (a + b - n)))).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(3)
    some = lambda n: [["common"] * (rng.random() < 0.5) + rng.choices("abcdefghijklmnopqrst", weights=range(1, 21), k=rng.randint(0, 6)) for _ in range(n)]
    lines, entries = some(150) + [[]], some(120) + [[]]
    frames = [spark.createDataFrame([(x,) for x in rows] + [(None,)], "tokens array<string>") for rows in (lines, entries)]
    for score, plain in ((setjoin.coverage_score, COVERAGE), (setjoin.weighted_score, WEIGHTED)):
        for least in (0.3, 0.5, 0.75, 1.0):
            found = setjoin.similar_sets(*frames, score, least).collect()
            got = {(tuple(r.line_tokens), tuple(r.entry_tokens)): round(r.score, 9) for r in found}
            assert len(found) == len(got) and got == all_pairs([x for x in lines if x], [x for x in entries if x], plain, least)


def test_a_token_that_half_the_entries_hold(spark):
    """Pairs are met for what decides alone: the token that all share is never joined."""
    entries = spark.range(3000).select(F.array(F.lit("bolt"), F.concat(F.lit("e"), "id")).alias("tokens"))
    lines = spark.range(3000).select(F.array(F.lit("bolt"), F.concat(F.lit("e"), (F.col("id") + 2990))).alias("tokens"))
    found = setjoin.similar_sets(lines, entries, setjoin.weighted_score, 0.5)
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_containing(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", "x"]
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 5))) for _ in range(60)] + ["x", "xy"]
    found = setjoin.containing(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), spark.createDataFrame([(p,) for p in parts] + [(None,)], "part string")).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == {(t, p) for t in texts for p in parts if p and p in t}


def test_best_entries(spark):
    lines = [(1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["z"]), (4, []), (5, ["a"]), (6, None)]
    entries = [(10, ["a", "b"]), (9, ["b", "a"]), (11, ["a", "c", "d", "e", "f"]), (12, []), (13, ["z", "y"]), (14, ["z", "y"])]
    frames = spark.createDataFrame(lines, "line long, tokens array<string>"), spark.createDataFrame(entries, "entry long, tokens array<string>")
    assert sorted(map(tuple, setjoin.best_entries(*frames).collect())) == [(1, 9, 1.0), (2, 9, 1.0), (3, 13, 0.5), (5, 9, 0.5)]


def test_names_that_a_line_covers(spark):
    """What a line holds in full goes before what it shares more words with."""
    row = spark.range(1).select(text.match_tokens(F.lit("Фреза концевая Ø12 твердосплавная"), 2).alias("l"), text.match_tokens(F.lit("фреза концевая"), 2).alias("a"), text.match_tokens(F.lit("фреза концевая ø12 иная длинная серия особая"), 2).alias("b")).first()
    lines = spark.createDataFrame([(1, row.l)], "line long, tokens array<string>")
    entries = spark.createDataFrame([(7, row.a), (8, row.b)], "entry long, tokens array<string>")
    assert [tuple(r) for r in setjoin.best_entries(lines, entries, setjoin.weighted_score).collect()] == [(1, 7, 0.85)]
    assert [tuple(r) for r in setjoin.best_entries(lines, entries).collect()] == [(1, 7, 1.0)]
    with_parts = spark.createDataFrame([(7, row.a, None), (9, row.b, "12 твердо"), (8, row.b, "999")], "entry long, tokens array<string>, part string")
    found = setjoin.best_entries(lines.withColumn("text", F.lit("фреза концевая 12 твердосплавная")), with_parts)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 1.0)]  # of equals the smaller one


def test_document_search(spark):
    docs = [(1, "cat cat dog"), (2, "Dog"), (3, None), (4, "bird " * 50 + "cat"), (5, "")]
    words = {i: (t or "").lower().split() for i, t in docs if t is not None}
    n, mean = 5, sum(map(len, words.values())) / 4
    expect = {}
    for i, own in words.items():
        score = 0.0
        for term in ("cat", "dog"):
            df, tf = sum(term in w for w in words.values()), own.count(term)
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        if score:
            expect[i] = round(score, 6)
    found = matching.document_search(spark.createDataFrame(docs, "id long, text string"), "id", "text", ["cat", "dog"])
    rows = [tuple(r) for r in found.collect()]
    assert dict(rows) == expect and [s for _, s in rows] == sorted(expect.values(), reverse=True)


def test_ranks_over_ranges(spark):
    rows = [(i, i * 37 % 101) for i in range(1000)]
    found = retrieval.ranked(spark.createDataFrame(rows, "id long, v long").repartition(7), [-F.col("v"), F.col("id")]).collect()
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == [i for i, v in sorted(rows, key=lambda x: (-x[1], x[0]))]
    assert sorted(r.rank for r in found) == list(range(1, 1001))


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5)], "source long, target long")
    found = matching.reached(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()
    assert sorted((r.node, r.depth, r.path) for r in found) == [(1, 0, [1]), (2, 1, [1, 2]), (3, 1, [1, 3]), (4, 2, [1, 2, 4])]


def test_transitions_and_leases(spark):
    events = spark.createDataFrame([("a", 1, "new"), ("a", 2, "run"), ("a", 3, "new"), ("b", 1, "run")], "k string, t long, s string")
    found = lifecycle.transitions(events, "k", "s", ["t"], {"new": ["run"], "run": ["done"]}).collect()
    assert sorted((r.k, r.t, r.allowed) for r in found) == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, True)]
    jobs = spark.createDataFrame([(1, "running", 5, 1), (2, "running", 5, 3), (3, "running", 20, 9), (4, "done", 5, 9)], "id long, status string, lease_until long, attempts long")
    assert sorted((r.id, r.next_status) for r in lifecycle.expired_leases(jobs, F.lit(10), 3).collect()) == [(1, "queued"), (2, "failed"), (3, "running"), (4, "done")]


def test_repair(spark):
    one = spark.range(1).select(
        repair.found_number(F.lit("Invoice No. 12-A/3 of")).alias("a"), repair.found_number(F.lit("none")).alias("b"), repair.found_date(F.lit("от 5 Марта 2024 г.")).cast("string").alias("c"),
        repair.found_date(F.lit("31.02.2024")).cast("string").alias("d"), repair.typed(F.lit("1\u00a0234,5"), "number").alias("e"), repair.typed(F.lit("x"), "date").alias("f"),
        repair.net_price(F.lit(120.0), F.lit(20.0), F.lit(True), F.lit(2)).alias("g"), repair.requisite(F.lit(None).cast("string"), [10]).alias("h"),
    ).first()
    assert tuple(one) == ("12-A/3", None, "2024-03-05", None, 1234.5, None, 50.0, "missing")


def test_agreement(spark):
    """A value that another extraction lacks does not agree; fields that the main one lacks don't count."""
    rows = [
        (1, True, "A-1", "5", 10.0), (1, False, " A-1 ", "5", 10.001), (2, True, "A", None, 1.0), (2, False, "A", "x", None), (3, True, None, "5", 1.0), (3, False, "A", "5", 1.0),
        (4, True, "A", "5", 1.0), (5, True, "A", "5", 1.0), (5, False, "A", "5", 1.0), (5, False, "B", "5", 1.0), (6, False, "A", "5", 1.0),
    ]
    found = lifecycle.agreement(spark.createDataFrame(rows, "k long, main boolean, n string, d string, x double"), ["k"], F.col("main"), ["n"], ["n", "d", "x"], ["x"])
    assert {r.k: (round(r.score, 3), r.accepted) for r in found.collect()} == {1: (1.0, True), 2: (0.5, False), 3: (0.0, False), 4: (0.0, False), 5: (0.667, False), 6: (0.0, False)}


def test_prices_on_one_basis(spark):
    """price, rate, held, pack, whether the invoice's prices hold the tax: the price, what was assumed, whether a pack was divided."""
    cases = [
        ((100.0, None, None, None, True), (120.0, True, False)), ((120.0, 20.0, True, 2, False), (50.0, False, True)), ((110.0, 0.1, True, 1, True), (110.0, False, False)), ((100.0, 0.1, False, None, True), (110.0, False, False)),
        ((100.0, None, None, 4, False), (25.0, True, True)),
    ]
    frame = spark.createDataFrame([(i, *given) for i, (given, _) in enumerate(cases)], "i int, p double, r double, h boolean, k int, t boolean")
    found = frame.select("i", repair.on_basis(F.col("p"), F.col("r"), F.col("h"), F.col("k"), F.col("t")).alias("x")).orderBy("i").collect()
    assert [(r.x.price, r.x.tax_assumed, r.x.pack_normalized) for r in found] == [want for _, want in cases]
    day = F.lit("2024-01-10").cast("date")
    none = F.lit(None).cast("date")
    one = spark.range(1).select(
        repair.price_comparison(F.lit(105.0), F.lit(100.0), day, none, F.lit("2024-01-01").cast("date")).alias("a"), repair.price_comparison(F.lit(106.0), F.lit(100.0), day, F.lit("2024-01-09").cast("date"), none).alias("b"),
        repair.price_comparison(F.lit(90.0), F.lit(100.0), day, none, F.lit("2023-01-01").cast("date")).alias("c"), repair.price_comparison(F.lit(0.0), F.lit(100.0), day, none, none).alias("d"),
    ).first()
    assert [tuple(x) for x in one] == [("ok", 5.0, None), ("above_catalog", 6.0, 1), ("below_catalog", -10.0, 374), ("unknown", None, None)]
