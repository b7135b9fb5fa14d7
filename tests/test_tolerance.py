"""Groups within a tolerance against the sequence, row by row."""

import random

from quarry.operators.tolerance import same_within


def sequence(rows, tolerance=0.02):
    """rows: kind, value, seq, confidence, view."""
    rows, used, out = sorted(rows, key=lambda r: r[2]), set(), []
    for i, a in enumerate(rows):
        if i in used:
            continue
        group = [i] + [j for j in range(i + 1, len(rows)) if j not in used and rows[j][0] == a[0] and a[1] and rows[j][1] and abs(a[1] - rows[j][1]) / max(a[1], rows[j][1], 1e-9) < tolerance]
        used.update(group)
        best = max((rows[j] for j in group), key=lambda r: (r[3] or 0.0, -r[2]))
        sure = 0.5 if best[3] is None else best[3]
        out.append((best[0], best[2], round(min(1.0, sure + 0.1) if len(group) > 1 else sure, 3), tuple(sorted({rows[j][4] for j in group} - {None})), len(group)))
    return sorted(out, key=str)


def test_equals_the_sequence(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hole", "hole", "hole", "slot", None]), rng.choice([None, 0.0, -5.0, 10.0, round(rng.uniform(5, 9), 2), round(rng.uniform(90, 120), 1)]), i, rng.choice([None, 0.3, 0.5, 0.9, 0.95]), rng.choice(["v1", "v2", None])) for i in range(500)]
    frame = spark.createDataFrame(rows, "kind string, value double, seq long, sure double, view string").repartition(5)
    found = same_within(frame, "kind", "value", "seq", "sure", "view").collect()
    assert sorted(((r.kind, r.seq, r.confidence, tuple(r.views), r.votes) for r in found), key=str) == sequence(rows)
    assert same_within(frame.limit(0), "kind", "value", "seq", "sure", "view").count() == 0


def test_one_kind_in_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [("a", 100.0 * 1.015**i, i * 7 % 300, 0.5, "v") for i in range(300)] + [("a", 1e6, 300 + i, 0.4, "w") for i in range(500)]
        frame = spark.createDataFrame(rows, "kind string, value double, seq long, sure double, view string")
        found = same_within(frame, "kind", "value", "seq", "sure", "view").collect()
        assert sorted(((r.kind, r.seq, r.confidence, tuple(r.views), r.votes) for r in found), key=str) == sequence(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
