"""Line dedup and SimHash against plain versions; fingerprints by locally consistent parsing; the quality model."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import components, fingerprints, line_dedup, quality, simhash

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_lines(rows, min_docs=5):
    """(id, text) rows: every row is a document."""
    keys = [[ascii_lower(x.strip(BLANK)) for x in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(list)
    for (i, _), own in zip(rows, keys):
        for k in {k for k in own if len(k) >= 40}:
            holders[k].append(i)
    order = lambda i: (i is not None, i or 0)
    keeper = {k: max(ids, key=order) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for (i, t), own in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own) if k not in keeper or keeper[k] == i]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(spark, awkward, nothing, data, batches):
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet")):
        found = line_dedup.without_repeated_lines(docs, docs.columns, batches=batches)
        mine = sorted((str(r.row.doc_id), r.text, r.n_lines, r.n_dropped) for r in found.collect())
        assert mine == without_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[3] for r in mine) > 0
    assert line_dedup.without_repeated_lines(nothing, ["doc_id"]).count() == 0


def test_line_dedup_equals_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mine = [(r.row.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.without_repeated_lines(docs, ["doc_id"]).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(mine) == sorted(con.execute(line_dedup.ORACLE).fetchall())


def test_line_dedup_of_repeated_rows_and_other_ids(spark, awkward):
    """Repeated rows and ids count one by one, in the SQL as well; ids may be texts."""
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text").toArrow())
    mine = [(str(r.row.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in line_dedup.without_repeated_lines(awkward, ["doc_id"]).collect()]
    assert sorted(mine) == sorted((str(a), *b) for a, *b in con.execute(line_dedup.ORACLE).fetchall())
    line = "a line of more than forty code points, in five rows"
    rows = [("b", line), ("b", line), ("b", line), ("a", line), ("c", line + "\nown"), (None, line), ("d", "other")]
    found = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id string, text string"), ["doc_id"])
    assert sorted((str(r.row.doc_id), r.text) for r in found.collect()) == [("None", ""), ("a", ""), ("b", ""), ("b", ""), ("b", ""), ("c", line + "\nown"), ("d", "other")]


def test_runs_are_merged_without_a_shuffle(spark):
    """Of a merge of runs, and of a batch against them, only the batch's own keys are exchanged; ids of any type."""
    for kind in ("long", "string"):
        runs = line_dedup.LineRuns(spark)
        keys = spark.range(1000).selectExpr(f"cast(id as {kind}) as id", "id % 10 AS h1", "id % 10 AS h2")
        counted = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).repartition(4, "h1", "h2")
        runs._write(counted, 0)
        runs._write(counted, 0)
        merged = runs._merged(*runs.levels[0])
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.n for r in merged.collect()) == [200] * 10
        batch = keys.groupBy("h1", "h2").count()
        for run in runs.levels[0]:
            batch = batch.join(runs._read(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        assert batch._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and batch.count() == 0
        assert sorted(r.n for r in runs.settled().collect()) == [200] * 10
        runs.clear()
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked_ids(prints):
    """(id, fingerprint) rows: each row's smallest id reachable by links of at most four bits."""
    distinct = sorted({p for _, p in prints})
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = np.array(distinct, np.uint64)
    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= 4) + i + 1:
            root[find(int(j))] = find(i)
    of = {p: find(i) for i, p in enumerate(distinct)}
    least = defaultdict(list)
    for i, p in prints:
        least[of[p]] += [i] if i is not None else []
    return sorted((str(i), f"{p:016x}", str(min(least[of[p]], default=None))) for i, p in prints)


def test_simhash(spark, awkward, nothing, data):
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet")):
        found = simhash.near_copies(docs).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
        mine = sorted((str(r.id), r.f, str(r.component_id)) for r in found.collect())
        assert mine == linked_ids([(r.doc_id, print_of(r.text)) for r in docs.collect()])
    assert simhash.near_copies(nothing).count() == 0


@pytest.mark.parametrize("segments", [2, 3])
def test_no_link_is_lost(spark, segments):
    """Chains and clouds of fingerprints around a few centres, all pairs compared; strangers too."""
    rng = random.Random(segments)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(prints)[:12]:
        x = centre
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a large group under one value
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 4, segments)
    for r in links.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4
    roots = {r.node: r.root for r in components.components(links).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for (s,), p in zip(signed, prints):
        mine[roots.get(s, s)].add(p)
    for i, _, c in linked_ids([(p, p) for p in prints]):
        theirs[c].add(int(i))
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    entries = sum(len(masks) for _, *masks in simhash.segment_masks(segments, 4))
    assert links.count() < entries * len(prints)  # fewer than the entries, though thousands meet under one value


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(300)] + [(5000, 5000 + i) for i in range(500)] + [(7, 7)]
    graph = defaultdict(set)
    for a, b in edges:
        graph[a].add(b), graph[b].add(a)
    expect = {}
    for start in sorted(graph):
        todo = [] if start in expect else [start]
        while todo:
            if (x := todo.pop()) not in expect:
                expect[x] = start
                todo += graph[x]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in expect.items() if len(graph[k] - {k})  and k in found} and {k for k, v in expect.items() if k != v} <= set(found)


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for n, (i, _) in enumerate(rows):
        t, after = texts[n], texts[(n + 1) % len(rows)]
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    return sorted(out)


def test_edits(spark, awkward, nothing, data):
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet"), awkward.where("doc_id = 8")):
        rows = fingerprints.with_edits(docs).collect()
        assert sorted((str(r.id), r.n_chars, r.edited_sha256) for r in rows) == edited([(r.doc_id, r.text) for r in docs.collect()])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
        by_text = defaultdict(set)
        texts = {(str(r.doc_id)): r.text or "" for r in docs.collect()}
        for r in rows:
            if str(r.id) not in ("3", "None"):
                by_text[texts[str(r.id)]].add(r.fingerprint)
        assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.with_edits(nothing).count() == 0


def test_edited_texts_stay_alike_and_others_do_not(spark, data):
    rows = fingerprints.with_edits(spark.read.parquet(f"{data}/documents.parquet")).where("n_chars > 1500").collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.15


def test_parsing_is_locally_consistent():
    rng = random.Random(8)
    letters = "abcdefghijklmnop "
    middle = "".join(rng.choice(letters) for _ in range(4000))

    def names(text, levels=2):
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        for _ in range(levels):
            symbols, _owner = fingerprints.parse(symbols, np.zeros(len(symbols), np.int64))
        return set(symbols.tolist())

    own = names(middle)
    for before in ("", "x", "some other words, of any length", "aaaaaaa" * 9):
        inside = names(before + middle + before[::-1])
        assert len(own - inside) <= 12  # but for the few phrases at the edges
    together = fingerprints.sketches([middle, "", middle, "a"])
    assert together[0].tolist() == fingerprints.sketches([middle])[0].tolist() == together[2].tolist() and not len(together[1])


M64 = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_names(symbols):
    """One level of the parse, place by place."""
    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    symbols = [x if n == 1 else plain_mix((x * 31 + n) & M64) for x, n in runs]
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, x in enumerate(labels):
            differ = x ^ (labels[i - 1] if i else 0)
            at = (differ & -differ).bit_length() - 1 if differ else None
            # equal neighbours differ nowhere: the place past the last bit
            tossed.append((2 * at + (x >> at & 1)) if differ else 2 * (64 if labels is symbols else 8))
        labels = tossed
    begins = [i for i in range(len(symbols)) if i == 0 or (labels[i] > labels[i - 1] and i + 1 < len(symbols) and not labels[i + 1] > labels[i])]
    weights = [int(w) for w in fingerprints._weights]
    out = []
    for a, b in zip(begins, [*begins[1:], len(symbols)]):
        out.append(plain_mix(sum((x + 1) * weights[k & 63] for k, x in enumerate(symbols[a:b])) & M64))
    return out


def plain_sketch(text):
    symbols, levels = [ord(c) for c in text], []
    for _ in range(4):
        symbols = plain_names(symbols)
        levels.append({x >> 32 for x in symbols})
    found = set().union(*levels[1:])
    return sorted(found if len(found) >= 4 else found | levels[0])[:64]


def test_fingerprints_against_a_plain_parser(spark, awkward, data):
    rng = random.Random(4)
    docs = awkward.unionByName(spark.read.parquet(f"{data}/documents.parquet").limit(80), allowMissingColumns=True)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        own, changed, following = (plain_sketch(x) for x in (t, t[: len(t) - len(t) // 2] + after[: len(t) // 2], after))
        like = lambda a, b: float(a == b) if not a or not b else len(set(a) & set(b) & set(sorted({*a, *b})[:64])) / len(sorted({*a, *b})[:64])
        as_text = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((str(i), as_text(own), as_text(changed), round(like(own, changed), 9), round(like(own, following), 9)))
    got = [(str(r.id), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.with_edits(docs.repartition(5, F.lit(rng.random()))).collect()]
    assert sorted(got) == sorted(want)


def test_edits_of_other_ids(spark):
    """Texts, dates and numbers beyond 2^53 as ids, null and repeated ids and rows that fill several ranges."""
    rows = [(i % 7 if i % 3 else None, f"{'the same beginning of a text, ' if i % 2 else ''}{i % 11}") for i in range(150)] + [(None, "again")] * 60 + [(3, "")] * 60 + [(2**60 + 1, "x"), (2**60, "y")]
    for kind in ("long", "string", "decimal(30,0)"):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
        plain = sorted(((None if i is None else str(i) if kind == "string" else i, t) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0 if kind != "string" else r[0] or "", r[1]))
        want = []
        for n, (i, t) in enumerate(plain):
            after = plain[(n + 1) % len(plain)][1]
            want.append((str(i), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
        assert sorted((str(r.id), r.edited_sha256) for r in fingerprints.with_edits(docs).collect()) == sorted(want), kind
    days = spark.sql("SELECT date '2020-01-01' + int(id) AS doc_id, string(id) AS text FROM range(50)")
    assert fingerprints.with_edits(days).count() == 50


def test_quality_held_out(spark, data):
    sf = f"{data.rsplit('/', 1)[0]}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels, ["doc_id"])
    rows = found.where("held_out").join(labels, F.col("row.doc_id") == labels.doc_id).select("score", "quality").toPandas()
    right = ((rows.score >= 0.7) == (rows.quality == 1)).mean()
    assert len(rows) > 500 and right >= 0.85, right


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(3, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(awkward, labels, ["doc_id", "features"]).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows) and {r.row.features for r in rows} == {"features"}
    assert {r.score for r in quality.quality_scores(awkward, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert quality.quality_scores(nothing, labels, ["doc_id"]).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(4)
    x = rng.random((6000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = quality.fit(x[:4000], y[:4000], rounds=20, n_pairs=2, pair_rounds=120)
    assert ((model.score(x[4000:]) > 0.5) == (y[4000:] == 1)).mean() > 0.9 and (0, 1) in model.pairs
    bins = [np.searchsorted(e, x[:9, f], "right") for f, e in enumerate(model.edges)]
    total = [model.base + sum(t[b[i]] for t, b in zip(model.tables, bins)) + sum(g[model.coarse[a][bins[a][i]], model.coarse[b][bins[b][i]]] for (a, b), g in zip(model.pairs, model.grids)) for i in range(9)]
    assert np.allclose(1 / (1 + np.exp(-np.array(total))), model.score(x[:9]))
