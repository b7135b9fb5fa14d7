"""Top-k search and token counts against plain versions."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import token_counts, topk

WORDS = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)], "v") for i in range(900)]
    rows += [(i, list(rows[7][1]), "v") for i in (901, 903, 905)]  # ties
    rows += [(200, list(rows[9][1]), "v"), (950, None, "v"), (951, [1.0, None], "v"), (952, [float("nan")] * 40, "v"), (953, [float("inf")], "v"), (None, rows[3][1], "v"), (954, [], "v"), (1000, [2.5] * 7, "v")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def brute(rows, k=10):
    import math

    most = (1 << 63) - 1
    good = [(r.vec_id, [max(-most - 1, min(most, math.floor(1024 * x))) for x in r.embedding]) for r in rows if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for n, (q, v) in enumerate(good):
        if q % 100 == 0:
            found = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(v, w)))), i) for m, (i, w) in enumerate(good) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_topk(spark):
    df = vectors(spark)
    expect = brute(df.collect())
    for block in (topk.BLOCK, 3):
        found = topk.top_inner_products(df, F.col("id") % 100 == 0, block=block)
        assert sorted(map(tuple, found.collect())) == expect
    for times in (1e4, 3e6, 1e12, 1e300):  # sums beyond exact doubles, then beyond 64 bits
        large = df.withColumn("embedding", F.transform("embedding", lambda x: x * times)).cache()
        assert sorted(map(tuple, topk.top_inner_products(large, F.col("id") % 100 == 0).collect())) == brute(large.collect())
    assert topk.top_inner_products(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_topk_equals_sql(spark):
    import duckdb

    df = vectors(spark).where("vec_id < 950 or vec_id = 951").repartition(3)  # lists of one length, as the SQL needs
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert sorted(map(tuple, topk.top_inner_products(df, F.col("id") % 100 == 0).collect())) == sorted(con.execute(topk.ORACLE).fetchall())


def test_token_counts(spark, awkward, nothing, data, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet")):
        expect = sorted((str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
        for _ in range(2):  # the second time from the cache
            found = token_counts.cached_counts(docs, WORDS, str(tmp_path / "cache"))
            assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in found.collect()) == expect
    stored = spark.read.parquet(str(tmp_path / "cache"))
    distinct = {r.text or "" for r in awkward.collect()} | {r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert stored.count() == stored.select("digest").distinct().count() == len(distinct)  # only what was missing was added
    assert token_counts.cached_counts(nothing, WORDS, str(tmp_path / "other")).count() == 0
