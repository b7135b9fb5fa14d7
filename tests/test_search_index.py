"""The stored index against a scan of all texts, and the forms of words."""

import math
import random
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import stems
from quarry.operators import search_index
from quarry.operators.search_index import SearchIndex, ranked_documents
from quarry.sources.shared import shared_path


def scan(docs, terms, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    found = {}
    for i, own in words.items():
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in terms if t in own)
        if score:
            found[i] = round(score, 6)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]


def some_docs(n, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    return [(seed * 100_000 + i, " ".join(rng.choices(common, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(0, 40)))) for i in range(n)] + [(seed * 100_000 + n, None), (seed * 100_000 + n + 1, "")]


def test_segments_and_skipped_blocks(spark):
    first, second = some_docs(3000, 1), some_docs(900, 2)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = SearchIndex(spark, shared_path(spark, "test-index"))
    index.add(frame(first), "id", "text", "a")
    files = lambda: {r[0] for r in spark.read.parquet(f"{index.folder}/postings/segment=a").select(F.input_file_name()).distinct().collect()}
    before = files()
    assert [tuple(r) for r in index.search("w3 w39", 10).collect()] == scan(first, ["w3", "w39"], 10)
    for _ in range(2):  # a segment that is added again under its name counts once
        index.add(frame(second), "id", "text", "b")
    assert files() == before
    for query in ("w0", "w3 w39", "W30 w31 w32", "w1 w2 w3 w4 w5"):
        assert [tuple(r) for r in index.search(query, 15).collect()] == scan(first + second, query.lower().split(), 15), query
    read, there = index.blocks_read("w0", 10)
    assert read < there
    assert index.search(" ?!", 5).count() == 0 and index.search("absent", 5).count() == 0
    both = {r.doc for r in index.search("w10 w20", None, every=True).collect()}
    assert both == {i for i, t in first + second if t and {"w10", "w20"} <= set(t.split())}


def test_only_the_terms_are_read(spark):
    index = SearchIndex(spark, shared_path(spark, "test-index"))
    index.add(spark.createDataFrame(some_docs(200, 3), "id long, text string"), "id", "text", "a")
    plan = index.postings(["w5"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_ranked_documents(spark):
    docs = [(1, "bolts and rings", "bolt"), (2, "rings", "bolts m8"), (3, "nothing", "other"), (4, None, None), (5, "болты и гайки", "крепёж")]
    table = spark.createDataFrame(docs, "id long, text string, name string")
    index = SearchIndex(spark, shared_path(spark, "test-index"))
    index.add(table, "id", "text", "a")
    assert [r.id for r in ranked_documents(index, table, "id", ["name"], "bolts").collect()] == [1, 2]
    assert [r.id for r in ranked_documents(index, table, "id", ["name"], "болтами").collect()] == [5]


def test_forms_of_words(spark):
    rows = [("суммой", "сумме", True), ("остатка", "остаток", True), ("сумма", "сумка", False), ("номер", "номенклатура", False), ("фрезы", "фрезами", True), ("bolt", "bolts", False), ("да", "да", True)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean").select("same", stems.same_word(F.col("a"), F.col("b")).alias("got"), (stems.term_key(F.col("a")) == stems.term_key(F.col("b"))).alias("key")).collect()
    assert all(r.same == r.got == r.key for r in got)
    phrases = [("номер счёта".replace("ё", "е"), "номера счета", True), ("номер", "номер счета", False)]
    got = spark.createDataFrame(phrases, "a string, b string, same boolean").select("same", stems.same_phrase(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.same == r.got for r in got)


def test_adding_shuffles_nothing(spark):
    """The disk holds an index, not its postings several times over."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    docs = spark.createDataFrame(some_docs(3000, 4), "id long, text string").repartition(3).localCheckpoint()
    before, index = files(), SearchIndex(spark, shared_path(spark, "test-index"))
    index.add(docs, "id", "text", "a")
    assert not files() - before


def test_words_of_odd_texts(spark):
    """Postings equal words and keys by Column expressions, for keys that are texts too."""
    texts = ["", None, " ", "!?", "ЁЖ ежи ёжик", "İstanbul ΟΔΟΣ straße", "a_b c-d e\u00adf g\u0301h", "\U0001d4b3x 漢字 ٣٤ Ⅷ ½", "остаток остатка, остатки", "a" * 500, "x " * 700, "tab\tnew\nline\u2028end"]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, text string")
    words = docs.select("id", F.explode(search_index.words_of(F.col("text"))).alias("w")).withColumn("length", F.count("*").over(Window.partitionBy("id")))
    expected = {tuple(r) for r in words.groupBy("id", stems.term_key(F.col("w")).alias("term"), "length").count().collect()}
    index = SearchIndex(spark, shared_path(spark, "test-index"))
    index.add(docs, "id", "text", "a")
    got = index.postings(sorted({t for _, t, _, _ in expected})).select("term", F.explode("docs").alias("d")).select("d.doc", "term", "d.length", "d.count")
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    n, mean = index._sizes(index._table())
    assert n == len(texts) and round(n * mean) == words.count()


def test_chunks(monkeypatch):
    """Each document's words are in one chunk, blocks are whole, and say what is in them."""
    monkeypatch.setattr(search_index, "CHUNK", 1000)
    docs = [(i, t or "") for i, t in some_docs(600, 5)] + [(1, "w0 " * 200)]
    batches = [pa.RecordBatch.from_pydict({"doc": [i for i, _ in docs[a : a + 50]], "words": [t.strip() for _, t in docs[a : a + 50]]}) for a in range(0, len(docs), 50)]
    chunks = [b.to_pylist() for b in search_index._inverted(iter(batches))]
    assert len(chunks) > 3
    rows = [r for c in chunks for r in c]
    sizes = [r for r in rows if r["term"] == ""]
    assert len(sizes) == len(chunks) and sum(r["n"] for r in sizes) == len(docs) and sum(r["words"] for r in sizes) == sum(len(t.split()) for _, t in docs)
    held = {(d, r["term"]): (c, n) for r in rows for d, c, n in zip(r["docs"], r["counts"], r["lengths"])}
    assert held == {(i, w): (t.split().count(w), len(t.split())) for i, t in docs for w in t.split()}
    for r in rows:
        if r["term"]:
            assert len(r["docs"]) == r["n"] <= search_index.BLOCK and r["most"] == max(r["counts"]) and r["shortest"] == min(r["lengths"])


def test_keys_of_arrow_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("абвгдеиоуыэюяйьмхbolt1é漢", k=rng.randint(1, 8))) + rng.choice(("", *stems.ENDINGS)) for _ in range(5000)] + ["ёлка", "ещё"]
    expected = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(stems.term_key(F.col("w"))).collect()]
    assert stems.term_keys(pa.array(words)).to_pylist() == expected
