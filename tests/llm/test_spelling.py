"""Words, near words, forms and roots equal a plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import duckdb

from quarry.llm.queries import QUERIES
from quarry.llm.spelling import ORACLE, variants, word_counts


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, least_chars=5, least_n=3):
    found = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least_n}


def plain_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def got(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_small_alphabets(spark):
    rng = random.Random(1)
    n = {"".join(rng.choice("abà") for _ in range(rng.randint(1, 5))): rng.choice([1, 1, 2, 3, 4, 8, 8, 16, 40]) for _ in range(220)}
    assert got(variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_runs_chains_ties_and_repeats(spark):
    n = {"aaaa": 1, "aaaaa": 2, "aaaaaa": 4, "aaaaaaa": 8, "aaaaaaab": 16, "baaaaaab": 32, "zab": 5, "yab": 5, "xab": 2, "b" * 5000: 1, "b" * 5001: 9}
    rows = [(w, k) for w, k in n.items()] + [(None, 3), ("none", None), ("zero", 0)]
    rows = [r for r in rows if r[0] != "zab"] + [("zab", 2), ("zab", 3)]  # given twice: summed
    assert got(variants(spark.createDataFrame(rows, "word string, n long"))) == plain_variants(n)


def test_one_word_with_a_third_of_all_neighbours(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    n = {"kernel": 1000} | {"kernel"[:i] + c + "kernel"[i:]: 3 for i in range(7) for c in letters} | {"kernel"[:i] + c + "kernel"[i + 1 :]: 3 for i in range(6) for c in letters}
    n["kernel"] = 1000
    assert got(variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == plain_variants(n)


def test_awkward_documents(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    counts = plain_counts(rows, 3, 2)
    found = word_counts(awkward, least_chars=3, least_n=2)
    assert {tuple(r) for r in found.collect()} == set(counts.items())
    assert got(variants(found)) == plain_variants(counts)
    assert variants(word_counts(nothing)).count() == 0


def test_counts_are_sent_on(spark, awkward, monkeypatch):
    from quarry.llm import spelling

    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    monkeypatch.setattr(spelling, "MOST_WORDS", 7)
    assert {tuple(r) for r in spelling.word_counts(awkward).collect()} == set(plain_counts(rows).items())


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(QUERIES["op11_spelling"](spark, data)) == plain_variants(n)


def test_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got(QUERIES["op11_spelling"](spark, data)) == set(con.execute(ORACLE).fetchall())
