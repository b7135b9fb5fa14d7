"""Searches with several branches, and paths along edges."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expanded(items: DataFrame, words: list[str], text_cols: list[str], key: str, most: int = 200) -> DataFrame:
    """Keys of the items that hold every word in one of the columns, the first `most` by key."""
    holds = [reduce(or_, (F.col(c).ilike(f"%{w}%") for c in text_cols)) for w in words]
    return items.where(reduce(and_, holds)).select(key).orderBy(key).limit(most)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


def document_search(docs: DataFrame, key: str, text: str, terms: list[str], most: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Free-text search by BM25: key, score (6 digits), the `most` best, ties to the smaller key. Counts of terms, lengths and the
    number of documents that hold a term are made in one pass over the texts, whose result is a slim row for each document."""
    words = docs.select(key, words_of(F.col(text)).alias("words"))
    is_term = lambda t: lambda w: w == t
    hits = [F.size(F.filter("words", is_term(t))) for t in terms]
    slim = words.select(key, F.size("words").alias("length"), *(h.alias(f"tf{i}") for i, h in enumerate(hits)))
    totals = slim.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    weigh = [
        F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1)
        / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        for i in range(len(terms))
    ]
    found = slim.where(reduce(or_, (F.col(f"tf{i}") > 0 for i in range(len(terms))))).join(F.broadcast(totals))  # one row of totals
    return found.select(key, F.round(sum(weigh, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), key).limit(most)


def merged_hits(hits: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Hits of several branches as one row for each key: the highest score, the sorted branches, and each part that a branch gave."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("branch")).alias("branches"), *(F.max(p).alias(p) for p in parts))


def within_budget(branches: list[tuple[str, DataFrame]], key: str, order: list[Column], budget: int) -> DataFrame:
    """Branches that share a budget of rows: each takes the best of what the ones before it left. Columns branch, key."""
    part = [df.orderBy(*order).limit(budget).select(F.lit(i).alias("b"), F.lit(name).alias("branch"), key, *(o.alias(f"o{j}") for j, o in enumerate(order))) for i, (name, df) in enumerate(branches)]
    every = reduce(DataFrame.unionAll, part)  # budget rows a branch at most
    up = [F.col(f"o{j}").asc() for j in range(len(order))]
    return every.withColumn("place", F.row_number().over(W.orderBy("b", *up))).where(F.col("place") <= budget).select("branch", key)


def reached(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """Nodes that directed edges (source, target) lead to from the starts (node): node, depth, path (the smallest of the shortest)."""
    front = starts.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    seen = front
    for depth in range(1, steps + 1):
        new = front.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        new = new.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti")
        front = new.select("node", F.lit(depth).alias("depth"), "path")
        seen = seen.unionByName(front)
    return seen
