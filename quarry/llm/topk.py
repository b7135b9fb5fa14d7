"""Exact search for the highest inner products, by columnar branch and bound.

Each batch of vectors is turned so that a dimension's values lie together. Queries come in blocks of at most BLOCK rows, the only
thing that is broadcast. For a query, scores are summed over a few dimensions at a time; with the length of what remains of both
sides, they bound the whole score from both ends. Vectors whose upper bound is below the tenth best lower bound (or the tenth best
found so far in the task) are dropped and the rest packed together before the next dimensions. Each task returns at most k rows a
query, and a window takes the best of all tasks.

Components are floor(scale * x), in 64-bit integers. Partial scores are floating-point, with bounds widened by more than their
rounding errors; the few vectors that are left are scored in exact integers, whatever the components' size.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count as padded with
zeros; rows with a null id are no queries and no candidates; every row is a vector of its own: rows that repeat a query's id are
queries each, and candidates of each other; ties go to the smaller id; components and scores beyond 64 bits stop at the largest
or smallest such number (and then count as equal); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import saved

BLOCK, STEP = 4096, 16
SCHEMA = "query long, query_id long, vec_id long, score long"
MOST = (1 << 63) - 1


def prepared(df: DataFrame, id_col: str, vector_col: str, scale: float = 1024.0) -> DataFrame:
    """Columns n (the row's number), id and v (whole numbers) of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _columns(lists: pa.ListArray, dims: int) -> np.ndarray:
    """dims rows, a column for each vector."""
    flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dims).all():
        return np.ascontiguousarray(flat.reshape(-1, dims).T)
    out = np.zeros((max(dims, sizes.max(initial=0)), len(sizes)), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[: b - a, i] = flat[a:b]
    return out


def _exact(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Whole inner products; most: a bound of their size."""
    if most < 2.0**62:
        return q @ x
    return np.array([max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(q.tolist(), c)))) for c in x.T.tolist()], object)


def search(queries: np.ndarray, vectors: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, list]]:
    """queries: row numbers; vectors: dims rows, a column for each query; batches: row numbers, ids and vectors likewise. Yields
    each query's place and its best (score, id), at most k, the best first."""
    found: list[list[tuple[int, int]]] = [[] for _ in queries]
    for rows, ids, x in batches:
        if not len(ids):
            continue
        dims = max(len(x), len(vectors))
        x, q = (np.vstack([m, np.zeros((dims - len(m), m.shape[1]), np.int64)]) for m in (x, vectors))
        xf, qf = x.astype(float), q.astype(float)
        order = np.argsort(-(xf**2).sum(1), kind="stable")
        x, q, xf, qf = x[order], q[order], xf[order], qf[order]
        most = dims * float(np.abs(xf).max(initial=0)) * float(np.abs(qf).max(initial=0))
        # lengths of what remains after each step, and what rounding may come to
        left_x = np.sqrt(np.cumsum((xf**2)[::-1], 0)[::-1])
        left_q = np.sqrt(np.cumsum((qf**2)[::-1], 0)[::-1])
        slack = left_q[0] * 4 * dims * 2.0**-52 if dims else np.zeros(q.shape[1])
        for j, query in enumerate(queries):
            alive = np.flatnonzero(rows != query)
            best = found[j]
            floor = float(best[-1][0]) if len(best) == k else -np.inf
            partial = np.zeros(len(alive))
            for s in range(0, dims, STEP):
                part = xf[s : s + STEP] if len(alive) == xf.shape[1] else xf[s : s + STEP, alive]
                partial = partial + qf[s : s + STEP, j] @ part
                error = slack[j] * left_x[0, alive] + 1e-6
                room = error + (left_q[s + STEP, j] * left_x[s + STEP, alive] * (1 + 1e-9) if s + STEP < dims else 0)
                if len(alive) > k:
                    floor = max(floor, np.partition(partial - room, len(alive) - k)[len(alive) - k])
                # beyond 64 bits all scores are equal
                keep = (partial + room >= min(floor - abs(floor) * 1e-15, 2.0**63 - 4096)) | (floor <= 4096 - 2.0**63)
                alive, partial = alive[keep], partial[keep]
            scores = _exact(q[:, j], x[:, alive], most).tolist()
            found[j] = sorted([*best, *zip(scores, ids[alive].tolist())], key=lambda p: (-p[0], p[1]))[:k]
    yield from enumerate(found)


def top_inner_products(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score. is_query: a condition on the column id."""
    spark = df.sparkSession
    vectors = saved(prepared(df, id_col, vector_col, scale), "vectors")
    queries = saved(vectors.where(is_query), "queries")
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).orderBy("n").collect()  # about `block` rows
        if not rows and found is not None:
            continue
        dims = max([1, *(len(r.v) for r in rows)])
        n, ids = np.array([r.n for r in rows], np.int64), [r.id for r in rows]
        q = np.array([[*r.v, *[0] * (dims - len(r.v))] for r in rows], np.int64).reshape(-1, dims).T
        sent = spark.sparkContext.broadcast((n, ids, q))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            n, ids, q = sent.value
            each = ((b.column("n").to_numpy(), b.column("id").to_numpy(), _columns(b.column("v"), len(q))) for b in batches)
            for j, best in search(n, q, each, k):
                columns = [[int(n[j])] * len(best), [ids[j]] * len(best), [i for _, i in best], [s for s, _ in best]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

        part = vectors.mapInArrow(run, SCHEMA)
        part = saved(part, "block") if blocks > 1 else part
        found = part if found is None else found.unionAll(part)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every row is a vector of its own, as above.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
