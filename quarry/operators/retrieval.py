"""Vector search and fusion of ranked branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.sources.shared import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, metric: str = "cosine", threshold: float | None = None, must: Column | None = None) -> DataFrame:
    """The k rows nearest to one query vector, exact: id, score. The filter is applied before the scan of vectors."""
    rows = df if must is None else df.where(must)
    q = F.lit([float(x) for x in query])
    score = {"cosine": cosine, "dot": dot, "euclid": lambda a, b: -euclid(a, b)}[metric](F.col(vector_col), q)
    rows = rows.select(id_col, score.alias("score"))
    rows = rows if threshold is None else rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.col("score").desc(), id_col).limit(k)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the given order, which leaves no ties. Rows go by ranges of the order to partitions;
    one count for each partition is all that one task sees."""
    given = [f"order{i}" for i in range(len(order))]
    keys = [o.alias(g) for o, g in zip(order, given)]
    ranged = cut(df.select("*", *keys).repartitionByRange(*given).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    sizes = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("range").orderBy(*given))
    return ranged.withColumn("inside", inside).join(F.broadcast(sizes), "range").select(*df.columns, (F.col("before") + F.col("inside")).alias(name))


def fused(branches: dict[str, tuple[DataFrame, float]], keys: list[str], k: int = 60, digits: int = 6) -> DataFrame:
    """Weighted reciprocal rank fusion. branches: name to (rows with keys and score, weight). The best score of a key counts in
    each branch; ranks break ties by key. Columns: keys, score (divided by the greatest), branches (sorted names)."""
    parts = []
    for name, (df, weight) in branches.items():
        best = df.groupBy(*keys).agg(F.max("score").alias("score"))
        placed = ranked(best, [-F.col("score"), *(F.col(c) for c in keys)])
        parts.append(placed.select(*keys, F.lit(name).alias("branch"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part")))
    every = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("branch")).alias("branches"))
    every = cut(every)
    most = every.agg(F.max("score").alias("most"))
    return every.join(F.broadcast(most)).withColumn("score", F.round(F.col("score") / F.col("most"), digits)).drop("most")  # one row
