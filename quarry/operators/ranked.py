"""Choices and trends by rank within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order, which should end in a unique column."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """previous_<column> of the row before within the key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in columns))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(F.col(column).cast("decimal(18,2)")).over(w).cast("double"))


def trend(change: Column, room: float = 0.05) -> Column:
    """up or down beyond the room, else stable; null where nothing came before."""
    return F.when(change.isNull(), None).when(change > room, "up").when(change < -room, "down").otherwise("stable")


def carried_forward(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value that wasn't null, up to the row."""
    return df.withColumn(name, F.last(column, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def best_with_margin(df: DataFrame, keys: list[str], candidate: str, score: str) -> DataFrame:
    """The best candidate of each key and its lead over the next distinct one (null if it is alone)."""
    best = df.groupBy(*keys, candidate).agg(F.max(score).alias(score))
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), candidate)
    ranked = best.select("*", F.row_number().over(w).alias("_rank"), (F.col(score) - F.lead(score).over(w)).alias("margin"))
    return ranked.where("_rank = 1").drop("_rank")


def nearest_rank(values: Column, p: float) -> Column:
    """The value at round(p * (n - 1)), halves to even, of an array."""
    return F.element_at(F.sort_array(values), (F.bround(p * (F.size(values) - 1), 0) + 1).cast("int"))
