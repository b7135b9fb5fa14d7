"""Detectors over the history of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def duplicates(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Rows that share all keys with another row; copies: how many there are."""
    few = df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.join(few, keys).select(id_col, *keys, "copies")


def first_timers(df: DataFrame, party: str, id_col: str) -> DataFrame:
    """Rows of parties that have one row only."""
    one = df.groupBy(party).agg(F.count("*").alias("n"), F.min(id_col).alias(id_col)).where("n = 1")
    return one.select(id_col, party)


def price_spikes(df: DataFrame, item: str, order: list[str], price: str, percent: float = 20.0) -> DataFrame:
    """Rows whose price rose by more than `percent` over the price before it of the same item: old_price, change (one digit)."""
    old = F.lag(price).over(W.partitionBy(item).orderBy(*order))
    change = F.round(F.try_divide((F.col(price) - F.col("old_price")) * 100, F.col("old_price")), 1)
    return df.withColumn("old_price", old).withColumn("change", change).where(F.col("change") > percent)


def changed_fields(df: DataFrame, party: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows in which a field that was filled before has another value than in the party's row before it."""
    w = W.partitionBy(party).orderBy(*order)
    flags = F.array(*(F.when(F.col(c).isNotNull() & (F.lag(c).over(w) != F.col(c)), c) for c in columns))
    return df.withColumn("changed", F.filter(flags, lambda x: x.isNotNull())).where(F.size("changed") > 0)


def trust(completeness: Column, n: Column, approval: Column, stability: Column) -> Column:
    """0.2 completeness + 0.3 of ten documents + 0.3 approval (0.5 if unknown) + 0.2 stability (0.8 if unknown), three digits."""
    score = 0.2 * completeness + 0.3 * F.least(n / 10.0, F.lit(1.0)) + 0.3 * F.coalesce(approval, F.lit(0.5)) + 0.2 * F.coalesce(stability, F.lit(0.8))
    return F.round(score, 3)


def party_duplicates(df: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """Groups of rows that agree on a key, by the first key (in order) that finds another row; id, by, group (its smallest id).
    No pairs are made: a group is its smallest id, however many rows it has."""
    left, out = df.select(id_col, *(c.alias(f"key_{k}") for k, c in keys.items())), None
    for k in keys:
        filled = left.where(F.col(f"key_{k}").isNotNull() & (F.col(f"key_{k}") != ""))
        groups = filled.groupBy(f"key_{k}").agg(F.count("*").alias("n"), F.min(id_col).alias("group")).where("n > 1")
        found = filled.join(groups, f"key_{k}").select(id_col, F.lit(k).alias("by"), "group")
        out = found if out is None else out.unionAll(found)
        left = left.join(found.select(id_col), id_col, "left_anti")
    return out


def first_rule(df: DataFrame, rules: DataFrame, id_col: str, matches: Column, order: list[str]) -> DataFrame:
    """Each row with the first active rule (a small table of settings) that matches: id_col, rule_id."""
    w = W.partitionBy(id_col).orderBy(*order)
    found = df.join(rules.where("active"), matches).withColumn("_rank", F.row_number().over(w))
    return found.where("_rank = 1").select(id_col, "rule_id")


def stock_check(bom: DataFrame, stock: DataFrame, batch: float = 1.0) -> DataFrame:
    """bom: product, item, qty; stock: item, available. required, shortage (null where the item is unknown), can_produce of the product."""
    joined = bom.join(stock, "item", "left").withColumn("required", F.col("qty") * batch)
    short = F.when(F.col("available").isNotNull(), F.greatest(F.lit(0.0), F.col("required") - F.col("available")))
    joined = joined.withColumn("shortage", short)
    able = joined.groupBy("product").agg(F.bool_and(F.coalesce(F.col("shortage") == 0, F.lit(False))).alias("can_produce"))
    return joined.join(able, "product").select("product", "item", "required", "available", "shortage", "can_produce")
