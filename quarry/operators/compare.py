"""Comparison of two tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each key of either side: state (added, removed, changed, same), and for each column its left and right value,
    delta (four digits) and percent (two digits, null where the left is 0 or either is no number)."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, keys, "full")
    changed = [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    some = changed[0]
    for c in changed[1:]:
        some = some | c
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(some, "changed").otherwise("same")
    out: list[Column] = []
    for c in columns:
        x, y = number(F.col(f"a.{c}")), number(F.col(f"b.{c}"))
        out += [F.col(f"a.{c}").alias(f"left_{c}"), F.col(f"b.{c}").alias(f"right_{c}"), F.round(y - x, 4).alias(f"delta_{c}"), F.round(F.try_divide((y - x) * 100, x), 2).alias(f"percent_{c}")]
    return both.select(*keys, state.alias("state"), *out)


def number(column: Column) -> Column:
    return F.replace(F.replace(column.cast("string"), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def planned_import(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What an import would do to each incoming row: create, update or skip."""
    have = stored.select(*keys, F.struct(*columns).alias("have"))
    new = incoming.select(*keys, *columns, F.struct(*columns).alias("new"))
    action = F.when(F.col("have").isNull(), "create").when(F.col("have").eqNullSafe(F.col("new")), "skip").otherwise("update")
    return new.join(have, keys, "left").select(*keys, *columns, action.alias("action"))


def merged(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with their nulls filled from incoming ones, and incoming rows whose key is new."""
    a = stored.select(*keys, F.struct(*columns).alias("a"))
    b = incoming.select(*keys, F.struct(*columns).alias("b"))
    return a.join(b, keys, "full").select(*keys, *(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns))
