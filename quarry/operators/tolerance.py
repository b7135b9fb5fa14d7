"""One row of what is the same within a tolerance: groups of near values of one kind, with votes.

The rule is a sequence: the first row that is in no group takes all later ones of its kind within the tolerance, and so on. Rows of
equal kind and value end up together, so they are one row each first. Sorted by kind and value, neighbours that are further apart than
the tolerance cut what can meet into stretches, and each stretch runs through the sequence by itself. Rows go by ranges of kind and
value, so a kind that most rows share is spread; of the ranges, a row each (its first and last value) tells how stretches go on.

Defined results: a row without a value (null or 0) or of a negative one that no other equals is a group of its own; of the rows of a
group the one with the highest confidence is shown (null counts as 0), ties to the first; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.shared import cut


def _near(a: float, b: float, tolerance: float) -> bool:
    return abs(a - b) / max(a, b, 1e-9) < tolerance


def _stretches(values: DataFrame, tolerance: float) -> DataFrame:
    """values (kind, value, distinct) with the number of the stretch that each stands in."""
    ranged = cut(values.repartitionByRange("kind", "value").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("kind", "value")
    ends = ranged.groupBy("range").agg(F.max(F.struct("kind", "value")).alias("last"))
    before = ends.select("range", F.lag("last").over(Window.orderBy("range")).alias("ahead"))  # a row for each range
    own = ranged.join(F.broadcast(before), "range").withColumn("prior", F.coalesce(F.lag(F.struct("kind", "value")).over(inside), "ahead"))
    gap = (F.col("value") - F.col("prior.value")) / F.greatest(F.col("value"), F.lit(1e-9))
    begins = F.col("prior").isNull() | ~F.col("kind").eqNullSafe(F.col("prior.kind")) | (gap >= tolerance)
    marked = cut(own.withColumn("begins", begins.cast("long")).withColumn("nth", F.sum(begins.cast("long")).over(inside)))
    counts = marked.groupBy("range").agg(F.sum("begins").alias("n"))
    earlier = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    return marked.join(F.broadcast(earlier), "range").withColumn("stretch", F.col("earlier") + F.col("nth"))


def grouped(values: pd.DataFrame, tolerance: float) -> list[float]:
    """The value of the head of each row's group: rows (value, seq) of one stretch, distinct values."""
    ordered = sorted(values["value"])
    head: dict[float, float] = {}
    for value in values.sort_values("seq")["value"]:
        if value in head:
            continue
        slack = 1 - 2 * tolerance
        low, high = (bisect_left(ordered, value * slack), bisect_right(ordered, value / slack)) if value > 0 else (bisect_left(ordered, value), bisect_right(ordered, value))
        for other in ordered[low:high]:
            if other not in head and _near(value, other, tolerance):
                head[other] = value
        head[value] = value
    return [head[v] for v in values["value"]]


def same_within(rows: DataFrame, kind: str, value: str, seq: str, confidence: str, view: str, tolerance: float = 0.02, boost: float = 0.1) -> DataFrame:
    """kind, seq (of the row that is shown), value, confidence (raised where two or more agree, three digits), views (sorted), votes."""
    sure = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))
    given = rows.select(F.col(kind).alias("kind"), F.nullif(F.col(value).cast("double"), F.lit(0.0)).alias("value"), F.col(seq).alias("seq"), sure.alias("sure"), F.col(confidence).isNull().alias("unsure"), F.col(view).alias("view"))
    best = F.max(F.struct("sure", -F.col("seq"), "value", "unsure")).alias("best")
    alone = F.when(F.col("value").isNull(), F.col("seq"))
    one = cut(given.groupBy("kind", "value", alone.alias("alone")).agg(F.min("seq").alias("seq"), F.count("*").alias("votes"), best, F.collect_set("view").alias("views")))
    found = one.where("value IS NOT NULL").select("kind", "value", "seq")
    placed = _stretches(found, tolerance).select("stretch", "kind", "value", "seq")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": part["kind"], "value": part["value"], "head": grouped(part, tolerance)})

    kind_type = rows.schema[kind].dataType.simpleString()
    heads = placed.groupBy("stretch").applyInPandas(run, f"kind {kind_type}, value double, head double")
    k, v = heads.select(F.col("kind").alias("of"), F.col("value").alias("at"), "head"), F.col("value")
    joined = one.join(k, F.col("kind").eqNullSafe(F.col("of")) & (v == F.col("at")), "left")
    groups = joined.groupBy("kind", "head", "alone").agg(F.sum("votes").alias("votes"), F.max("best").alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("views")))).alias("views"))
    shown = F.when(F.col("best.unsure"), 0.5).otherwise(F.col("best.sure"))
    raised = F.round(F.when(F.col("votes") >= 2, F.least(F.lit(1.0), shown + boost)).otherwise(shown), 3)
    return groups.select("kind", (-F.col("best")["col2"]).alias("seq"), F.col("best.value").alias("value"), raised.alias("confidence"), "views", "votes")
