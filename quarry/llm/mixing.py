"""Mixing of sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis), in DataFrame functions.

Sources, ordered by code point with null last, have the weights 3, 1, 2, repeating, and share `share` times all words. A source's
target stops at `most` times its size; what is cut is shared by weight among the others until none is above: each target is
least(most * size, level * weight) for one level, found from the sources ordered by size over weight.

Each document draws an exponential key, -ln(u) / quality, with u from MD5 of its id (of its text, if it has none) and the seed.
Quality, unless the caller names a column of weights, is the share of distinct words (1 for no words), a stand-in that falls with
length and repetition. Smaller keys come first. A source's target is met by complete epochs, then by its documents in key order
until the rest of its words is used up. The last one is cut there, or, with whole_documents=True, taken if at least half fits.

What stands before a document in its source is a prefix sum over ranges of (source, key), as many as Spark makes of them, so that
one source that holds most rows is spread over all tasks whatever its keys are. The targets' sums over sources are made in the
same way. Only slim rows are sorted; the columns carried join them by row number at the end.

Defined results: null text has size 0, takes nothing; null sources form one source; equal keys are ordered by id, then size; rows
that repeat share a key and stand next to each other; weights that are null or not above 0 count as 1; an empty table gives an
empty result; the input's columns are carried inside one struct, so that clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, prefix_sums, saved, whole

WEIGHTS = (3, 1, 2)


def words_of(text_col: str) -> Column:
    return F.regexp_extract_all(whole(text_col), F.lit(f"({WORD})"))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: columns source, source_size, a row each. Adds target and the whole number of words to take, budget."""
    placed = prefix_sums(sizes, [F.col("source")], {"place": F.lit(1), "start": F.col("source_size")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    placed = placed.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = prefix_sums(placed, [F.col("ratio"), F.col("source")], {"capped": F.col("cap"), "passed": F.col("weight")})
    words, weight_of_all = placed.agg(F.sum("source_size"), F.sum("weight")).first()  # one row of totals
    # the level: of all sources that the sources before them, filled up, leave room for, the highest
    level = (F.lit(float((words or 0) * share)) - F.col("capped")) / (F.lit(weight_of_all or 0) - F.col("passed"))
    highest = up.withColumn("level", level).agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level")))).first()[0]
    return placed.withColumn("target", F.least("cap", F.lit(highest).cast("double") * F.col("weight"))).select(
        "source", "source_size", "start", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget")
    )


def mix(
    df: DataFrame, carry: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    seed: int = 7, share: float = 1.5, most: float = 2.0, whole_documents: bool = False, quality_col: str | None = None,
) -> DataFrame:
    """Columns row (a struct of the columns `carry`), source, size, source_size, target, taken (words, repeats counted)."""
    words = words_of(text_col)
    own = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), own)), 1, 13), 16, 10)
    weight = F.lit(None) if quality_col is None else F.when(F.col(quality_col) > 0, F.col(quality_col).cast("double")).otherwise(1.0)
    given = ("source", "id", "size", "key")
    docs = (
        df.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("words"), drawn.cast("long").alias("drawn"), weight.alias("weight"))
        .withColumn("size", F.size("words").cast("long"))
        .withColumn("quality", F.coalesce("weight", F.when(F.col("size") == 0, 1.0).otherwise(F.size(F.array_distinct("words")) / F.col("size"))))
        .withColumn("key", -F.log((F.col("drawn") + 0.5) / F.lit(float(1 << 52))) / F.col("quality"))
        .select("row", F.monotonically_increasing_id().alias("n"), *given)
    )
    docs = saved(docs, "mix")
    plan = saved(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "targets")
    # rows without words take nothing and stand before nobody: they need no place
    placed = prefix_sums(docs.where("size > 0").select("n", *given), [F.col(c) for c in ("source", "key", "id", "size")], {"before": F.col("size")})
    epochs = F.floor(F.coalesce(F.expr("try_divide(budget, source_size)"), F.lit(0.0))).cast("long")
    room = F.col("rest") - (F.col("before") - F.col("start"))
    more = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole_documents else F.greatest(F.lit(0), F.least("size", room))
    taken = (
        placed.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .select("n", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))
    )
    return (
        docs.select("row", "n", "source", "size").join(taken, "n", "left")
        .join(plan.select(F.col("source").alias("of"), "source_size", "target"), F.col("source").eqNullSafe(F.col("of")))
        .select("row", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


#: The same in SQL: the order of a source's documents by one window, its targets by the same level.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13))::BIGINT AS drawn
  FROM documents),
e AS (
  SELECT doc_id, source, len(words)::BIGINT AS size,
         -ln((drawn + 0.5) / 4503599627370496.0::DOUBLE) / CASE WHEN len(words) = 0 THEN 1.0::DOUBLE ELSE len(list_distinct(words))::DOUBLE / len(words) END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM l),
b AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target + 0.5) / source_size) END::BIGINT AS epochs
  FROM t),
o AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM e)
SELECT o.doc_id, o.size, b.source_size, b.target,
       (b.epochs * o.size + greatest(0, least(o.size, b.budget - b.epochs * b.source_size - o.before)))::BIGINT AS taken
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source
"""
