"""The life of rows: visibility, leases, transitions, expiry, retirement, purges, promotion and confirmation."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(scope: Column, owner: Column, department: Column, session: Column, me: dict[str, object]) -> Column:
    """What a reader may see: everything global, and what is of their own, their departments or their session."""
    return reduce(or_, [
        scope == "global", (scope == "owner") & (owner == me["owner"]),
        (scope == "department") & department.isin(list(me["departments"])), (scope == "session") & (session == me["session"]),
    ])


def chosen(values: dict[str, list]) -> Column:
    """Any of the values of a field, for all fields; a field without values allows all."""
    return reduce(and_, (F.col(c).isin(v) for c, v in values.items() if v), F.lit(True))


def known_or_all(column: str, value: str, known: set[str]) -> Column:
    """The filter, or none at all where the value isn't one of the known ones."""
    return F.col(column) == value if value in known else F.lit(True)


def active(now: Column, status: str = "status", expires: str = "expires_at") -> Column:
    return (F.col(status) == "active") & (F.col(expires).isNull() | (F.col(expires) > now))


def with_existing(rows: DataFrame, kind: str, key: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose entity exists in the table of its kind; kinds without a table pass."""
    parts = [rows.where(~F.col(kind).isin(list(tables)) | F.col(kind).isNull())]
    for name, (table, own) in tables.items():
        parts.append(rows.where(F.col(kind) == name).join(table.select(F.col(own).alias("entity key")), F.col(key) == F.col("entity key"), "left_semi"))
    return reduce(DataFrame.unionByName, parts)


def transitions(events: DataFrame, key: str, state: str, order: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Each key's changes of state in order, with `allowed`: whether the map lets the state before lead to it (the first always)."""
    from pyspark.sql import Window as W

    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    moves = [(a, b) for a, own in allowed.items() for b in own]
    fits = reduce(or_, ((F.col("before") == a) & (F.col(state) == b) for a, b in moves), F.lit(False))
    return events.withColumn("before", before).withColumn("allowed", F.col("before").isNull() | fits)


def expired_leases(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """Running jobs whose lease is over: queued again, or failed after `most` attempts; others as they are. Adds next_status."""
    over = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.withColumn("next_status", F.when(over & (F.col("attempts") >= most), "failed").when(over, "queued").otherwise(F.col("status")))


def changed_counts(now: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """Saved queries whose count isn't the stored one: key, n, last_n (null: never run)."""
    joined = now.join(last.withColumnRenamed("n", "last_n"), key, "left")
    return joined.where(~F.col("n").eqNullSafe(F.col("last_n"))).select(key, "n", "last_n")


def retired(rows: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """is_active becomes false where a run's confirmed keys don't hold the row's."""
    seen = confirmed.select(F.col(key).alias("seen")).distinct()
    return rows.join(seen, F.col(key) == F.col("seen"), "left").withColumn("is_active", F.col("is_active") & F.col("seen").isNotNull()).drop("seen")


def to_purge(rows: DataFrame, now: Column, days: int, kept: list[str]) -> DataFrame:
    """Inactive rows older than so many days that are neither pinned nor of a protected kind: what a purge would drop."""
    return rows.where(~F.col("is_active") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days))) & ~F.col("pinned") & ~F.col("kind").isin(kept))


def promotable(rows: DataFrame, known: DataFrame, title: str, text: str) -> DataFrame:
    """Checks before a fact is promoted, and whether all hold: provenance, length, confidence, a title that isn't known yet."""
    checked = rows.withColumns({"has_source": F.col("source_id").isNotNull(), "length_fits": F.length(text).between(20, 4000), "is_sure": F.col("confidence") >= 0.5})
    titles = known.select(F.lower(title).alias("known title")).distinct()
    checked = checked.join(titles, F.lower(title) == F.col("known title"), "left").withColumn("is_new", F.col("known title").isNull()).drop("known title")
    return checked.withColumn("promoted", F.col("has_source") & F.col("length_fits") & F.col("is_sure") & F.col("is_new"))


def confirmed_rules(seen: DataFrame, needed: int, most: int = 20) -> DataFrame:
    """seen: rule, words. Occurrences, the merged sorted words (the first `most`), confidence, and whether the rule is active."""
    words = seen.select("rule", F.explode("words").alias("word")).distinct().groupBy("rule").agg(F.slice(F.array_sort(F.collect_list("word")), 1, most).alias("words"))
    counts = seen.groupBy("rule").agg(F.count("*").alias("occurrences"))
    return counts.join(words, "rule", "left").withColumn("confidence", F.least(F.lit(1.0), F.col("occurrences") / needed)).withColumn("is_active", F.col("occurrences") >= needed)


def agreement(rows: DataFrame, keys: list[str], is_main: Column, mandatory: list[str], fields: list[str], numeric: list[str], threshold: float = 0.95, room: float = 0.01) -> DataFrame:
    """How far the other extractions of a document agree with its main one: keys, score (the share of the main one's fields that all
    others have and agree on), accepted (at least the threshold). A document whose main extraction lacks a mandatory field, or that has
    no other extraction or no field, scores 0. Texts agree without regard to outer blanks, numbers within `room`.

    Each document is a row of least and greatest values: no set of values is kept."""
    own = {f: F.col(f).cast("double") if f in numeric else F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) for f in {*mandatory, *fields}}
    other = lambda c: F.when(~is_main, c)
    sums = [F.count_if(~is_main).alias("others")]
    for f, c in own.items():
        sums += [F.max(F.when(is_main, c)).alias(f"{f} main"), F.count(other(c)).alias(f"{f} n"), F.min(other(c)).alias(f"{f} least"), F.max(other(c)).alias(f"{f} most")]
    found = rows.groupBy(*keys).agg(*sums)

    def agrees(f: str) -> Column:
        main, least, most = (F.col(f"{f} {x}") for x in ("main", "least", "most"))
        near = (F.abs(least - main) < room) & (F.abs(most - main) < room) if f in numeric else (least == main) & (most == main)
        return (main.isNotNull() & (F.col(f"{f} n") == F.col("others")) & near).cast("int")

    n = reduce(lambda a, b: a + b, (F.col(f"{f} main").isNotNull().cast("int") for f in fields))
    whole = reduce(and_, (F.col(f"{f} main").isNotNull() for f in mandatory), F.col("others") > 0)
    share = F.coalesce(F.try_divide(reduce(lambda a, b: a + b, (F.coalesce(agrees(f), F.lit(0)) for f in fields)).cast("double"), n), F.lit(0.0))
    scored = found.select(*keys, F.when(whole, share).otherwise(0.0).alias("score"), (whole & (n > 0)).alias("whole"))
    return scored.select(*keys, "score", (F.col("whole") & (F.col("score") >= threshold)).alias("accepted"))
