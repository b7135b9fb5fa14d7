"""Keyed tables and routes: batches run again, late rows, deleted keys, streams that stop and go on."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.shared import shared_path
from quarry.streaming.upserts import KeyedTable, heard, route_sink, routed, vectors_of

SCHEMA = "k string, v long, at long, gone boolean"


def rows_of(table):
    return sorted((r.k, r.v) for r in table.read().collect())


@pytest.fixture
def table(spark):
    return KeyedTable(spark, shared_path(spark, "table"), spark.createDataFrame([], SCHEMA).schema, ("k",), "at", "gone", buckets=4)


def test_merges(spark, table):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert rows_of(table) == []
    table.merge(frame([("a", 1, 1, False), ("b", 2, 1, None), ("a", 3, 2, False), (None, 9, 9, False), ("x", 9, None, False)]), 0)
    assert rows_of(table) == [("a", 3), ("b", 2)]
    table.merge(frame([("a", 99, 99, False)]), 0)  # that batch is done
    assert rows_of(table) == [("a", 3), ("b", 2)]
    table.merge(frame([("a", 4, 1, False), ("b", 5, 1, False), ("c", 6, 1, False)]), 1)  # late for a, as old for b
    assert rows_of(table) == [("a", 3), ("b", 5), ("c", 6)]
    table.merge(frame([("c", 0, 5, True)]), 2)
    table.merge(frame([("c", 7, 4, False)]), 3)  # older than its removal
    assert rows_of(table) == [("a", 3), ("b", 5)]
    table.merge(frame([("c", 8, 6, False)]), 4)
    table.merge(frame([]), 5)
    assert rows_of(table) == [("a", 3), ("b", 5), ("c", 8)]


def test_a_batch_that_failed_before_its_commit(spark, table):
    from quarry.sources.shared import removed

    table.merge(spark.createDataFrame([("a", 1, 1, False)], SCHEMA), 0)
    table.merge(spark.createDataFrame([("a", 2, 2, False), ("b", 1, 1, False)], SCHEMA), 1)
    removed(spark, f"{table.folder}/commits/{1:012d}")  # as if it had stopped after its data
    assert rows_of(table) == [("a", 1)]
    table.merge(spark.createDataFrame([("a", 2, 2, False), ("b", 1, 1, False)], SCHEMA), 1)
    assert rows_of(table) == [("a", 2), ("b", 1)]


def test_only_touched_buckets_are_written(spark, table):
    table.merge(spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.lit(1).cast("long").alias("at"), F.lit(False).alias("gone")), 0)
    table.merge(spark.createDataFrame([("7", 70, 2, False)], SCHEMA), 1)
    last = table._committed().collect()
    assert sorted(r.generation for r in last) == [0, 0, 0, 1] and table.read().count() == 40


def test_streams(spark, table, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", i, i, False), (str(i), i, 1, False)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        table.sink(stream, str(tmp_path / "c1")).awaitTermination()
        assert rows_of(table) == [("0", 0), ("1", 1), ("2", 2), ("a", 2)]
    hears = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("1", "s2"), (None, "s3"), ("2", None)], "channel string, subscriber string")
    for _ in range(2):
        route_sink(stream.withColumnRenamed("k", "channel"), hears, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert sorted((r.subscriber, r.channel, r.v) for r in got.collect()) == [("s1", "a", 0), ("s1", "a", 1), ("s1", "a", 2), ("s2", "1", 1)]
    everyone = routed(spark.createDataFrame([("*", 1)], "channel string, v long"), hears)
    assert sorted(r.subscriber for r in everyone.collect()) == ["s1", "s2", "s3"]


def test_heard_is_summed_before_it_is_routed(spark):
    """Few subscribers or many: what is joined with them is a row for each channel."""
    hears = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1"), (None, "s3")], "channel string, subscriber string")
    said = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("*", 3), (None, 9), ("c", 4)], "channel string, v long")
    sums = F.count("*").alias("n"), F.max("v").alias("last")
    got = heard(said, hears, *sums)
    plain = routed(said, hears).groupBy("subscriber", "channel").agg(*sums)
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, got.collect())) == [("s1", "*", 1, 3), ("s1", "a", 2, 5), ("s1", "b", 1, 2), ("s2", "*", 1, 3), ("s2", "a", 2, 5), ("s3", "*", 1, 3)]


def test_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, None)]
    assert [r.id for r in vectors_of(spark.createDataFrame(rows, "id long, v array<double>"), "v", 2).collect()] == [1]
