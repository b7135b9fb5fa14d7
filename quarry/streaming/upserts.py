"""Sinks of streams: a table that batches are merged into by key, and messages routed to whom they concern. Both are idempotent by the
number of the batch, so a batch that is run again after a failure, in part or whole, changes nothing.

A keyed table is a folder of data, dealt by a hash of the key into buckets, and of commits. A batch reads and writes anew only the
buckets that its keys fall into, as a generation of its own; its commit, a row for each bucket with the generation that holds it,
makes this the table. Readers see whole commits alone; a generation without a commit is written over when its batch is run again.

Defined results: the row with the greatest order value of a key stays (equal ones: the later batch's, then the greatest by all
columns); a row marked as deleted removes its key, and stays as a mark in the data so that older rows which come late do not bring it
back; rows whose key or order value is null are left out; an empty batch commits and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.shared import exists


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: str
    deleted: str | None = None  # a boolean column
    buckets: int = 16

    def _committed(self) -> DataFrame | None:
        """bucket, generation of the last commit."""
        path = f"{self.folder}/commits"
        if not exists(self.spark, path):
            return None
        every = self.spark.read.schema("bucket int, generation long, batch long").option("recursiveFileLookup", "true").parquet(path)
        last = every.agg(F.max("batch")).first()[0]
        return None if last is None else every.where(F.col("batch") == last)

    def _done(self, batch: int) -> bool:
        return exists(self.spark, f"{self.folder}/commits/{batch:012d}/_SUCCESS")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: list[tuple[int, int]]) -> DataFrame:
        """The rows of buckets in their generations, marks of deleted keys included."""
        paths = [f"{self.folder}/data/{generation:012d}/bucket={bucket}" for bucket, generation in held]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The table as of the last commit."""
        commit = self._committed()
        rows = self._rows([] if commit is None else [(r.bucket, r.generation) for r in commit.collect()])  # a row of each bucket
        return rows if self.deleted is None else rows.where(~F.coalesce(F.col(self.deleted), F.lit(False)))

    def merge(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch: merges rows by key, once for each batch number."""
        if self._done(batch):
            return
        commit = self._committed()
        held = {} if commit is None else {r.bucket: r.generation for r in commit.collect()}
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).where(F.col(self.order).isNotNull())
        for k in self.keys:
            new = new.where(F.col(k).isNotNull())
        new = new.withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = self._rows([(b, held[b]) for b in touched if b in held])
        both = old.withColumn("bucket", self._bucket()).withColumn("later", F.lit(0)).unionByName(new.withColumn("later", F.lit(1)))
        row = F.struct(*self.schema.names)
        comparable = F.struct(F.col(self.order), F.col("later"), F.to_json(row))
        newest = both.groupBy("bucket", *(F.col(k).alias(f"key {k}") for k in self.keys)).agg(F.max_by(row, comparable).alias("row"))
        if touched:
            newest.select("bucket", "row.*").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{batch:012d}")
        held |= dict.fromkeys(touched, batch)
        done = self.spark.createDataFrame([(b, g, batch) for b, g in sorted(held.items())], "bucket int, generation long, batch long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch:012d}")

    def sink(self, stream: DataFrame, checkpoint: str):
        """Starts a query that merges a stream's batches."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.merge(rows, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vectors_of(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has the table's size and finite components; the others are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size(vector) == size) & fine)


#: Messages of this channel go to every subscriber.
EVERYONE = "*"


def routed(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """messages (channel, ...) with a column subscriber, a row for each subscriber (subscriptions: channel, subscriber) that hears the
    channel; each hears a message once. A join by channel: everyone's channel is one that every subscriber hears."""
    hears = subscriptions.select("channel", "subscriber").where("subscriber IS NOT NULL")
    hears = hears.where(F.col("channel").isNotNull()).unionAll(hears.select(F.lit(EVERYONE).alias("channel"), "subscriber")).distinct()
    return messages.join(hears, "channel")


def heard(messages: DataFrame, subscriptions: DataFrame, *sums: Column) -> DataFrame:
    """subscriber, channel and sums (aggregates) of the messages that each subscriber hears on each channel. All who hear a channel hear
    the same, so it is summed up once and the sums are routed: rows for each subscription, however many messages there are."""
    summed = messages.groupBy("channel").agg(*sums)
    return routed(summed, subscriptions).select("subscriber", *summed.columns)


def route_sink(stream: DataFrame, subscriptions: DataFrame, path: str, checkpoint: str, parts: int = 16):
    """Starts a query that writes each batch's messages under its number, in folders by a hash of the subscriber."""

    def write(rows: DataFrame, batch: int) -> None:
        mine = routed(rows, subscriptions).withColumn("part", F.pmod(F.xxhash64("subscriber"), F.lit(parts)))
        mine.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
