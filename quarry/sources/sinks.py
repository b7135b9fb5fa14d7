"""Sinks: delimited files with a byte-order mark, nested XML, calendars, append-only tables without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, labels: dict[str, str] | None = None) -> None:
    """Semicolons, a header of labels, and a byte-order mark before each file's header, written by the executors."""
    named = df.select(*(F.col(c).cast("string").alias((labels or {}).get(c, c)) for c in df.columns))
    named = named.withColumnRenamed(named.columns[0], "﻿" + named.columns[0])
    named.write.mode("overwrite").csv(path, sep=";", header=True)


def write_xml(df: DataFrame, path: str, row: str = "Document", root: str = "Documents") -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", root).save(path)


def nested_documents(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One record for each order with its lines in order: Number, Date, Sum, Items.Item(Name, Quantity, Price)."""
    entry = F.struct(
        F.col("l_linenumber").alias("Line"), F.col("p_name").alias("Name"), F.format_string("%.3f", "l_quantity").alias("Quantity"), F.format_string("%.2f", "l_extendedprice").alias("Amount")
    )
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("Item"))
    joined = orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("Number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.format_string("%.2f", "o_totalprice").alias("Sum"), F.struct("Item").alias("Items")
    )


def calendar_lines(df: DataFrame, uid: str, at: str, title: str) -> DataFrame:
    """A column value: one calendar event for each row."""
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    text = F.regexp_replace(F.col(title), r"([,;\\])", r"\\$1")
    return df.select(F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART:"), stamp), F.concat(F.lit("SUMMARY:"), text), F.lit("END:VEVENT")).alias("value"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet table at path doesn't hold yet; how many there were."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df = df.dropDuplicates([key])
    observed = df.groupBy().count().first()[0]
    df.write.mode("append").parquet(path)
    return observed
