"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Our own folder, by application, where the session names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local runs, one of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # a running session takes no new value for it
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quarry-")
        folder = _own[app]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"


#: Paths of tables written inside the open scopes, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths that `saved` writes meanwhile, so that they can be dropped once what was made from them is stored."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def working_path(spark: SparkSession, name: str) -> str:
    """A fresh path that the open scope collects."""
    path = fresh_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage, survives lost executors and fixes what was drawn."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in sums, the sum of that column over all rows before a row in the given order. Rows go by ranges of
    the order to partitions; one row of sums for each partition is all that one task sees."""
    given = [f"order{i}" for i in range(len(order))]
    ranged = df.select("*", *(o.alias(n) for o, n in zip(order, given)), *(c.alias(f"{n} of row") for n, c in sums.items()))
    up = [F.col(n).asc_nulls_last() for n in given]
    ranged = saved(ranged.repartitionByRange(*up).withColumn("range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("range").agg(*(F.sum(f"{n} of row").alias(f"{n} of range") for n in sums))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(f"{n} of range").over(earlier), F.lit(0)).alias(f"{n} of range") for n in sums))
    inside = Window.partitionBy("range").orderBy(*up).rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(f"{n} of row").over(inside), F.lit(0)) for n in sums}
    return ranged.withColumns({f"{n} inside": c for n, c in own.items()}).join(F.broadcast(totals), "range").select(
        *(f"`{c}`" for c in df.columns), *((F.col(f"{n} inside") + F.col(f"{n} of range")).alias(n) for n in sums)
    )


def whole(text: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def crc_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


#: Bytes that Spark hands to a Python worker at a time inside `small_batches`.
BATCH_BYTES = 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of rows for Python are cut by their bytes meanwhile, unless the session says how: ten thousand texts, Spark's measure
    otherwise, stand in an executor's memory several times over. It holds for what runs meanwhile, not for plans that are made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    named = spark.conf.get(key, None) is not None
    if not named:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(key)


#: What this Python worker keeps between tasks, by the operator that it last worked for.
_kept: dict[str, dict[str, object]] = {}


def turned_to(operator: str) -> dict[str, object]:
    """What this worker keeps for an operator from task to task. Workers outlive stages, and serve any operator: what one kept for
    others goes."""
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
    return _kept[operator]


def kept_by_worker(operator: str, key: str, make: Callable[[], object]) -> object:
    own = turned_to(operator)
    if key not in own:
        own[key] = make()
    return own[key]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each string of an Arrow column without nulls."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of items, each as long as its sizes add up to `most`, or one item."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
