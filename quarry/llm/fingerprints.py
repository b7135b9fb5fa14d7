"""Fingerprints by locally consistent parsing.

A text is a string of symbols, first its code points. Runs of one symbol become one symbol. Deterministic coin tossing then gives
each place a label from the symbol before it and its own (twice the lowest bit in which they differ, plus that bit), four times
over, until few labels are left; phrases begin where labels are local maxima. A phrase's name is a hash of its symbols, and the
names are the symbols of the next level. Where a phrase begins depends on a few symbols around it only, so that equal substrings
have equal phrases inside, wherever they stand. The signature holds the names of levels two to four (also of level one for texts
with hardly any); its fingerprint is the 64 smallest of their 32-bit hashes, and likeness is the share of both sides' names among
the 64 smallest of either.

Defined results: null text counts as empty, whose fingerprint is the empty string; two empty fingerprints have likeness 1, one
empty 0. Ids may be of any type that Spark orders; rows are ordered by id, then by text; a null id comes last; the next document
of the last row is the first row (itself, if it is alone). An empty table gives an empty result. Only the id and the text are read, whatever the other columns' names are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import whole

LEVELS, KEPT, FEW = (2, 3, 4), 64, 4
#: Code points of a text's beginning by which rows of one id are dealt.
HEAD = 32
#: Code points parsed at a time, so that the arrays stay in the processor's cache.
TOGETHER = 300_000

_one = np.uint64(1)
_weights = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + _one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of coin tossing; a text's first place is compared with the symbol 0."""
    for _ in range(4):
        before = np.empty_like(symbols)
        before[0] = 0
        before[1:] = symbols[:-1]
        before[first] = 0
        differ = symbols ^ before
        lowest = differ & (~differ + symbols.dtype.type(1))
        at = np.bitwise_count(lowest - symbols.dtype.type(1)).astype(np.uint8)
        symbols = at * np.uint8(2) + ((symbols & lowest) != 0)
    return symbols


def parse(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each owner's string of symbols (owner: numbers in ascending order), and their owners."""
    if not len(symbols):
        return symbols, owner
    first = np.empty(len(symbols), bool)
    first[0] = True
    np.not_equal(owner[1:], owner[:-1], out=first[1:])
    head = first.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(head)
    if len(at) < len(symbols):
        runs = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols, owner, first = symbols[at], owner[at], first[at]
        symbols = np.where(runs > 1, _mixed(symbols * np.uint64(31) + runs), symbols)
    labels = _labels(symbols, first)
    above = np.empty(len(labels), bool)
    above[0] = False
    np.greater(labels[1:], labels[:-1], out=above[1:])
    begins = first.copy()
    begins[:-1] |= above[:-1] & ~above[1:] & ~first[1:]
    at = np.flatnonzero(begins)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
    names = np.add.reduceat((symbols + _one) * _weights[place & 63], at)
    return _mixed(names), owner[at]


def _sketches(texts: list[str]) -> list[np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    symbols, owner = points, np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found, low = [], None
    for level in range(1, max(LEVELS) + 1):
        symbols, owner = parse(symbols, owner)
        keys = (owner.astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32))
        if level == 1:
            low = keys
        if level in LEVELS:
            found.append(keys)
    keys = np.unique(np.concatenate(found))
    few = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts)) < FEW
    if few.any():
        keys = np.union1d(keys, low[few[(low >> np.uint64(32)).astype(np.int64)]])
    ends = np.cumsum(np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(texts)))
    hashes = keys.astype(np.uint32)
    return [hashes[a : min(b, a + KEPT)] for a, b in zip([0, *ends[:-1]], ends)]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Each text's smallest hashes, ascending."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            out += _sketches(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (_sketches(part) if part else [])


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    left, right = set(a.tolist()), set(b.tolist())
    least = sorted(left | right)[:KEPT]
    both = left & right
    return sum(x in both for x in least) / len(least)


def _in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (id, text, head: the text's beginning), each row with the number of its range of (id, head), null ids last; and, for each
    range, the row that follows its last (the first of all after the last of all). There are as many ranges as shuffle partitions at
    most; the first key of each is all that the driver sees. Equal rows with a text of less than HEAD characters may fill several
    ranges; longer ones stay in one with all rows of the same id and head, so that their order is that of their texts."""
    spark, parts = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "head")
    ranged = docs.select("id", "head", F.monotonically_increasing_id().alias("row")).repartitionByRange(parts, F.col("id").asc_nulls_last(), "head", "row")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(key).alias("key")).select("key.id", "key.head").toArrow()
    ordered = lambda i, head: (2, 0, head) if i is None else (1, 0, head) if i != i else (0, i, head)  # noqa: E731  NaN after all other numbers
    begins = sorted((ordered(r["id"], r["head"]), n) for n, r in enumerate(firsts.to_pylist()))
    keys = [k for k, _ in begins]

    @F.arrow_udf(T.IntegerType())
    def range_of(ids: pa.Array, heads: pa.Array, rows: pa.Array) -> pa.Array:
        found = []
        for i, head, row in zip(ids.to_pylist(), heads.to_pylist(), rows.to_pylist()):
            own = ordered(i, head)
            low, high = bisect_left(keys, own), bisect_right(keys, own)
            found.append(low + row % (high - low) if high - low > 1 and len(head) < HEAD else max(high - 1, 0))
        return pa.array(found, pa.int32())

    numbered = docs.withColumn("bucket", range_of("id", "head", F.monotonically_increasing_id()))
    # a range whose first key is also the next one's holds no row of its own if such rows stay together
    own = [n for i, (k, n) in enumerate(begins) if i + 1 == len(begins) or keys[i + 1] != k or len(k[2]) < HEAD]
    at = [i for i, (_, n) in enumerate(begins) if n in set(own)]
    follows = pa.array([at[n - 1] for n in range(len(at))], pa.int32())
    next_rows = spark.createDataFrame(firsts.take(pa.array(own, pa.int64())).append_column("of", follows))
    next_rows = next_rows.select(F.col("id").cast(docs.schema["id"].dataType).alias("of_id"), F.col("head").alias("of_head"), "of")
    guards = (
        docs.join(F.broadcast(next_rows), (F.col("head") == F.col("of_head")) & F.col("id").eqNullSafe(F.col("of_id")))
        .groupBy("of", "id").agg(F.min("text").alias("text")).select("id", "text", F.col("of").alias("bucket"))
    )
    return numbered, guards


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row. The edited text
    is the text, its last half replaced by as much of the next document's beginning.

    Rows go by ranges of ids to partitions, one shuffle of the texts; a copy of the row that follows a range is put at its end."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), F.left(whole(text_col), F.lit(HEAD)).alias("head"))
    numbered, guards = _in_order(docs)
    columns = ["id", "text", "bucket"]
    rows = numbered.select(*columns, F.lit(0).alias("guard")).unionAll(guards.select(*columns, F.lit(1).alias("guard")))
    rows = rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "guard", F.col("id").asc_nulls_last(), "text")
    out = T.StructType([T.StructField("id", id_type), *(T.StructField(n, t) for n, t in (
        ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
    ))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            held = batch.slice(batch.num_rows - 1)
            texts, guard = batch.column("text").to_pylist(), batch.column("guard").to_pylist()
            own = [i for i in range(len(texts) - 1) if not guard[i]]
            edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i in own for t in (texts[i],)]
            prints, changed = sketches(texts), sketches(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(own, pa.int64())),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([as_text(prints[i]) for i in own], pa.string()),
                    pa.array([as_text(x) for x in changed], pa.string()),
                    pa.array([likeness(prints[i], x) for i, x in zip(own, changed)], pa.float64()),
                    pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
                ],
                names=out.names,
            )

    return rows.select("id", "text", "guard").mapInArrow(run, out)
