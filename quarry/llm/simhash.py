"""SimHash fingerprints, and links of near copies by multi-index hashing.

A fingerprint's bit is 1 if it is set in more than half of the hashes of the text's word shingles. Fingerprints link if they
differ in at most `radius` bits. They are cut into segments; two that link agree in at least one segment but for a few bits (with
m segments and radius r: in one of the first r mod m + 1 segments but for r div m bits, or in another but for one bit less). So
every distinct fingerprint is put under each value of that small Hamming ball around each of its segments; those that meet under
one value, one of them by its own value, are verified over all bits.

Under one value, links are emitted as a spanning forest of those that meet, not as all pairs: the number of links is below the
number of entries however large a group of copies is. Exact copies are folded first, since the work is done on distinct fingerprints.

Defined results: null and blank texts have fingerprint 0 and link like others; repeated rows keep a row each; a null id never is
the smallest id unless its whole component has none; an empty table gives an empty result; other columns are kept by `near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import as_bytes, saved, small_batches, turned_to, whole
from quarry.llm.components import components

BITS, SEED = 64, 42
#: Beyond so many distinct fingerprints two segments are used instead of three, so that few strangers meet.
THREE_SEGMENTS = 1 << 26
#: Larger groups under one value are walked, smaller ones are compared by shifts.
SMALL = 48


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one UTF-8 text; A-Z are lower-cased, words are split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` and the fingerprint as a signed long `fp`."""
    schema = T.StructType([*(df.schema[c] for c in carry), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned_to("simhash")
        for batch in batches:
            of = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(len(carry)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(of)], names=[*carry, "fp"])

    return df.select(*carry, whole(text_col).alias("whole text")).mapInArrow(run, schema)


def segment_masks(segments: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each segment its place (shift, width) and, after it, the masks of the Hamming ball to enumerate around its value."""
    base, more = divmod(radius, segments)
    out, shift = [], 0
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        r = base if i <= more else base - 1
        masks = [sum(1 << b for b in bits) for k in range(r + 1) for bits in combinations(range(width), k)] if r >= 0 else []
        out.append([(shift, width), *((0, m) for m in masks)])
        shift += width
    return out


def _bits_apart(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers numpy counts the absolute value's bits


def linked(keys: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among entries sorted by key: both of one key, one of them under its own value, and at most radius bits apart. Large
    groups give a spanning forest of their links."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begins, len(keys)])
    mine = np.logical_or.reduceat(own, begins) if len(keys) else np.zeros(0, bool)
    left, right = [], []
    keep = np.repeat(mine & (sizes > 1) & (sizes <= SMALL), sizes)
    k, f, o = keys[keep], fps[keep], own[keep]
    at = np.arange(len(k))
    shift = 1
    while len(at := at[at < len(k) - shift]) and len(at := at[k[at] == k[at + shift]]):
        hit = at[(_bits_apart(f[at], f[at + shift]) <= radius) & (f[at] != f[at + shift]) & (o[at] | o[at + shift])]
        left.append(f[hit])
        right.append(f[hit + shift])
        shift += 1
    for g in np.flatnonzero(mine & (sizes > SMALL)):
        rest = np.unique(fps[begins[g] : begins[g] + sizes[g]])
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                one = queue.pop()
                near = _bits_apart(rest, one) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), one))
                    right.append(found)
                    queue.extend(found)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp): enough of them to connect whatever is at most radius bits apart."""
    entries = None
    for i, ((shift, width), *masks) in enumerate(segment_masks(segments, radius)):
        if not masks:
            continue
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        ball = F.explode(F.array(*(F.lit(m).cast("long") for _, m in masks)))
        part = distinct.select("fp", value.alias("value"), ball.alias("mask")).select(
            (F.col("value").bitwiseXOR(F.col("mask")) * F.lit(4) + F.lit(i)).alias("key"), "fp", (F.col("mask") == 0).alias("own")
        )
        entries = part if entries is None else entries.unionAll(part)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield _emit(*linked(*(x[:cut] for x in held), radius))
                held = [x[cut:] for x in held]
        yield _emit(*linked(*held, radius))

    return entries.mapInArrow(run, "a long, b long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Columns id, fp, component_id of every row: the smallest id among all rows that links lead to."""
    with small_batches(df.sparkSession):
        fps = saved(with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle, ("id",)), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    segments = 3 if distinct.count() <= THREE_SEGMENTS else 2
    roots = components(fingerprint_links(distinct.select("fp"), radius, segments))
    root: Column = F.coalesce("root", "fp")
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root.alias("root"), "least_id")
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = nodes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("id", "fp", "component_id")
