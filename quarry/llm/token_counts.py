"""Token counts of whole texts, kept in a cache of digests.

Every text has a key: SHA-256 of its normalised content, and SHA-256 of the tokenizer's file. (Null is read as the empty text; any
other change of the content could change its tokens.) Counts found in the cache under that key are joined; of the texts that are
missing, one of each content is encoded, and its count is appended to the cache. Texts are reduced to one of each content before
they are shuffled, so that a content that a third of all rows share is one row of each task; rows then get their counts by a join
of digests, whose hot keys adaptive execution can split.

Encoding a text is a sum over its blank-separated pieces, because the pre-tokenizer's pattern never crosses white space: pieces
that repeat are looked up, the others go to the tokenizers library. The lookup table holds at most MEMO pieces a worker.

Defined results: null text counts as empty (0 tokens); repeated rows and repeated ids each get their row; null ids stay null; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import as_bytes, saved, whole

#: Pieces whose counts a Python worker keeps, and texts encoded by one call.
MEMO, TOGETHER = 300_000, 20_000

_loaded: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {})
    return _loaded[path]


def counts_of(texts: list[bytes], path: str) -> list[int]:
    """Number of tokens of each UTF-8 text, as the library gives it without added tokens."""
    tokenizer, memo = _tokenizer(path)
    pieces = [t.split() for t in texts]
    missing = list({p for own in pieces for p in own if p not in memo})
    found: dict[bytes, int] = {}
    for i in range(0, len(missing), TOGETHER):
        part = missing[i : i + TOGETHER]
        encoded = tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
        found.update(zip(part, (len(e.ids) for e in encoded)))
    room = MEMO - len(memo)
    if room >= len(found):
        memo.update(found)
        return [sum(map(memo.__getitem__, own)) for own in pieces]
    for p in list(found)[: max(room, 0)]:
        memo[p] = found[p]
    return [sum(memo[p] if p in memo else found[p] for p in own) for own in pieces]


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, digest, n_bytes, n_tokens of every row of docs. cache_path: a Parquet folder, made if it is missing, to which
    the counts that it lacked are appended (columns digest binary, n_tokens long, a partition version)."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    own = f"{cache_path.rstrip('/')}/version={version}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    keyed = _keyed(docs, id_col, text_col)
    missing = keyed.groupBy("digest").agg(F.any_value("text").alias("text"))
    if exists:
        missing = missing.join(spark.read.schema(schema).parquet(own), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = counts_of(as_bytes(batch.column("text")), tokenizer_path)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    missing.select("digest", "text").mapInArrow(encode, schema).write.mode("append").parquet(own)
    # one count of each digest, should two runs have appended it at once
    counts = saved(spark.read.schema(schema).parquet(own).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sizes = keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest").select("id", "digest", "n_bytes", "n_tokens")
