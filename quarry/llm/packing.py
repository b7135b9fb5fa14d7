"""Best-fit packing of documents into sequences, by counts of each length.

Documents are cut only if they are longer than a sequence: the first piece takes what is left over, the others fill a sequence
each. Pieces are packed from the longest to the shortest, each into the open sequence with the smallest gap that holds it, or else
into a new one. Which piece of a length it is plays no part in that, so it is decided for counts: sequences with equal gaps that
stand next to each other are one group, and a group takes as many pieces of the length at hand as its gaps hold, at once. That
makes a table of steps. Each length splits two groups at most and begins one, and a step leaves a group less than half its gap, so
the table follows the number of lengths (`capacity` at most), not that of pieces.

Pieces get their places in the order of lengths, then of row numbers, as prefix sums over ranges of it, however many share a
length; a piece's sequence and offset follow from its place and the step that the place falls into. The driver sees counts of each
length alone, and runs a few plans, whatever the input.

Token ids are those of the tokenizers library. The pre-tokenizer never joins what stands left of a blank to what follows it, unless
more white space follows. So texts are cut before all other blanks, and chunks that repeat are looked up (at most MEMO a worker).
Texts that hold a string of the tokenizer's added tokens go to the library whole, and so do chunks of rarer scripts. Other new
chunks go to an encoder that merges by rank, several times as fast, if its results are proven equal for the vocabulary at hand
(`mergeable_ranks`), else to the library as well. It takes its ranks from the same file. The proof: both start from bytes, and
take the lowest rank first, leftmost; the library merges the listed pairs alone, the other whatever two neighbours make a token.
Suppose they have gone the same way so far, and the lowest rank left to either joins x and y to the token t. No merge crossed the
ends of xy, and all lower ones inside are done. So xy stands as t itself does, encoded alone, just before its last step. If every
token, encoded alone, ends as itself, (x, y) is the pair that is listed for t. That is a finite check, which each worker makes
once. Both cut chunks by one pattern; only characters that every version of Unicode puts into the same class go that way.

Defined results: null text is empty and its document has one token, the end; repeated rows and ids are packed separately (their
pieces' rows look alike but for their places); a null id stays null; an empty table gives an empty result; the input's other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import as_bytes, kept_by_worker, prefix_sums, saved, small_batches, stretches, whole

CAPACITY, MEMO, TOGETHER = 2048, 400_000, 20_000
#: Bytes of text whose chunks a worker holds at a time.
PART = 2_000_000
#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank before which a text may be cut: no white space, ASCII or other, and not the text's end follows it.
_cut = re.compile(rb" (?![\s\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
#: Where a text has none of these, it may be cut before every blank; of white space beyond ASCII the last ones hold a part.
_odd = (b"  ", b" \n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b" \xc2", b" \xe1\x9a", b" \xe2\x80", b" \xe2\x81", b" \xe3\x80")
#: Chunks of these characters alone: ASCII but for control characters other than the line's end, Latin and Cyrillic letters and signs.
_common = re.compile(rb"(?:[\n\x21-\x7e]|\xc2[\xa1-\xac\xae-\xbf]|[\xc3-\xc6][\x80-\xbf]|\xd0[\x80-\xbf]|\xd1[\x80-\xbf])+")


def _bytes_of() -> dict[str, int]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the others as characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def mergeable_ranks(path: str) -> dict[bytes, int] | None:
    """The bytes of a vocabulary's tokens with their ids, if encoding by these as ranks is proven equal to the library's; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    of = _bytes_of()
    added = {t["content"] for t in spec.get("added_tokens") or ()}
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    listed = {tuple(bytes(of[c] for c in x) for x in pair): i for i, pair in enumerate(pairs)}
    ids = [ranks.get(a + b) for a, b in listed]
    if None in ids or ids != sorted(ids) or len(set(ids)) != len(ids) or set(ranks.values()) - set(ids) != {ranks.get(bytes([b])) for b in range(256)}:
        return None
    if max(ranks[bytes([b])] for b in range(256)) > min(ids, default=1 << 60):
        return None
    for token in ranks:  # encoded alone, by the listed pairs
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: listed.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[k], parts[k + 1]) not in listed:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return ranks


def _tokenizer(path: str):
    """The tokenizer of a .json file, the encoder by rank of new chunks if it is proven, the strings of its added tokens, and the
    worker's table of chunks."""

    def load() -> tuple:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, encode = Tokenizer.from_file(path), None
        if ranks := mergeable_ranks(path):
            import tiktoken

            encode = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        return tokenizer, encode, added, {}

    return kept_by_worker("packing", path, load)


def token_ids(texts: list[bytes], path: str, end_id: int = 0) -> Iterator[np.ndarray]:
    """The ids of each UTF-8 text, then end_id, as unsigned 32-bit numbers."""
    tokenizer, encode, added, memo = _tokenizer(path)
    end = array("I", [end_id]).tobytes()
    get = memo.get  # of what follows a blank, its ids with the blank
    done: list[tuple[list[bytes], list[bytes | None]] | None] = []
    firsts: list[str] = []
    missing: set[bytes] = set()
    for t in texts:
        if any(a in t for a in added):
            done.append(None)
            firsts.append(t.decode())
            continue
        first, *rest = _cut.split(t) if t.endswith(b" ") or any(o in t for o in _odd) else t.split(b" ")
        ids = list(map(get, rest))
        if None in ids:
            missing.update([p for p, i in zip(rest, ids) if i is None])
        done.append((rest, ids))
        firsts.append(first.decode())
    quick = [p for p in missing if _common.fullmatch(p)] if encode else []
    new = {p: array("I", encode(" " + p.decode())).tobytes() for p in quick}
    slow = [p for p in missing if p not in new]
    for i in range(0, len(slow), TOGETHER):
        part = slow[i : i + TOGETHER]
        found = tokenizer.encode_batch_fast([" " + p.decode() for p in part], add_special_tokens=False)
        new.update(zip(part, (array("I", e.ids).tobytes() for e in found)))
    memo.update(islice(new.items(), max(0, MEMO - len(memo))))
    for first, own in zip(tokenizer.encode_batch_fast(firsts, add_special_tokens=False), done):
        body = array("I", first.ids).tobytes()
        if own is not None:
            rest, ids = own
            body += b"".join([new[p] if i is None else i for p, i in zip(rest, ids)] if None in ids else ids)
        yield np.frombuffer(body + end, np.uint32)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Start, length and crc32 of each piece."""
    short = len(ids) % capacity
    ends = [*([short] if short else []), *range(short + capacity, len(ids) + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip([0, *ends], ends)]


def pieces_of(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Columns id, piece, start, length, ids_crc32, and row, a number of the piece's own."""
    rows = df.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in stretches([len(t) for t in texts], PART):
                found = [cut(ids, capacity) for ids in token_ids(texts[a:b], tokenizer_path)]
                owner = np.repeat(np.arange(a, b), [len(x) for x in found])
                flat = [(k, *x) for own in found for k, x in enumerate(own)]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(zip(*flat), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing. counts: pieces of each length. A row for each step: the first place that it takes, its first sequence, the
    offset there, the length, and how many pieces go into each sequence before the next one's turn."""
    steps, gaps, groups = [], [], {}  # gaps: those of open sequences, rising; groups: first sequence and number
    place = begun = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in groups:
                insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first, n))

    for length, left in sorted(counts.items(), reverse=True):
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = groups[gap].pop()
                if not groups[gap]:
                    del groups[gap], gaps[at]
            else:
                gap, first, n = capacity, begun, -(-left // (capacity // length))
                begun += n
            each = gap // length
            for of, sequences in ((each, min(n, left // each)), (left % each, 1)):  # in the last one, what remains
                if of and sequences and n and left:
                    steps.append((place, first, capacity - gap, length, of))
                    place, left = place + of * sequences, left - of * sequences
                    put(gap - of * length, first, sequences)
                    first, n = first + sequences, n - sequences
            put(gap, first, n)
    return np.array(steps, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces: row (unique), length (1 to capacity), and others. Adds sequence_id and offset."""
    counts = dict(pieces.groupBy("length").agg(F.count("*")).collect())  # a row for each length, `capacity` at most
    steps = pieces.sparkSession.sparkContext.broadcast(best_fit(counts, capacity))
    placed = prefix_sums(pieces, [-F.col("length"), F.col("row")], {"place": F.lit(1)})
    new = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    columns, schema = pieces.columns, T.StructType([*pieces.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.ascontiguousarray(steps.value[:, 0])
        for batch in batches:
            place = batch.column("place").to_numpy()
            begin, first, offset, length, each = steps.value[np.searchsorted(begins, place, "right") - 1].T
            turn, inside = np.divmod(place - begin, each)
            own = [pa.array(first + turn), pa.array(offset + inside * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *own], names=schema.names)

    return placed.select(*columns, F.col("place").cast("long").alias("place")).mapInArrow(run, schema)


def packed(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Columns id, piece, start, length, ids_crc32, sequence_id, offset: every piece's content and place."""
    with small_batches(df.sparkSession):
        pieces = saved(pieces_of(df, tokenizer_path, id_col, text_col, capacity), "pieces")
    return pack(pieces, capacity).drop("row")
