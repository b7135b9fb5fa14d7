"""Language-model scores of whole documents.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of all tokens of all training documents (those whose id's
crc32 doesn't leave the held-out remainder) give the base score, add-one smoothed, and the model's vocabulary: the most frequent
words have outputs of their own; the others fall into classes by their last two bytes, within which a token has the share
(count + 1) / (sum of the class's counts + 1 each + 1), the last 1 for what was never seen.

Texts are split twice: to be counted, and to be written as the network's numbers, from which training and scoring go on. The
network (quarry.llm.gru) starts from the frequencies and learns in rounds, from every training document in one of them. A round's
documents are dealt to shards of about SHARD tokens by a hash of id and text, so that neither the cluster nor the input's files
matter to the result. Each shard runs truncated backpropagation from the round's parameters, over its documents in the hash's
order, and results are averaged by tokens, as arrays. Scoring carries the state through whole documents.

What is broadcast or reaches the driver is bounded: at most KNOWN words with their counts, and the parameters. Counts of rarer
words, however many, are joined: a row for each document and rare word.

Defined results: null text counts as empty: one token, the end; repeated rows get a row each (those without an id are dealt to
shards by their place in the input); without training documents the base score is 0 and the model knows nothing; an empty table
gives an empty result; the input's columns are carried in one struct.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import gru
from quarry.llm.common import as_bytes, crc_remainder, saved, whole

KNOWN, FLUSH, SHARD, TOGETHER = 1 << 17, 400_000, 1 << 20, 100_000
END = b""


def rare_class(token: bytes) -> int:
    return crc32(token[-2:]) % gru.RARE


def token_counts(rows: DataFrame) -> DataFrame:
    """Columns token (binary), c over all rows' text; each task sums before the shuffle, at most FLUSH tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def settle() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                counts.update(text.lower().split())
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield settle()
        yield settle()

    return rows.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Places(dict):
    """Places of the known words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Lexicon:
    """The known words by falling count, and what scoring needs of the others."""

    def __init__(self, words: list[tuple[bytes, int]], masses: dict[int, int], total: int, distinct: int):
        words = sorted(words, key=lambda w: (-w[1], w[0]))
        place = next((i for i, w in enumerate(words) if w[0] == END), None)
        if place is None or place >= gru.WORDS:  # the end is always an output of its own
            words.insert(0, words.pop(place) if place is not None else (END, 0))
        self.of = Places((w, i) for i, (w, _) in enumerate(words))
        self.counts = np.array([c for _, c in words], float)
        self.logs = np.log10(self.counts + 1)
        classes = np.array([rare_class(w) for w, _ in words], np.int32)
        mass = np.array([masses.get(k, 0) for k in range(gru.RARE)], float)
        heads = self.counts[: gru.WORDS] + (self.counts[: gru.WORDS] > 0)  # a word of count 0 is in no mass
        self.rare_mass = mass - np.bincount(classes[: gru.WORDS], heads, gru.RARE) + 1
        #: Each known word's number for the network, and the logarithm of its share among those of that number.
        self.numbers = np.where(np.arange(len(words)) < gru.WORDS, np.arange(len(words)), gru.WORDS + classes).astype(np.int16)
        self.shares = np.where(np.arange(len(words)) < gru.WORDS, 0, self.logs - np.log10(self.rare_mass)[classes])
        self.total, self.distinct, self.end = total, distinct, self.of[END]


def lexicon(counts: DataFrame, known: int = KNOWN) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    kind = F.pmod(F.crc32(F.substring("token", -2, 2)), F.lit(gru.RARE)).cast("int")
    masses = {r[0]: r[1] for r in counts.groupBy(kind).agg(F.sum(F.col("c") + 1)).collect()}
    # the least count of which there are not too many words: from a histogram of at most a few hundred rows
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True)
    room, least = known, None
    for s, n in sizes:
        if n > room:
            break
        room, least = room - n, s
    is_end = F.col("token") == F.lit(END)  # texts end, whatever the limit
    chosen = counts.where(is_end if least is None else is_end | (step >= least))
    return Lexicon([(bytes(r.token), r.c) for r in chosen.collect()], masses, total, distinct)


ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("rest", T.DoubleType()),
    T.StructField("ids", T.StringType()),
    T.StructField("rares", T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("times", T.IntegerType())]))),
])


def as_text(numbers: np.ndarray, sizes: list[int]) -> pa.Array:
    """Numbers as texts, the first of so many numbers and so on, with a character for each: Spark hands a text on in one piece, and
    an array number by number. They are below the surrogates."""
    flat = numbers.astype("<u4").tobytes().decode("utf-32-le").encode()
    widths = np.r_[0, np.cumsum(1 + (numbers >= 0x80) + (numbers >= 0x800))]
    ends = widths[np.r_[0, np.cumsum(sizes)]].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(flat))


def as_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What as_text was made from: all numbers, and how many are each text's."""
    flat = b"".join(as_bytes(texts)).decode()
    return np.frombuffer(flat.encode("utf-32-le"), "<u4").astype(np.int16), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(texts: list[bytes], words: Lexicon) -> list[pa.Array]:
    """Columns of ENCODED: known words' part of the base score and of the classes' shares, the network's numbers, and the words
    that aren't known, each with its times."""
    place, tokens, sizes = words.of.__getitem__, [], []
    for text in texts:
        own = text.lower().split()
        tokens += own
        tokens.append(END)
        sizes.append(len(own) + 1)
    at = np.fromiter(map(place, tokens), np.int32, len(tokens))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    numbers, seen = words.numbers[at], at >= 0
    rare = np.flatnonzero(~seen)
    names = [tokens[i] for i in rare.tolist()]
    numbers[rare] = [gru.WORDS + rare_class(w) for w in names]
    own = owner[seen]
    sums = [np.bincount(own, x[at[seen]], len(sizes)) for x in (words.counts > 0, words.logs, words.shares)]
    unseen = np.bincount(owner[rare], np.log10(words.rare_mass)[numbers[rare] - gru.WORDS], len(sizes))
    distinct: dict[bytes, int] = {}
    which = np.fromiter((distinct.setdefault(w, len(distinct)) for w in names), np.int64, len(names))
    pairs, times = np.unique(owner[rare] * max(1, len(distinct)) + which, return_counts=True)  # a text and a word
    of, which = np.divmod(pairs, max(1, len(distinct)))
    begins = np.r_[0, np.cumsum(np.bincount(of, minlength=len(sizes)))].astype(np.int32)
    rares = pa.StructArray.from_arrays([pa.array(list(distinct), pa.binary()).take(pa.array(which)), pa.array(times.astype(np.int32))], names=["token", "times"])
    return [
        pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2] - unseen),
        as_text(numbers, sizes), pa.ListArray.from_arrays(pa.array(begins), rares),
    ]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about TOGETHER words."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= TOGETHER:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _learnt(taught: DataFrame, words: Lexicon, rounds: int) -> gru.Params:
    """taught: slice (0 to rounds - 1), dealt (a hash), ids. Rounds of training in shards, and averaging."""
    params = gru.initial(words.counts[: gru.WORDS], words.rare_mass)
    past = {k: np.full_like(v, 1e-6) for k, v in params.items()}
    context, end = taught.sparkSession.sparkContext, words.end
    shards = max(1, -(-words.total // (rounds * SHARD)))
    for r in range(rounds):
        sent = context.broadcast((gru.flat(params), gru.flat(past)))

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            begin = [gru.unflat(x) for x in sent.value]
            total, weight, shard, trainer, tokens = np.zeros(2 * gru.SIZE), 0, None, None, 0
            ids, sizes = np.zeros(0, np.int16), np.zeros(0, np.int64)

            def teach(n: int) -> None:
                nonlocal ids, sizes, tokens
                size = int(sizes[:n].sum())
                trainer.fit(ids[:size], sizes[:n], end)
                tokens, ids, sizes = tokens + size, ids[size:], sizes[n:]

            def settle() -> None:
                nonlocal total, weight
                if trainer is not None:
                    if len(sizes):
                        teach(len(sizes))
                    total += tokens * np.r_[gru.flat(trainer.p), gru.flat(trainer.past)].astype(float)
                    weight += tokens

            for batch in batches:
                own, (flat, lengths) = batch.column("shard").to_numpy(), as_numbers(batch.column("ids"))
                ends = np.r_[0, np.cumsum(lengths)]
                cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else []
                for a, b in zip(cuts, cuts[1:]):
                    if own[a] != shard:
                        settle()
                        shard, trainer, tokens = own[a], gru.Trainer(*begin), 0
                        ids, sizes = ids[:0], sizes[:0]
                    ids, sizes = np.r_[ids, flat[ends[a] : ends[b]]], np.r_[sizes, lengths[a:b]]
                    while len(ids) > 2 * SHARD:  # only where rows repeat in great numbers
                        teach(int(np.searchsorted(np.cumsum(sizes), SHARD)) + 1)
            settle()
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([total / weight], pa.list_(pa.float64()))], names=["tokens", "values"])

        each = taught.where(F.col("slice") == r).select(F.pmod("dealt", F.lit(shards)).cast("int").alias("shard"), "dealt", "ids")
        each = each.repartitionById(shards, "shard").sortWithinPartitions("shard", "dealt").select("shard", "ids").mapInArrow(train, "tokens double, values array<double>")
        for parts in (32, 1):  # sums of sums, so that no task adds up more than a few
            each = each.repartition(parts).mapInArrow(_averaged, "tokens double, values array<double>")
        if found := each.collect():
            params, past = (gru.unflat(np.array(x, np.float32)) for x in np.split(np.array(found[0]["values"]), 2))
        sent.unpersist()
    return params


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = 0.0, 0.0
    for batch in batches:
        for tokens, values in zip(batch.column("tokens").to_pylist(), batch.column("values")):
            total, weight = total + tokens * values.values.to_numpy(), weight + tokens
    if weight:
        yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total / weight], pa.list_(pa.float64()))], names=["tokens", "values"])


def scores(
    df: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (7, 2), rounds: int = 4
) -> DataFrame:
    """Columns row (a struct of the columns `carry`), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    apart = crc_remainder(id_col, held_out[0]) == held_out[1]
    own = F.monotonically_increasing_id()
    rows = df.select(F.struct(*carry).alias("row"), own.alias("n"), F.col(id_col).alias("id"), apart.alias("held_out"), whole(text_col).alias("text"))
    counts = saved(token_counts(rows.where("not held_out")), "counts")
    words = lexicon(counts)
    sent = df.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in _parts(texts):
                kept = [batch.column(c).slice(a, b - a) for c in ("row", "n", "held_out", "dealt")]
                yield pa.RecordBatch.from_arrays([*kept, *_encoded(texts[a:b], sent.value)], names=["row", "n", "held_out", "dealt", *ENCODED.names])

    dealt = F.when(F.col("id").isNull(), F.xxhash64("n")).otherwise(F.xxhash64("id", "text"))
    rows = rows.select("row", "n", "held_out", dealt.alias("dealt"), "text")
    encoded = saved(rows.mapInArrow(encode, T.StructType([*rows.schema.fields[:4], *ENCODED.fields])), "encoded")
    part = F.pmod(F.shiftright("dealt", 32), F.lit(rounds)).cast("int")
    model = df.sparkSession.sparkContext.broadcast(gru.flat(_learnt(encoded.where("not held_out").select(part.alias("slice"), "dealt", "ids"), words, rounds)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, end = gru.unflat(model.value), sent.value.end
        for batch in batches:
            flat, lengths = as_numbers(batch.column("ids"))
            found = gru.log_likelihood(params, np.split(flat, np.cumsum(lengths)[:-1]) if len(lengths) else [], end) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "own"])

    kept = ("row", "n", "held_out", "n_tokens", "known", "base", "rest")
    found = encoded.select(*kept, "ids").mapInArrow(score, T.StructType([*(encoded.schema[c] for c in kept), T.StructField("own", T.DoubleType())]))
    log_count = F.log10(F.col("c").cast("double") + 1)
    rares = encoded.select("n", F.explode("rares").alias("rare")).select("n", "rare.token", "rare.times").join(counts, "token")
    rares = rares.groupBy(F.col("n").alias("of")).agg(F.sum("times").alias("times"), F.sum(F.col("times") * log_count).alias("logs"))
    more = F.coalesce("logs", F.lit(0.0))
    floor = float(np.log10(words.total + words.distinct + 1))
    return found.join(rares, F.col("n") == F.col("of"), "left").select(
        "row", "held_out", "n_tokens", (F.col("known") + F.coalesce("times", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("own") + F.col("rest") + more).alias("score"),
    )
