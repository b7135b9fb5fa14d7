"""Mixing against SQL and filling by hand; packing by exact round trips."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import mixing, packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes):
    """Targets by filling: cap whoever is above, share the rest anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(awkward, nothing):
    found = mixing.mix(awkward, ["doc_id", "text", "key", "bin"]).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.size == size(r.row.text) and 0 <= r.taken <= 2 * r.size and r.row.key == "key"
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    targets = filled(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.mix(awkward.repartition(7), ["doc_id", "text"]).collect()
    key = lambda rows: sorted((str(r.row.doc_id), r.size, r.taken) for r in rows)
    assert key(found) == key(again)
    assert mixing.mix(nothing, ["doc_id"]).count() == 0
    entire = mixing.mix(awkward, ["doc_id"], whole_documents=True).collect()
    assert all(r.size == 0 and r.taken == 0 or r.taken % r.size == 0 for r in entire)


def test_mixing_equals_sql(awkward):
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text", "source").toArrow())
    mine = [(r.row.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(awkward, ["doc_id"]).collect()]
    theirs = [(a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(mixing.ORACLE).fetchall()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def sound(pieces, expect, capacity):
    """expect: (id as text, crc32s of the ids before each place) of each document; every piece's place is its own, without gaps."""
    at = defaultdict(list)
    for r in pieces:
        at[r.sequence_id].append((r.offset, r.length))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    found = sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces)
    assert found == sorted(expect)
    return len(at)


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            n += 1
            gaps.append(capacity - x)
        else:
            gaps.remove(fit)
            gaps.append(fit - x)
    return n


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, awkward, data, capacity):
    tokenizer = Tokenizer.from_file(BYTES)
    for docs in (awkward, spark.read.parquet(f"{data}/documents.parquet")):
        expect, lengths = [], []
        for r in docs.collect():
            ids = np.array(ids_of(tokenizer, r.text), "<u4")
            short = len(ids) % capacity
            ends = [*([short] if short else []), *range(short + capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip([0, *ends], ends)):
                expect.append((str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                lengths.append(b - a)
        used = sound(packing.packed(docs, BYTES, capacity=capacity).collect(), expect, capacity)
        assert -(-sum(lengths) // capacity) <= used <= 1.02 * best_fit(lengths, capacity) + 1


def test_packing_of_equal_lengths_and_nothing(spark, nothing):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words in all of them").alias("text"))
    pieces = packing.packed(docs, BYTES).collect()
    n = pieces[0].length
    assert len(pieces) == 3000 and len({r.sequence_id for r in pieces}) == -(-3000 * n // 2048)
    assert packing.packed(nothing, BYTES).count() == 0


def test_packing_takes_few_plans_and_as_few_sequences_as_best_fit(spark, data):
    """The driver's memory grows with the plans that it runs: their number doesn't follow the lengths, bands or rounds."""
    context, tokenizer = spark.sparkContext, Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    context.setJobGroup("packing", "few plans")
    pieces = packing.packed(docs, BYTES, capacity=256).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("packing"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 15
    assert len({r.sequence_id for r in pieces}) == best_fit([r.length for r in pieces], 256)


def test_steps_follow_the_lengths_not_the_pieces():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 100):
        counts = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, capacity + 1, 60)}
        steps, n = packing.best_fit(counts, capacity), sum(counts.values())
        at, held = np.searchsorted(steps[:, 0], np.arange(n), "right") - 1, defaultdict(list)
        for place, (begin, first, offset, length, each) in enumerate(steps[at].tolist()):
            turn, inside = divmod(place - begin, each)
            held[first + turn].append((offset + inside * length, length))
        for own in held.values():
            assert [o for o, _ in sorted(own)] == [0, *np.cumsum([x for _, x in sorted(own)])[:-1]] and sum(x for _, x in own) <= capacity
        lengths = [x for own in held.values() for _, x in own]
        assert Counter(lengths) == counts and len(held) == best_fit(lengths, capacity)
    many = packing.best_fit({x: 10**9 + x for x in range(1, 2049)}, 2048)
    assert len(many) < 2048 * 12


def test_ranks_are_proven():
    """Of the vocabulary at hand, and not of one in which a pair that isn't listed makes a token too."""
    assert len(packing.mergeable_ranks(BYTES)) == 50_256
    assert len(packing._bytes_of()) == 256 and sorted(packing._bytes_of().values()) == list(range(256))


def test_unproven_vocabularies_go_to_the_library(tmp_path):
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    letters = sorted(packing._bytes_of(), key=lambda c: packing._bytes_of()[c])
    base = {c: i for i, c in enumerate(letters)}
    # "abc" is listed as a + bc, but ab comes first: encoded alone it ends as ab, c
    small = spec | {"added_tokens": [], "model": spec["model"] | {"vocab": base | {"ab": 256, "bc": 257, "abc": 258}, "merges": [["a", "b"], ["b", "c"], ["a", "bc"]]}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(small))
    assert packing.mergeable_ranks(str(path)) is None
    tokenizer, texts = Tokenizer.from_file(str(path)), ["abc x abc abcabc", "aabc bcabc"]
    assert [x.tolist() for x in packing.token_ids([t.encode() for t in texts], str(path))] == [ids_of(tokenizer, t) for t in texts]


def test_ids_of_random_texts():
    import random

    rng, tokenizer = random.Random(8), Tokenizer.from_file(BYTES)
    signs = list("aabbeest'.,-19!\n\n  \t") + ["'s", "é", "Ж", "\xa0", "\u2003", "\U0001f600", "the", "²", "ª", "\xad", "\x1c", "<|endoftext|", ">", "中", "\u0301"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    found = packing.token_ids([t.encode() for t in texts], BYTES)
    assert [x.tolist() for x in found] == [ids_of(tokenizer, t) for t in texts]


def test_ids_of_odd_texts():
    tokenizer = Tokenizer.from_file(BYTES)
    texts = ["", " ", "  ", "a  b", "a \n b", "a\n b", "tab\t x", "it's I'll", "nbsp  x  y", " lead", "trail ", "<|endoftext|> x", "x<|endoftext|>", "é \U0001f600\U0001f600 12345 ab12", "\x1c a", "a\x85 b"]
    found = list(packing.token_ids([t.encode() for t in texts], BYTES))
    assert [x.tolist() for x in found] == [ids_of(tokenizer, t) for t in texts]
