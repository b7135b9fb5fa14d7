"""Language-model scores against counts and probabilities worked out plainly."""

import math
import re
from collections import Counter
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import gru, lm


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def held(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def expected(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), held(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows
    )


@pytest.mark.parametrize("known", [None, 3])
def test_base_scores(spark, awkward, monkeypatch, known):
    if known:  # all but three words are then joined from the counts
        monkeypatch.setattr(lm, "lexicon", partial(lm.lexicon, known=known))
    found = lm.scores(awkward, ["doc_id", "row"]).collect()
    mine = sorted((str(r.row.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert mine == expected([(r.doc_id, r.text) for r in awkward.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in found) and {r.row.row for r in found} == {"row"}


def test_empty_and_untaught(nothing, awkward):
    assert lm.scores(nothing, ["doc_id"]).count() == 0
    alone = lm.scores(awkward.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2), ["doc_id"]).collect()
    assert alone and {r.base_score for r in alone} == {0.0} and {r.train_tokens for r in alone} == {0}


def tiny():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(1, 90, 700), np.full(gru.RARE, 5.0))
    for k in p:
        p[k] = p[k] + rng.standard_normal(p[k].shape).astype(np.float32) * 0.1
    return p, rng


def plain_logs(p, numbers, begin):
    """Natural logarithm of a document's probability, number by number, in plain sums."""
    p = {k: v.astype(float) for k, v in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, x, total = np.zeros(gru.HIDDEN), begin, 0.0
    for y in numbers:
        a, b = p["E"][x] @ p["Wx"] + p["bx"], h @ p["U"]
        z, r = np.split(sigmoid(a[: 2 * gru.HIDDEN] + b[: 2 * gru.HIDDEN]), 2)
        h = (1 - z) * np.tanh(a[2 * gru.HIDDEN :] + r * b[2 * gru.HIDDEN :]) + z * h
        classes = np.exp(h @ p["Wc"] + p["bc"])
        if y < gru.WORDS:
            c = y // gru.WIDTH
            members = np.exp(p["Ww"][c * gru.WIDTH : (c + 1) * gru.WIDTH] @ h + p["bw"][c * gru.WIDTH : (c + 1) * gru.WIDTH])
            total += math.log(classes[c] / classes.sum()) + math.log(members[y % gru.WIDTH] / members.sum())
        else:
            total += math.log(classes[gru.HEADS + y - gru.WORDS] / classes.sum())
        x = y
    return total


def test_probabilities_sum_to_one():
    p, rng = tiny()
    h = rng.standard_normal(gru.HIDDEN).astype(np.float32)
    every = np.arange(gru.WORDS + gru.RARE)
    assert abs(np.exp(gru.log_probs(p, np.tile(h, (len(every), 1)), every).astype(float)).sum() - 1) < 1e-3


def test_state_is_carried_through_whole_documents():
    p, rng = tiny()
    docs = [rng.integers(0, gru.WORDS + gru.RARE, n) for n in (1, 400, 37, 37, 5, *rng.integers(1, 60, 40))]
    assert np.allclose(gru.log_likelihood(p, docs, 0, together=64), [plain_logs(p, d, 0) for d in docs], rtol=1e-4)


@pytest.mark.parametrize("known", [None, 30])
def test_scores_worked_out_plainly(spark, awkward, monkeypatch, known):
    """The model's score: the network's probability of each token's number, times the token's share among those of that number."""
    p, _ = tiny()
    monkeypatch.setattr(lm, "_learnt", lambda taught, words, rounds: p)
    if known:
        monkeypatch.setattr(lm, "lexicon", partial(lm.lexicon, known=known))
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    encode = lambda w: lm.END if w is None else w.encode()
    counts = Counter(encode(w) for i, t in rows if not held(i) for w in split(t))
    order = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    if known:  # as many of the most frequent ones as ties allow
        size = len(lm.lexicon(spark.createDataFrame([(bytes(w), c) for w, c in counts.items()], "token binary, c long")).of)
        order = order[:size] if lm.END in order[:size] else [*order[: size - 1], lm.END]
    if order.index(lm.END) >= gru.WORDS:
        order.remove(lm.END)
        order.insert(0, lm.END)
    head = {w: i for i, w in enumerate(order[: gru.WORDS])}
    mass = Counter()
    for w, c in counts.items():
        if w not in head:
            mass[crc32(w[-2:]) % gru.RARE] += c + 1
    expect = []
    for i, t in rows:
        words, total, numbers = [encode(w) for w in split(t)], 0.0, []
        for w in words:
            kind = crc32(w[-2:]) % gru.RARE
            numbers.append(head.get(w, gru.WORDS + kind))
            total += 0 if w in head else math.log((counts[w] + 1) / (mass[kind] + 1))
        expect.append((str(i), (total + plain_logs(p, numbers, head[lm.END])) / math.log(10)))
    found = sorted((str(r.row.doc_id), r.score) for r in lm.scores(awkward, ["doc_id"]).collect())
    for (i, a), (j, b) in zip(found, sorted(expect)):
        assert i == j and abs(a - b) <= 1e-4 * abs(b) + 1e-4


def test_gradients_lower_the_loss():
    """A pattern that only the state can tell: what follows depends on the word before."""
    rng = np.random.default_rng(1)
    follow = rng.permutation(50)
    docs = []
    for _ in range(300):
        d = [int(rng.integers(50))]
        while len(d) < 40:
            d.append(int(follow[d[-1]]))
        docs.append(np.array(d))
    p = gru.initial(np.full(50, 240), np.zeros(gru.RARE) + 1e-3)
    trainer = gru.Trainer(p, {k: np.full_like(v, 1e-6) for k, v in p.items()})
    for _ in range(30):
        for i in range(0, 256, 32):
            trainer.fit(np.concatenate(docs[i : i + 32]), np.full(len(docs[i : i + 32]), 40), 0)
    before, after = (gru.log_likelihood(q, docs[256:], 0).mean() for q in (p, trainer.p))
    assert after > 0.6 * before  # less than 60 per cent of the loss is left


def test_gradients_are_those_of_the_loss(monkeypatch):
    """One window's steps against differences of the loss, for some parameters of every kind."""
    p, rng = tiny()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    numbers, sizes = rng.integers(0, gru.WORDS + gru.RARE, 60).astype(np.int16), np.array([13, 9, 20, 18])
    monkeypatch.setattr(gru, "WINDOW", 64)
    found = {}
    monkeypatch.setattr(gru.Trainer, "_move", lambda self, k, g, rows=slice(None): found.__setitem__(k, (g, rows)))
    gru.Trainer(p, p).fit(numbers, sizes, 0)
    docs = np.split(numbers.astype(int), np.cumsum(sizes)[:-1])
    for k in p:
        g, rows = found[k]
        full = np.zeros(p[k].shape)
        full[rows] = g
        flat = np.argsort(-np.abs(full).ravel())[:3]
        for i in flat:
            losses = []
            for step in (1e-2, -1e-2):
                q = {a: b.astype(float).copy() for a, b in p.items()}
                q[k].ravel()[i] += step
                losses.append(-sum(plain_logs(q, d, 0) for d in docs) / 60)
            assert abs((losses[0] - losses[1]) / 2e-2 - full.ravel()[i]) < 0.02 * abs(full.ravel()[i]) + 1e-4, k


def test_inputs_are_looked_up_once_for_many_steps(monkeypatch):
    """A window's steps, and a block's in scoring, take their inputs' part from one array, which is laid out once."""
    p, rng = tiny()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    docs, seen, step = [rng.integers(0, gru.WORDS, 40).astype(np.int16) for _ in range(20)], [], gru._step
    monkeypatch.setattr(gru, "_step", lambda p, a, before: (seen.append(a.base), step(p, a, before))[1])
    gru.Trainer(p, {k: np.full_like(v, 1e-6) for k, v in p.items()}).fit(np.concatenate(docs), np.full(20, 40), 0)
    windows = len({id(x) for x in seen})
    assert len(seen) >= 40 and all(x is not None for x in seen) and windows <= -(-len(seen) // gru.WINDOW)
    seen.clear()
    gru.log_likelihood(p, docs, 0)
    assert len(seen) >= 40 and len({id(x) for x in seen}) == 1


def test_steps_work_in_one_piece_of_memory(monkeypatch):
    """A step's arrays stand apart from other steps': rows of one array for a whole window lie 16 KB apart, where the processor's
    cache has few places for them. Before, each row of a step was a stretch of such a row."""
    p, rng = tiny()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    docs, seen, step = [rng.integers(0, gru.WORDS, 40).astype(np.int16) for _ in range(20)], [], gru._step

    def kept(w, a, before):
        out = step(w, a, before)
        seen.extend([a, before, *out])
        return out

    monkeypatch.setattr(gru, "_step", kept)
    gru.Trainer(p, {k: np.full_like(v, 1e-6) for k, v in p.items()}).fit(np.concatenate(docs), np.full(20, 40), 0)
    gru.log_likelihood(p, docs, 0)
    assert seen and all(x.flags.c_contiguous for x in seen)


@pytest.mark.parametrize("shifted", ["bc", "bw"])
def test_exponents_that_a_number_cannot_hold(shifted):
    """What all biases have in common plays no part, however large it is: neither in scores nor in steps."""
    p, rng = tiny()
    p = {k: v.astype(np.float32) for k, v in p.items()}
    docs = [rng.integers(0, gru.WORDS + gru.RARE, n).astype(np.int16) for n in (30, 7, 19)]
    found = []
    for q in (p, {k: v + 200 * (k == shifted) for k, v in p.items()}):
        trainer = gru.Trainer(q, {k: np.full_like(v, 1e-6) for k, v in p.items()})
        trainer.fit(np.concatenate(docs), np.array([30, 7, 19]), 0)
        found.append((gru.log_likelihood(q, docs, 0), gru.log_likelihood(trainer.p, docs, 0)))
    assert np.allclose(found[0], found[1], rtol=1e-3)


def test_numbers_as_texts(spark):
    """Every number that the network has comes back from Spark's texts; before, there were arrays, copied number by number."""
    sizes = [0, 3, gru.WORDS + gru.RARE, 1, 0]
    numbers = np.r_[[0, 127, 128], np.arange(gru.WORDS + gru.RARE), 2048].astype(np.int16)
    texts = lm.as_text(numbers, sizes)
    through = spark.createDataFrame(list(enumerate(texts.to_pylist())), "i int, ids string").orderBy("i").toArrow()["ids"].combine_chunks()
    for found in (texts, through, pa.concat_arrays([pa.array(["before"]), texts])[1:]):
        flat, lengths = lm.as_numbers(found)
        assert flat.tolist() == numbers.tolist() and lengths.tolist() == sizes
    assert lm.ENCODED["ids"].dataType.simpleString() == "string"


def test_rare_words_of_each_text():
    """Words that aren't known, each with its times, by text; of none where all are known."""
    words = lm.Lexicon([(b"a", 5), (lm.END, 3)], {k: 10 for k in range(gru.RARE)}, 8, 2)
    found = lm._encoded([b"x a y x", b"", b"y", b"a"], words)[-1].to_pylist()
    assert [sorted((r["token"], r["times"]) for r in rares) for rares in found] == [[(b"x", 2), (b"y", 1)], [], [(b"y", 1)], []]
    assert lm._encoded([b"a", b""], words)[-1].to_pylist() == [[], []] == lm._encoded([b"", b"a A"], words)[-1].to_pylist()


def test_learns_by_default(spark, data):
    docs = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/documents.parquet")
    r = lm.scores(docs, ["doc_id"]).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    print("held-out scores:", r)
    assert r[0] > r[1]  # likelier than by frequency alone, on texts that it hasn't seen


def test_every_training_document_is_learnt(awkward, monkeypatch):
    """Each in one round, whole, and none that is held out."""
    taught = []

    def learnt(sample, words, rounds, inner=lm._learnt):
        taught.extend(r for i in range(rounds) for r in sample.where(F.col("slice") == i).collect())
        return inner(sample, words, rounds)

    monkeypatch.setattr(lm, "_learnt", learnt)
    lm.scores(awkward, ["doc_id"])
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(len(r.ids) for r in taught) == sorted(len(split(t)) for i, t in rows if not held(i))


def test_partitions_do_not_matter(spark, data, monkeypatch):
    """Several shards; the input's partitions change nothing but the order of sums."""
    monkeypatch.setattr(lm, "SHARD", 2000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    few, many = ({r.row.doc_id: r.score for r in lm.scores(docs.repartition(n), ["doc_id"]).collect()} for n in (3, 30))
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-5 * abs(few[i]) for i in few)
