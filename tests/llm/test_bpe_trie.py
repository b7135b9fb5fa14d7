"""Ids and texts equal the tokenizers library's."""

import hashlib
import json
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm.bpe_trie import Encoder, decode, decoded, encoded
from quarry.llm.queries import BYTE_VOCABULARY, QUERIES, WORD_VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return Encoder(WORD_VOCABULARY)


def same(own, library, texts):
    got = own.ids([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(array("I", ids)) == want, text
        assert decode(ids, own.vocabulary.strings) == library.decode(want, skip_special_tokens=False), text


def test_runs_of_one_character_and_prefixes(own, library):
    words = ["a" * k for k in range(1, 120)] + ["ab" * k for k in range(1, 60)] + ["x" * 5000, "the" * 400]
    same(own, library, words + [w[:k] for w in ("internationalization", "counterrevolutionaries", "Donaudampfschifffahrt") for k in range(1, 22)])


def test_added_tokens_marks_and_scripts(own, library):
    same(own, library, [
        "", " \n\t ", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "don't I'LL we've 's", "word.,;:!? word...word", "Σ ΑΣ ςΣΑ İstanbul",
        "é é ́a", "日本語 한국어 😀👍🏽", "1234 ½ ٣", "\x1c\x1d\x85 　a b", "\x00\x01", "a​b",
    ])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_texts(own, library, texts):
    same(own, library, [t.encode("utf-8", "replace").decode() for t in texts])


def test_joined_tokens(own, library):
    rng = random.Random(5)
    parts = [t.replace("</w>", "") for t in library.get_vocab() if t.isascii()]
    same(own, library, [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(20)) for _ in range(500)])


def test_full_tables_change_nothing(library, monkeypatch):
    from quarry.llm import bpe_trie

    for name, most in (("MEMO", 5), ("MOST_NODES", 30), ("MOST_PAIRS", 10)):
        monkeypatch.setattr(bpe_trie, name, most)
    small, rng = Encoder(WORD_VOCABULARY), random.Random(6)
    for _ in range(20):
        same(small, library, [" ".join(rng.choice(["alpha", "alphabet", "beta", "betas", "gamma", "delta9", "x" * 30]) for _ in range(12)) for _ in range(4)])


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        Encoder(BYTE_VOCABULARY)  # names a decoder
    with open(WORD_VOCABULARY, encoding="utf-8") as file:
        spec = json.load(file)
    first, second = spec["model"]["merges"][:2]
    spec["model"]["merges"][:2] = [second, first]
    spec["model"]["merges"].append(first)
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "other.json"))


def test_rows(spark, awkward, nothing, library):
    got = decoded(encoded(awkward, ["doc_id", "text", "row", "id"], WORD_VOCABULARY), WORD_VOCABULARY).collect()
    assert len(got) == awkward.count()
    for r in got:
        want = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert list(array("I", bytes(r.ids))) == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert encoded(nothing, ["doc_id"], WORD_VOCABULARY).count() == 0


def test_query(spark, data, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_bpe"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_one_worker_a_task(spark, data, awkward):
    """Each Python step of a task has a worker of its own, with tables of its own: the query has one step."""
    plan = QUERIES["op13_bpe"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    once = encoded(awkward, ["doc_id"], WORD_VOCABULARY, with_decoded=True)
    twice = decoded(encoded(awkward, ["doc_id"], WORD_VOCABULARY), WORD_VOCABULARY)
    assert once.schema == twice.schema and once.exceptAll(twice).count() == twice.exceptAll(once).count() == 0


def test_decoding_alone_takes_strings_alone(library, monkeypatch):
    from quarry.llm import bpe_trie

    monkeypatch.setattr(bpe_trie, "_loaded", {})
    ids = library.encode("Words, and <|endoftext|> more", add_special_tokens=False).ids
    assert decode(array("I", ids).tobytes(), bpe_trie.strings(WORD_VOCABULARY)) == library.decode(ids, skip_special_tokens=False)
    assert not bpe_trie._loaded
    with pytest.raises(ValueError):
        bpe_trie.strings(BYTE_VOCABULARY)  # names a decoder
