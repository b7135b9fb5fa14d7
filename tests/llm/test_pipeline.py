"""Every stage of the pipeline against a plain version, each on what the stage before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import linked_ids, print_of, without_lines
from test_mixing_packing import filled, sound

import corpus_pipeline
from quarry.llm.common import saved, table
from quarry.llm.quality import quality_scores


@pytest.fixture(scope="module")
def kept(spark, data):
    """What each stage was given and what it made."""
    docs, out = table(spark, data, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        made = saved(step(spark, docs, data), "test")
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_keep_columns(spark, data, kept):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, made in kept[:-1]:
        assert made.dtypes == table(spark, data, "documents").dtypes


def test_quality(spark, data, kept):
    docs, made = kept[0]
    scored = quality_scores(docs, table(spark, data, "labels"), docs.columns).where("score >= 0.7").select("row.*")
    assert sorted(rows(made)) == sorted(rows(scored)) and 0 < made.count() < docs.count()


def test_lines(kept):
    docs, made = kept[1]
    expect = [(i, t) for i, t, _, _ in without_lines([(r.doc_id, r.text) for r in docs.collect()])]
    assert sorted((str(r.doc_id), r.text) for r in made.collect()) == sorted(expect)
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_copies(kept):
    docs, made = kept[2]
    groups = linked_ids([(r.doc_id, print_of(r.text)) for r in docs.collect()])
    assert sorted(str(r.doc_id) for r in made.collect()) == sorted(i for i, _, c in groups if i == c)


def test_mix(kept):
    docs, made = kept[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    times, given = Counter(r.doc_id for r in made.collect()), {r.doc_id: r for r in docs.collect()}
    assert set(rows(made)) <= set(rows(docs)) and all(n <= 2 for n in times.values())
    before, after, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, r in given.items():
        before[r.source] += size(r.text)
        after[r.source] += times[i] * size(r.text)
        longest[r.source] = max(longest[r.source], size(r.text))
    for s, target in filled(before).items():
        assert abs(after[s] - target) <= longest[s]


def test_pack(kept):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, made = kept[4]
    tokenizer, expect = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        short = len(ids) % 2048
        ends = [*([short] if short else []), *range(short + 2048, len(ids) + 1, 2048)]
        expect += [(str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    sound(made.withColumnRenamed("doc_id", "id").collect(), expect, 2048)


def test_run(spark, data, kept):
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(kept[4][1])


def test_run_leaves_only_its_result(spark, data):
    from quarry.llm.common import shared_folder

    import glob

    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/quarry/*"))
    corpus_pipeline.run(spark, data).count()
    left = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/quarry/*")) - before
    assert [x for x in left if "/stage" not in x] == [] and len(left) == 1


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_documents_in_every_stage(spark, data, awkward, nothing, empty):
    """Nulls, repeated rows, long texts and clashing columns, or no rows at all, through stages that aren't stored in between."""
    docs, columns = (nothing, nothing.columns) if empty else (awkward, awkward.columns)
    steps = dict(corpus_pipeline.STAGES)
    for name in ("quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights"):
        made = steps[name](spark, docs, data)
        n = made.count()
        assert made.columns == columns
        if name == "quality classifier":
            scores = quality_scores(docs, spark.read.parquet(f"{data}/labels.parquet"), ["doc_id"])
            assert n == scores.where(F.col("score") >= corpus_pipeline.LEAST_QUALITY).count()
        else:
            assert (n == 0) == empty
        if name in ("line dedup", "SimHash near-dedup"):
            docs = made  # two stages in a row, lazily
    packed = steps["best-fit packing"](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_workers_hold_little(spark, data):
    """Texts come to Python in small batches, and what a worker keeps for one operator goes when it turns to another."""
    from pyarrow import array

    from quarry.llm import common, packing
    from quarry.llm.queries import BYTE_VOCABULARY

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield b.from_arrays([array([b.nbytes])], names=["n"])

    with common.small_batches(spark):
        inside = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert len(inside) > 5 and max(inside) < 2 * common.BATCH_BYTES and spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")
    with common.small_batches(spark):
        assert spark.conf.get(key) == "1m"
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)

    def held(batches):
        for _ in packing.token_ids([b"some words here"], BYTE_VOCABULARY):
            pass
        before = len(common._kept)
        common.turned_to("simhash")
        for b in batches:
            yield b.from_arrays([array([before]), array([sum(k != "simhash" for k in common._kept)])], names=["n", "after"])

    assert {(r.n, r.after) for r in texts.limit(1).mapInArrow(held, "n long, after long").collect()} == {(1, 0)}
