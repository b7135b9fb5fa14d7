"""The registered queries of the training-data operators, each over its whole table, and SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, mixing, prefix_trie, spelling, topk
from quarry.llm.common import fresh_path, table

#: Vocabularies of public tokenizers: for counts, and for packed sequences.
WORD_VOCABULARY, BYTE_VOCABULARY = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every whole document, learnt from six in seven."""
    from quarry.llm.lm import scores

    found = scores(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    from quarry.llm.topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document; the cache starts empty, so that every distinct text is encoded."""
    from quarry.llm.token_counts import cached_counts

    counts = cached_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY, fresh_path(spark, "token-cache"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    from quarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole document and their places in sequences of 2048 tokens."""
    from quarry.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"), BYTE_VOCABULARY).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole document before and after those that many documents share have gone."""
    from quarry.llm.line_dedup import without_repeated_lines

    found = without_repeated_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole document, learnt from the labels of three in four."""
    from quarry.llm.quality import quality_scores

    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("row.doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and how like they are."""
    from quarry.llm.fingerprints import with_edits

    return with_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document, and the smallest id that links of at most four bits lead to."""
    from quarry.llm.simhash import near_copies

    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    from quarry.llm.html_text import visible_text

    return visible_text(table(spark, sf_dir, "pages"), ["page_id"]).select("row.page_id", "text")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants: near words, forms and roots."""
    from quarry.llm.spelling import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations, with sums over their subtrees."""
    from quarry.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document, and the text that they decode to, as digests."""
    from quarry.llm.bpe_trie import encoded

    found = encoded(table(spark, sf_dir, "documents"), ["doc_id"], WORD_VOCABULARY, with_decoded=True)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return found.select("row.doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_topk": op2_topk,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_simhash": op9_simhash,
    "op10_html_text": op10_html_text,
    "op11_spelling": op11_spelling,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
