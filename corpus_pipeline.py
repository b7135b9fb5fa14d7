"""From raw documents to packed sequences: the five stages of a training corpus, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between stages
the documents are written as Parquet and read again, so that a lost executor costs no more than the stage at hand.

A stage's result may be read from working tables in the shared folder. They stay as long as the caller needs them: `scope()` of
quarry.llm.common collects their paths, and `drop_tables` removes them, as `run` does for each stage once its result is stored.

Defined results: documents with null, empty or repeated ids and texts go through every stage row by row, as the operators say; an
empty table gives an empty result; columns beside doc_id, text and source are carried along whatever their names are (n_chars, if
there is one, is counted anew where lines go).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, saved, scope, table
from quarry.llm.queries import BYTE_VOCABULARY

#: A document stays if its quality score is at least this.
LEAST_QUALITY = 0.7

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels beside them, doesn't reject."""
    from quarry.llm.quality import quality_scores

    scored = quality_scores(docs, table(spark, sf_dir, "labels"), docs.columns)
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars is counted anew. No document goes."""
    from quarry.llm.line_dedup import without_repeated_lines

    left = without_repeated_lines(docs, docs.columns).select("row.*", F.col("text").alias("left text"))
    new = {"text": F.col("left text"), "n_chars": F.char_length("left text").cast("long")}
    return left.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links, the row with the smallest id (null last, repeated rows one by one)."""
    from quarry.llm.simhash import near_copies

    rows = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    own = F.struct(F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("id"), "row")
    groups = near_copies(rows.select(own.alias("id"), "doc.text"), "id")
    kept = groups.where(F.col("id") == F.col("component_id")).select("id.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them."""
    from quarry.llm.mixing import mix

    mixed = mix(docs, docs.columns, whole_documents=True).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return mixed.select("row", copies.alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token's place in a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    from quarry.llm.packing import packed

    return packed(docs, BYTE_VOCABULARY).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", keep_one_copy),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier, SimHash's hashes and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the stored result stays in the shared folder."""
    docs, given = table(spark, sf_dir, "documents"), []
    for i, (_, step) in enumerate(STAGES):
        with scope() as working:
            made = step(spark, docs, sf_dir)
        with scope() as stored:
            docs = saved(made, f"stage{i + 1}")
        drop_tables(spark, [*working, *given])
        given = stored
    return docs
