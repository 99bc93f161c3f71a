"""From raw documents to packed sequences: quality rules, repeated passages, near copies, secrets, packing.

Each stage is written as Parquet and read again by the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import line_dedup, packing, quality_rules, secrets, shingle_join
from faultline.llm.common import table, unused
from faultline.sources.deploy import ship_package
from faultline.sources.shared import materialise


def _recounted(docs: DataFrame) -> DataFrame:
    """`n_chars` after a change of the text, if the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; so do null and empty texts, which have too few words. Repeated rows are judged
    each, whole texts however long; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three lines go; so do documents that consist of nothing else.

    Null and empty texts have no lines and stay. Rows with equal key and text are one document, cut alike; an empty table
    stays empty; columns may have any names."""
    (removed,) = unused(docs, "n_removed_lines")
    cut = line_dedup.remove_repeated(docs, n_removed=removed)
    left = cut.filter((F.col(f"`{removed}`") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(removed)
    return _recounted(left)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity of 0.8 or more.

    Null and empty texts and rows with a null key are no group and stay; rows that repeat a key stay or go together."""
    return shingle_join.one_of_each(docs, width=5, percent=80)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; all documents stay, null and empty texts as they are."""
    return _recounted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence. Null and empty texts are their end mark alone."""
    return packing.pack(docs)


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _shipped(quality)),
    ("line_dedup", _shipped(passages)),
    ("shingle_join", _shipped(near_copies)),
    ("secret_scans", _shipped(secret_spans)),
    ("packing", _shipped(packed)),
]

#: The tokenizer, the sketches and the decoding of secrets have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
