"""Corpus pipeline: quality rules, exact dedup, near-dedup, substring dedup, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all rows that its predecessor
kept; an empty table gives an empty one, and columns beyond those of ``documents`` go. All but the last return the columns of ``documents``; the last returns the packed
pieces. ``run`` writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, minhash, packing, quality, suffix_tree
from lodestone.llm.common import documents, materialise
from lodestone.llm.registry import BYTE_BPE, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and blank texts fail, each of several equal rows is judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id (null counts as empty; null ids go first; of rows equal in id and text one stays)."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id.

    Documents without words have no near-duplicates and stay.
    """
    return minhash.keep_one(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that start more than once; those left without a word go.

    A text that loses nothing keeps its own white space; null texts and texts without words stay as they are.
    """
    cut = suffix_tree.remove_repeated_words(docs, carry=tuple(COLUMNS))
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("text"))
    return cut.filter("n_removed < n_words OR n_words = 0").select(
        "row.doc_id", text.alias("text"), "row.lang", "row.source", F.char_length(text).cast("bigint").alias("n_chars")
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of at most 1024; null and empty texts are their end id alone."""
    return packing.best_fit_pack(docs, tokenizer(BYTE_BPE))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: The thresholds, links and tokens of the stages can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
