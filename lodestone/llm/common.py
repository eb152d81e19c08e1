"""Helpers shared by the operators of this subpackage.

Words are maximal runs of characters other than the six ASCII white-space
characters (space and U+0009 to U+000D); every other character, no-break spaces
included, belongs to a word.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators between words.
BLANKS = " \t\n\x0b\f\r"
#: Java pattern for a run of separators.
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
#: Folder used where the session names none (tests, local runs).
LOCAL_SHARED = "file:///tmp/checkpoints/lodestone"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or on a local master a local one where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row (Catalyst would inline it once for each use)."""
    return F.transform(F.array(value), body)[0]


def row_key() -> list[Column]:
    """Columns (id, row_hash) that tell rows apart even where doc_id is null or repeated.

    Rows with equal id and equal text are interchangeable for every operator here.
    """
    return [F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("")), "doc_id").alias("row_hash")]
