"""Incremental ingest: a stream of new files as objects. An extension: the operators it runs are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import LIMITS
from lodestone.sources.files import identify


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """name, path, data of files as they arrive under ``path``; larger ones than the limit are left out before their bytes are read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") <= LIMITS.file_bytes).select(F.substring_index("path", "/", -1).alias("name"), "path", F.col("content").alias("data"))


def stream_objects(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Identified objects of the stream; parse in foreachBatch with ``sources.files.parse_objects``."""
    return identify(stream_files(spark, path, files_per_batch))
