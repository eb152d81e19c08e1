"""Audio and mesh relations: waveform peaks, tones and triangle faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def waveform(samples: DataFrame, key: str, index: Column, value: Column, buckets: int = 240) -> DataFrame:
    """key, bucket, peak: the greatest amplitude of each bucket of a file's samples, as a share of 32768.

    samples: one row a sample (16 bits); a bucket holds max(1, n // buckets) samples and the rest behind the last is left out.
    """
    rows = samples.select(F.col(key), index.alias("i"), value.alias("v"))
    sizes = rows.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / buckets)).alias("step"))
    placed = rows.join(sizes, key).withColumn("bucket", F.floor(F.col("i") / F.col("step")))
    return placed.filter(F.col("bucket") < buckets).groupBy(key, "bucket").agg(F.round(F.max(F.abs("v")) / 32768, 3).alias("peak"))


def tone(spark: SparkSession, frequency: float = 440.0, seconds: float = 0.5, rate: int = 22050) -> DataFrame:
    """i, value of a sine tone in 16 bits (0.05 to 10 seconds), truncated toward zero."""
    n = int(rate * max(0.05, min(10.0, seconds)))
    at = F.col("id") * F.lit(2 * 3.141592653589793 * frequency / rate)
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(20000) * F.sin(at)).cast("int").alias("value"))


def blob_pattern(spark: SparkSession, size: int) -> DataFrame:
    """i, byte of the generated test blob (a million bytes at most)."""
    return spark.range(max(0, min(1_000_000, size))).select(F.col("id").alias("i"), F.expr("(id * 37 + 11) & 255").cast("int").alias("byte"))


def fan_triangles(faces: DataFrame, key: list[str]) -> DataFrame:
    """One row a triangle (a, b, c) of polygons (corners array<int>, 1-based or negative from ``vertices``): a fan around the first corner."""
    fixed = F.transform("corners", lambda c: F.when(c < 0, F.col("vertices") + c).otherwise(c - 1))
    spread = faces.filter(F.size("corners") >= 3).select(*key, fixed.alias("c")).select(*key, "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("k"))
    return spread.select(*key, "k", F.col("c")[0].alias("a"), F.expr("c[k]").alias("b"), F.expr("c[k + 1]").alias("c"))


def by_time(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events as samples: index i within the key, value scaled to 16 bits."""
    return events.select(key, (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).alias("i"), F.col(value).alias("value"))
