"""Catalog operators: search, applicable transforms and export edges of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import model


def search(formats: DataFrame, asked: str) -> DataFrame:
    """Formats whose name, extensions, category or mime hold the text, whatever its case."""
    return formats.filter(F.contains(F.lower(F.concat("format", "extension", "category", "mime")), F.lit(asked.lower())))


def applicable(objects: DataFrame) -> DataFrame:
    """objects x transforms that apply: the type matches and the format is listed (or none is).

    Both sides meet on the type, which the 20-row registry is exploded by; it is broadcast.
    """
    registry = model.transforms(objects.sparkSession).select("id", "label", "kind", F.col("formats").alias("__formats"), F.explode("applies_to").alias("__type"))
    listed = (F.size("__formats") == 0) | F.array_contains("__formats", F.col("detected_format"))
    return objects.join(F.broadcast(registry), (F.col("object_type") == F.col("__type")) & listed).drop("__formats", "__type")


def export_edges(objects: DataFrame) -> DataFrame:
    """objects x their export targets (the matrix has a fixed size and is broadcast)."""
    matrix = model.exports(objects.sparkSession).withColumnRenamed("format", "__format")
    return objects.join(F.broadcast(matrix), F.col("detected_format") == F.col("__format")).drop("__format")


def refusal(source: str, target: str) -> str | None:
    """Why a conversion is refused; null where an edge exists and an encoder is at hand."""
    edges = dict(model.EXPORTS.get(source, []))
    if target not in edges:
        return f"{source} cannot be exported as {target}; targets: {', '.join(edges)}"
    if target == "ppm" and source in ("png", "bmp", "gif", "jpeg", "webp", "tiff"):
        return "ppm is written by a plugin only"
    return None
