"""Inspection reports of parsed objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pandas as pd


@F.pandas_udf(T.StringType())
def json_shape(text: pd.Series) -> pd.Series:
    """Shape of a JSON text (keys in their order), as JSON; null if it doesn't parse."""
    import json

    from lodestone.parsers.structured import shape

    def one(t):
        try:
            return json.dumps(shape(json.loads(t)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return text.map(one)


def report(objects: DataFrame) -> DataFrame:
    """object_id, report: general, structure and format parts as one JSON text."""
    general = F.struct(
        "object_id", "original_filename", "object_type", "size", F.col("checksum").alias("hash"), "warnings", F.col("history").alias("transformations"), F.size("kids").alias("children"),
        F.col("original_bytes").isNotNull().alias("original_bytes_preserved"),
    )
    shape = F.struct("detected_format", "mime", "support_level", "capabilities", "adapter")
    structure: Column = json_shape("content")
    return objects.select("object_id", F.to_json(F.struct(general.alias("general"), structure.alias("structure"), shape.alias("format"))).alias("report"))
