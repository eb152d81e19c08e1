"""Edits as projections: the text changes, size and history follow, the original bytes stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.model import FORMATS
from lodestone.operators.graph import record

#: Formats whose text can be set.
TEXTUAL = [f.format for f in FORMATS.values() if f.edit and f.adapter in ("text", "markup", "json", "yaml-toml", "svg", "source")] + ["rtf"]


def set_text(objects: DataFrame, text: Column, ts: Column | None = None) -> DataFrame:
    """objects (detected_format, text, history, ...) with new text, size, edited_bytes, history and refusal.

    Parsed parts (CSV rows, YAML data) are left as they were. JSON must parse and other
    formats have no text to set: there the row stays as it was and ``refusal`` says why.
    """
    json_bad = (F.col("detected_format") == "json") & F.try_parse_json(text).isNull()
    refusal = F.when(~F.col("detected_format").isin(*TEXTUAL), F.concat(F.lit("unsupported edit op 'set_text' for "), "detected_format")).when(json_bad, "invalid JSON")
    marked = objects.withColumn("__text", text).withColumn("refusal", refusal)
    ok, new = F.col("refusal").isNull(), F.col("__text")
    detail = F.concat(F.lit("text replaced ("), F.char_length(new).cast("string"), F.lit(" chars)"))
    return marked.withColumns(
        {
            "edited_bytes": F.when(ok, F.encode(new, "UTF-8")),
            "size": F.octet_length(F.when(ok, new).otherwise(F.col("text"))).cast("bigint"),
            "history": F.when(ok, record(F.col("history"), "edit.set_text", detail, "STRUCTURAL", ts=ts)).otherwise(F.col("history")),
            "text": F.when(ok, new).otherwise(F.col("text")),
        }
    ).drop("__text")
