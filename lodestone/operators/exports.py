"""Exports as projections: tables to CSV and JSON, texts to pages, meshes to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import escape_html


def csv_cell(value: Column) -> Column:
    """A cell quoted where it has to be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def table_to_csv(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, csv: header and rows in order. For tables of a file's size; larger ones go to ``df.write.csv``."""
    row = F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns))
    lines = df.agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("__row")))).alias("rows"))
    header = ",".join(columns)
    return lines.select(F.concat(F.lit(header + "\n"), F.array_join(F.transform("rows", lambda r: F.concat(r["__row"], F.lit("\n"))), "")).alias("csv"))


def row_to_json(columns: list[str], cells: Column) -> Column:
    """A row's cells as a JSON object of strings; missing cells are empty."""
    pairs = [F.coalesce(F.get(cells, i), F.lit("")).alias(c) for i, c in enumerate(columns)]
    return F.to_json(F.struct(*pairs))


def text_to(target: str, text: Column, name: Column) -> Column:
    """Text exported as txt, md (in a fence) or html (in a page)."""
    title = F.when(F.coalesce(name, F.lit("")) == "", "Document").otherwise(name)
    if target == "txt":
        return text
    if target == "md":
        return F.concat(F.lit("# "), title, F.lit("\n\n```\n"), text, F.lit("\n```\n"))
    if target == "html":
        head = F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), escape_html(title), F.lit("</title></head><body>"))
        return F.concat(head, F.lit("<pre>"), escape_html(text), F.lit("</pre></body></html>"))
    raise ValueError(f"text cannot be exported as {target}")


def obj_lines(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("v %.6f %.6f %.6f", x, y, z)


def _report(content: dict) -> bytes:
    import json

    return json.dumps({k: v for k, v in content.items() if k not in ("text", "raw", "raw_text", "preview_positions")}, indent=2, ensure_ascii=False, default=str).encode()


def export_bytes(content: dict, blobs: dict, data: bytes, name: str, fmt: str, target: str) -> bytes:
    """The object as a file of the target format; ValueError says why not."""
    import html
    import json

    import numpy as np

    from lodestone.operators.catalog import refusal
    from lodestone.parsers import images, meshes, structured, texts

    if why := refusal(fmt, target):
        raise ValueError(why)
    text = content.get("text") or content.get("raw_text") or ""
    raw = content.get("raw") or text
    if fmt in images.DECODERS or fmt == "gif":
        px = images.pixels_of(data, fmt) if not content.get("pixels") else np.frombuffer(blobs[content["pixels"]["__blob__"]], np.uint8).reshape(content["height"], content["width"], 4)
        return images.ENCODERS[target](px)
    if fmt in ("jpeg", "webp", "tiff"):
        raise ValueError(f"{fmt} has no decoder here")
    if fmt in ("obj", "stl", "gltf", "glb") and target in ("obj", "stl") and target != fmt:
        if fmt == "obj":
            return meshes.encode_stl(meshes.obj_triangles(data.decode("utf-8", "replace")))
        points = meshes.stl_triangles(data) if fmt == "stl" else np.array(content.get("preview_positions", [])).reshape(-1, 3)[: len(content.get("preview_positions", [])) // 9 * 3].reshape(-1, 3, 3)
        return meshes.encode_obj(points)
    if fmt == "csv" and target == "json":
        rows = [{c: (r[k] if k < len(r) else "") for k, c in enumerate(content["columns"])} for r in content["rows"]]
        return json.dumps(rows, indent=2, ensure_ascii=False).encode()
    if fmt in ("json", "yaml", "toml", "bson") and target in ("json", "yaml", "toml", "csv") and target != fmt or (fmt, target) == ("json", "json"):
        tree = content.get("data")
        made = {"json": structured.pretty, "yaml": structured.to_yaml, "toml": structured.to_toml, "csv": structured.to_csv}[target](tree)
        if made is None:
            raise ValueError(f"this data cannot be written as {target}")
        return made.encode()
    if target == "sql":
        return "\n\n".join(f"{r['sql']};" for r in content.get("schema", []) if r.get("sql")).encode()
    if fmt == "wav" and target == "txt":
        return json.dumps(content.get("peaks", [])).encode()
    if fmt in ("zip", "tar", "gzip") and target == "json":
        return json.dumps(content.get("entries", []), indent=2, ensure_ascii=False).encode()
    if target == "json" and fmt != "sfp":
        return _report(content)
    if target == "rtf":
        return texts.write_rtf(text)
    if target == "html":
        title = html.escape(name or "Document")
        if fmt == "html":
            return raw.encode()
        body = texts.markdown_html(text) if fmt == "md" else "".join(f"<p>{html.escape(p)}</p>" for p in content["paragraphs"]) if content.get("paragraphs") else f"<pre>{html.escape(text)}</pre>"
        return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title></head><body>{body}</body></html>".encode()
    if target == "md":
        return text.encode() if fmt == "md" else f"# {name or 'Document'}\n\n```\n{text}\n```\n".encode()
    if fmt == "sfp" and target in ("json", "txt"):
        return json.dumps(content.get("manifest", []), indent=2, ensure_ascii=False).encode() if target == "json" else content.get("tree", "").encode()
    if target == "txt":
        if fmt in ("pe", "elf", "blob", "empty"):
            from lodestone.parsers.database import hex_lines

            return (hex_lines(data) + ("\n\n" + _report(content).decode() if fmt in ("pe", "elf") else "")).encode()
        return (raw if fmt in ("svg", "json", "yaml", "toml") else text).encode()
    edited = blobs.get("edited_bytes")
    return edited if edited is not None else data


def export_objects(objects: DataFrame, target: str) -> DataFrame:
    """object_id, filename, mime, kind, data, refusal, history of each object as a ``target`` file, in one pass without a shuffle.

    A conversion that doesn't exist or can't be done is a row with its refusal; only
    files that were made add a step to the history, with the edge's kind, and containers add none.
    Rows are independent, so repeated ids are fine.
    """
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    from lodestone.functions.scalar import stem
    from lodestone.model import EXPORTS, FORMATS
    from lodestone.operators.graph import record

    carried = ["object_id", "original_filename", "detected_format", "history"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for row in batch.select(["content", "blobs", "original_bytes", "original_filename", "detected_format"]).to_pylist():
                try:
                    made = export_bytes(json.loads(row["content"] or "{}"), dict(row["blobs"] or []), row["original_bytes"] or b"", row["original_filename"] or "", row["detected_format"], target), None
                except Exception as error:
                    made = None, str(error) or type(error).__name__
                for column, value in zip(out, made):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=[*carried, "data", "refusal"])

    if target == "sfp":
        from lodestone.sources.files import to_containers

        made = to_containers(objects, keep=carried[1:]).withColumnRenamed("container", "data").withColumn("refusal", F.lit(None).cast("string"))
    else:
        given = objects.select(*carried, "content", "blobs", "original_bytes")
        made = given.mapInArrow(run, given.select(*carried).schema.add("data", "binary").add("refusal", "string"))
    extension = FORMATS[target].extension.split(",")[0] if target in FORMATS else target
    kinds = F.create_map(*(x for f, edges in EXPORTS.items() for x in (F.lit(f), F.lit(dict(edges).get(target, "")))))
    kind = F.nullif(kinds[F.col("detected_format")], F.lit(""))
    named = made.withColumns({"filename": F.concat(stem(F.col("original_filename")), F.lit("." + (extension or "bin"))), "kind": kind})
    detail = F.concat(F.lit("exported to "), "filename", F.lit(" ["), "kind", F.lit("]"))
    longer = record(F.col("history"), f"export:{target}", detail, F.col("kind"), F.to_json(F.struct(F.lit(target).alias("format"))))
    mime = F.lit(FORMATS[target].mime if target in FORMATS else "text/plain").alias("mime")
    history = F.col("history") if target == "sfp" else F.when(F.col("refusal").isNull(), longer).otherwise(F.col("history"))
    return named.select("object_id", "filename", mime, "kind", "data", "refusal", history.alias("history"))
