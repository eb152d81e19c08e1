"""Queries over parsed files: made from the driver's tables, written as bytes, imported, transformed and exported again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import crypto
from lodestone.functions.arrow import once
from lodestone.operators import creators, exports, inspect, text, transforms
from lodestone.plans.queries import docs, query, table
from lodestone.sources import files


def _files(df: DataFrame, key: str, body, name) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("path"), name.alias("name"), body.alias("data"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file."""
    return _files(docs(spark, sf_dir), "doc_id", F.encode("text", "UTF-8"), F.concat(F.lit("doc"), "doc_id", F.lit(".md")))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as a JSON file."""
    return _files(table(spark, sf_dir, "events"), "event_id", F.encode("props", "UTF-8"), F.concat("event_id", F.lit(".json")))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def doc_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents imported as objects: detected, parsed, checksummed."""
    objects = files.import_files(_documents(spark, sf_dir))
    return objects.filter(F.col("content").isNotNull()).select(F.regexp_extract("original_filename", r"(\d+)", 1).cast("bigint").alias("doc_id"), "checksum", "size")


@query()
def doc_md_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = transforms.run(files.import_files(_documents(spark, sf_dir)), "text.markdown_to_html")
    return objects.select("original_filename", "refusal", F.size("history").alias("steps"), F.md5("content").alias("content_md5"))


@query("SELECT doc_id, true AS same FROM documents")
def doc_rtf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text written as RTF and read back: the same but for outer blanks, blank lines and the mark behind non-ASCII characters."""

    @F.pandas_udf(T.BooleanType())
    def same(t: pd.Series) -> pd.Series:
        import re

        from lodestone.parsers.texts import rtf_text, write_rtf

        def one(x: str) -> bool:
            x = "".join(c if ord(c) < 65536 else "?" for c in x)
            want = re.sub(r"\n{3,}", "\n\n", "".join(c if ord(c) < 128 else c + "?" for c in x)).strip()
            return rtf_text(write_rtf(x).decode())[0] == want

        return t.map(one)

    return docs(spark, sf_dir).select("doc_id", same("text").alias("same"))


@query("""SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<a\\s[^>]*href=')) AS links FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _files(table(spark, sf_dir, "pages"), "page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8"), F.concat("page_id", F.lit(".html")))
    objects = files.parse_objects(pages.select(F.col("path").alias("object_id"), F.col("name").alias("original_filename"), F.lit("html").alias("detected_format"), F.col("data").alias("original_bytes")))
    return objects.select(F.col("object_id").cast("bigint").alias("page_id"), F.json_array_length(F.get_json_object("content", "$.links")).cast("bigint").alias("links"))


@query()
def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("object_id"), F.lit("p.html").alias("original_filename"), F.lit("html").alias("detected_format"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("original_bytes"))
    return files.parse_objects(pages).select("object_id", F.get_json_object("content", "$.tag_counts").alias("tag_counts"))


@query()
def page_html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.coalesce("html", F.lit(""))).alias("plain"))


def _json_text(spark: SparkSession, sf_dir: str, name: str, field: str) -> DataFrame:
    done = transforms.run(files.import_files(_events(spark, sf_dir)), name)
    return done.select(F.regexp_extract("original_filename", r"(\d+)", 1).cast("bigint").alias("event_id"), F.get_json_object("content", field).alias("out"))


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS out FROM events")
def event_json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_text(spark, sf_dir, "json.pretty", "$.text")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS out FROM events")
def event_json_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_text(spark, sf_dir, "json.minify", "$.text")


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || chr(10) AS out FROM events")
def event_json_to_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_text(spark, sf_dir, "json.to_yaml", "$.derived.yaml")


@query("SELECT event_id, 'k = ' || json_extract_string(props, '$.k') || chr(10) AS out FROM events")
def event_json_to_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _json_text(spark, sf_dir, "json.to_toml", "$.derived.toml")


@query("SELECT event_id, '{\"k\": \"int\"}' AS shape FROM events")
def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", inspect.json_shape("props").alias("shape"))


def _created(spark: SparkSession) -> DataFrame:
    wanted = [("text", {"text": "hello"}), ("markdown", {"text": "# T\n\n- a"}), ("csv", {"text": "a,b\n1,2\n"}), ("html", {"text": "<!doctype html><p>x</p>"}), ("json", {"data": [{"a": 1}]}), ("yaml", {"data": {"a": 1}}), ("toml", {"data": {"a": 1}}), ("svg", {}), ("animation", {}), ("audio", {}), ("source", {}), ("pdf", {"text": "one\ntwo"}), ("docx", {"text": "one\ntwo"}), ("epub", {"text": "body"}), ("wasm", {}), ("blob", {}), ("project", {})]
    wanted += [("image", {"pattern": p, "width": 48, "height": 32}) for p in ("gradient", "checker", "plasma")]
    wanted += [("archive", {"format": f, "files": [("a.txt", "x"), ("d/b.txt", "y")]}) for f in ("zip", "tar", "tar.gz")] + [("mesh", {"format": f}) for f in ("obj", "stl", "glb")]
    return creators.create_files(spark, wanted)


@query()
def created_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of every creator, imported."""
    return files.import_files(_created(spark)).select("original_filename", "detected_format", "object_type", "size", "checksum", "support_level", "warnings", "content")


@query()
def created_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every created file exported as text, JSON, PNG and container: files or refusals."""
    objects = files.import_files(_created(spark))
    out = None
    for target in ("txt", "json", "png", "sfp"):
        one = exports.export_objects(objects, target).select("filename", F.lit(target).alias("target"), "kind", F.length("data").alias("size"), "refusal")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def inspect_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.report(files.import_files(_created(spark)))


@query("SELECT doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS checksum FROM documents")
def zip_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document packed into an archive (zip, tar or tar.gz by turns), extracted and imported again."""
    def pack(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from lodestone.parsers import array_pieces
        from lodestone.parsers.archives import create

        for keys, texts in array_pieces(batches):
            yield pa.array([create([(f"doc/{k}", (t or "").encode())], ("zip", "tar", "tar.gz")[k % 3]) for k, t in zip(keys.to_pylist(), texts.to_pylist())], pa.binary())

    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, ("zip", "tar", "tar.gz"))), F.pmod("doc_id", F.lit(3)).cast("int")))
    packed = docs(spark, sf_dir).select(name.alias("name"), name.alias("path"), once(pack, T.BinaryType())("doc_id", "text").alias("data"))
    inner, _ = files.extract_archives(files.identify(packed))
    return inner.select(F.substring_index("path", "/", -1).alias("path"), F.sha2("data", 256).alias("checksum"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum, 1 AS steps FROM documents")
def sfp_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved as containers and loaded again: bytes and history survive."""
    saved = files.to_containers(files.identify(_documents(spark, sf_dir)))
    back = files.from_containers(saved)
    name = F.get_json_object("meta", "$.original_filename")
    return back.select(F.regexp_extract(name, r"(\d+)", 1).cast("bigint").alias("doc_id"), F.sha2(F.coalesce("original_bytes", F.lit(b"")), 256).alias("checksum"), "steps")


@query("SELECT doc_id, true AS sealed, true AS hidden, sha256(coalesce(text, '')) AS checksum FROM documents")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a container, encrypted and decrypted."""
    return _sealed_and_opened(docs(spark, sf_dir))


@query("SELECT doc_id, true AS sealed, true AS hidden, sha256(coalesce(text, '')) AS checksum FROM documents")
def encrypt_roundtrip_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as containers, encrypted and decrypted."""
    return _sealed_and_opened(docs(spark, sf_dir))


def _sealed_and_opened(some: DataFrame) -> DataFrame:
    """Salt and nonce are fixed here only so that the queries repeat."""
    salt, nonce = b"0123456789abcdef", b"n" * 32
    given = _files(some, "doc_id", F.encode("text", "UTF-8"), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    plain = files.to_containers(files.identify(given))
    sealed = crypto.encrypt_containers(plain, "secret", salt, nonce)
    hidden = ~F.contains(F.decode("container", "ISO-8859-1"), F.lit("original_filename"))
    told = sealed.select("object_id", "container", crypto.is_encrypted(F.col("container")).alias("sealed"), hidden.alias("hidden"))
    opened = files.from_containers(crypto.decrypt_containers(told, "secret", keep=["sealed", "hidden"]), keep=["sealed", "hidden"])
    name = F.get_json_object("meta", "$.original_filename")
    return opened.select(F.regexp_extract(name, r"(\d+)", 1).cast("bigint").alias("doc_id"), "sealed", "hidden", F.sha2(F.coalesce("original_bytes", F.lit(b"")), 256).alias("checksum"))


@query("SELECT i AS id, true AS png, true AS bmp, true AS gif FROM range(24) r(i)")
def image_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rasters encoded and decoded again; GIF shows the same where the colours fit its palette."""

    @F.pandas_udf("png boolean, bmp boolean, gif boolean")
    def same(ids: pd.Series) -> pd.DataFrame:
        from lodestone.operators.creators import pattern
        from lodestone.parsers import images

        rows = []
        for i in ids:
            px = pattern(("gradient", "checker", "plasma")[i % 3], 8 + i, 5 + i)
            few = pattern("checker", 8 + i, 5 + i)
            rows.append((bool((images.decode_png(images.encode_png(px)) == px).all()), bool((images.decode_bmp(images.encode_bmp(px)) == px).all()), bool((images.decode_gif(images.encode_gif([few]))["frames"][0]["canvas"] == few).all())))
        return pd.DataFrame(rows, columns=["png", "bmp", "gif"])

    return spark.range(24).select("id", same("id").alias("s")).select("id", "s.*")


@query()
def gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of an animation, and one of them extracted as a child image."""
    objects = transforms.run(files.import_files(creators.create_files(spark, [("animation", {"frames": 6})])), "gif.extract_frame", {"index": 2})
    inner, edges = files.children(objects)
    return inner.join(edges, inner["object_id"] == edges["dst_id"]).select("original_filename", "detected_format", "relation", "checksum")


@query("SELECT 12 AS triangles, 684 AS size")
def obj_to_stl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of six quads exported as binary STL: twelve triangles of 50 bytes behind 84."""
    made = exports.export_objects(files.import_files(creators.create_files(spark, [("mesh", {"format": "obj"})])), "stl")
    return made.select(((F.length("data") - 84) / 50).cast("int").alias("triangles"), F.length("data").alias("size"))


@query()
def exe_static_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static reports of synthetic executables."""
    import struct

    pe = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 0, 0, 0, 0, 240, 0x2000) + struct.pack("<H", 0x20B) + bytes(66) + struct.pack("<H", 2) + bytes(300)
    elf = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 0x3E, 1, 0, 64, 0, 0, 64, 56, 1, 64, 0, 0) + struct.pack("<IIQQQQQQ", 1, 7, 0, 0, 0, 0, 0, 0)
    rows = [("a.dll", "pe", bytearray(pe)), ("b.so", "elf", bytearray(elf)), ("c.wasm", "wasm", bytearray(creators.create("wasm")[1]))]
    given = spark.createDataFrame(rows, "name string, path string, data binary")
    return files.import_files(given).select("original_filename", "detected_format", "warnings", F.get_json_object("content", "$.traits").alias("traits"), F.get_json_object("content", "$.machine").alias("machine"))


@query("SELECT doc_id, 7 AS chunks, true AS sealed FROM documents WHERE coalesce(text, '') <> ''")
def sfp_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document's container (OBYT where bytes are preserved), the last of them the checksum."""

    def listed(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        from lodestone.parsers import array_pieces
        from lodestone.sources.container import describe

        for (data,) in array_pieces((b,) for b in batches):
            got = [describe(d) for d in data.to_pylist()]
            yield pa.array([{"n": sum(c["tag"] != "BLOB" for c in g) - 1, "last": g[-1]["tag"]} for g in got], pa.struct([("n", pa.int32()), ("last", pa.string())]))

    given = docs(spark, sf_dir).filter("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    saved = files.to_containers(files.identify(given), keep=["original_filename"])
    told = saved.select(F.regexp_extract("original_filename", r"(\d+)", 1).cast("bigint").alias("doc_id"), once(listed, T.StructType.fromDDL("n int, last string"))("container").alias("c"))
    return told.select("doc_id", F.col("c.n").alias("chunks"), (F.col("c.last") == "CKSM").alias("sealed"))


@query("""SELECT r_regionkey, 'csv' AS detected, 2 AS columns, 1 AS rows FROM region""")
def csv_parse_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a small CSV text without an extension, detected and parsed."""
    body = F.encode(F.concat(F.lit("key,name\n"), "r_regionkey", F.lit(","), "r_name", F.lit("\n")), "UTF-8")
    objects = files.import_files(_files(table(spark, sf_dir, "region"), "r_regionkey", body, F.concat(F.lit("region"), "r_regionkey")))
    return objects.select(
        F.regexp_extract("original_filename", r"(\d+)", 1).cast("int").alias("r_regionkey"), F.col("detected_format").alias("detected"), F.json_array_length(F.get_json_object("content", "$.columns")).alias("columns"),
        F.get_json_object("content", "$.row_count").cast("int").alias("rows"),
    )
