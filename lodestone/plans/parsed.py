"""Queries that write small files from the driver's tables, import them, and compare what the parsers read with SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import plugins
from lodestone.functions import crypto
from lodestone.operators import creators, exports
from lodestone.plans.queries import query, table
from lodestone.sources import files


def _text_files(df: DataFrame, key: str, extension: str, *parts) -> DataFrame:
    body = F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    return df.select(F.concat(F.col(key).cast("string"), F.lit("." + extension)).alias("name"), F.concat(F.lit(extension + "/"), F.col(key).cast("string")).alias("path"), F.encode(body, "UTF-8").alias("data"))


def _binary_files(df: DataFrame, key: str, extension: str, make: Callable[[dict], bytes]) -> DataFrame:
    """A file for each row, made from its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            names = [f"{r[key]}.{extension}" for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{extension}/{n}" for n in names], pa.string()), pa.array([make(r) for r in rows], pa.binary())], names=["name", "path", "data"])

    return df.mapInArrow(run, "name string, path string, data binary")


def _key(objects: DataFrame, name: str = "n_nationkey"):
    return F.substring_index("original_filename", ".", 1).cast("int").alias(name)


def _value(path: str, kind: str = "string"):
    return F.get_json_object("content", path).cast(kind)


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("SELECT n_nationkey, 'xml' AS format, 'nation' AS root, n_name AS name, n_regionkey AS region, 3 AS nodes FROM nation")
def nation_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _text_files(_nation(spark, sf_dir), "n_nationkey", "xml", '<?xml version="1.0"?><nation><name>', F.col("n_name"), '</name><region key="', F.col("n_regionkey").cast("string"), '"/></nation>')
    objects = files.import_files(given)
    return objects.select(_key(objects), F.col("detected_format").alias("format"), _value("$.root_tag").alias("root"), _value("$.nodes[1].text").alias("name"), _value("$.nodes[2].attributes.key", "int").alias("region"), F.json_array_length(F.get_json_object("content", "$.nodes")).alias("nodes"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region, 'toml' AS format FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'yaml' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'json' FROM nation")
def nation_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as YAML, TOML and JSON."""
    n, name, region = _nation(spark, sf_dir), F.col("n_name"), F.col("n_regionkey").cast("string")
    given = _text_files(n, "n_nationkey", "yaml", "name: ", name, "\nwhere:\n  region: ", region, "\n  tags: [a, b]\n")
    given = given.unionByName(_text_files(n, "n_nationkey", "toml", 'name = "', name, '"\n[where]\nregion = ', region, "\n"))
    given = given.unionByName(_text_files(n, "n_nationkey", "json", '{"name": "', name, '", "where": {"region": ', region, "}}"))
    objects = files.import_files(given)
    return objects.select(_key(objects), _value("$.data.name").alias("name"), _value("$.data.where.region", "int").alias("region"), F.col("detected_format").alias("format"))


@query("SELECT n_regionkey AS r_regionkey, 'region,key,name' || chr(10) || string_agg(n_regionkey || ',' || n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation GROUP BY n_regionkey")
def region_json_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a JSON list, exported as CSV."""
    row = F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    listed = _nation(spark, sf_dir).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("rows"))
    given = _text_files(listed, "n_regionkey", "json", "[", F.array_join(F.transform("rows", lambda r: r["row"]), ","), "]")
    made = exports.export_objects(files.import_files(given), "csv")
    return made.select(F.substring_index("filename", ".", 1).cast("int").alias("r_regionkey"), F.decode("data", "UTF-8").alias("csv"))


@query("SELECT n_nationkey, f.format, n_name AS name FROM nation, (VALUES ('pdf'), ('docx'), ('epub')) f(format)")
def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name as a PDF, DOCX and EPUB, read again."""
    given = None
    for kind in ("pdf", "docx", "epub"):
        one = _binary_files(_nation(spark, sf_dir).select("n_nationkey", "n_name"), "n_nationkey", kind, lambda r, kind=kind: creators.create(kind, {"text": f"begin ({r['n_name']}) end"})[1])
        given = one if given is None else given.unionByName(one)
    objects = files.import_files(given)
    return objects.select(_key(objects), F.col("detected_format").alias("format"), F.regexp_extract(F.coalesce(_value("$.raw_text"), _value("$.text")), r"begin \((.*?)\) end", 1).alias("name"))


@query("SELECT n_regionkey AS r_regionkey, 'sqlite' AS format, count(*) AS rows FROM nation GROUP BY n_regionkey")
def region_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as an SQLite file."""

    def database(r: dict) -> bytes:
        import sqlite3

        with sqlite3.connect(":memory:") as db:
            db.execute("CREATE TABLE nations (id INTEGER PRIMARY KEY, name TEXT)")
            db.executemany("INSERT INTO nations VALUES (?, ?)", list(enumerate(r["names"])))
            db.commit()
            return db.serialize()

    listed = _nation(spark, sf_dir).groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    objects = files.import_files(_binary_files(listed, "n_regionkey", "sqlite", database))
    return objects.select(_key(objects, "r_regionkey"), F.col("detected_format").alias("format"), _value("$.schema[0].row_count", "bigint").alias("rows"))


@query("""SELECT n_nationkey, 'exported to ' || n_nationkey || '.html [RECONSTRUCTED]' AS detail, 2 AS steps, 'RECONSTRUCTED' AS kind, false AS refused FROM nation
    UNION ALL SELECT n_nationkey, 'import', 1, NULL, true FROM nation""")
def export_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name as text, exported as HTML (a step in its history) and as PNG (refused: none)."""
    objects = files.import_files(_text_files(_nation(spark, sf_dir), "n_nationkey", "txt", F.col("n_name"), "\n"))
    out = exports.export_objects(objects, "html").unionByName(exports.export_objects(objects, "png"))
    last = F.element_at("history", -1)
    return out.select(F.substring_index("filename", ".", 1).cast("int").alias("n_nationkey"), F.when(F.col("refusal").isNull(), last["detail"]).otherwise(last["action"]).alias("detail"), F.size("history").alias("steps"), "kind", F.col("refusal").isNotNull().alias("refused"))


@query("SELECT n_nationkey, 'ppm' AS format, 'plugin' AS method, n_nationkey + 1 AS width, n_regionkey + 1 AS height FROM nation")
def plugin_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM images of a size a nation, found by the sample plugin's detector under names that say nothing."""
    ppm = lambda r: f"P6\n{r['n_nationkey'] + 1} {r['n_regionkey'] + 1}\n255\n".encode() + bytes(3 * (r["n_nationkey"] + 1) * (r["n_regionkey"] + 1))
    known = "ppm" in plugins.PLUGINS
    plugins.register(plugins.ppm())
    try:  # the plan carries the plugin, so the registry can go back to what it was
        objects = files.import_files(_binary_files(_nation(spark, sf_dir).select("n_nationkey", "n_regionkey"), "n_nationkey", "bin", ppm))
    finally:
        if not known:
            plugins.unregister("ppm")
    return objects.select(_key(objects), F.col("detected_format").alias("format"), F.col("detection.method").alias("method"), _value("$.width", "int").alias("width"), _value("$.height", "int").alias("height"))


@query("SELECT n_nationkey, sha256(n_name) AS checksum, CAST(NULL AS VARCHAR) AS error FROM nation")
def decrypt_two_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers sealed under two salts, opened together by the password alone."""
    plain = files.to_containers(files.import_files(_text_files(_nation(spark, sf_dir), "n_nationkey", "txt", F.col("n_name"))))
    odd = F.pmod(F.xxhash64("object_id"), F.lit(2)) == 1
    sealed = crypto.encrypt_containers(plain.filter(odd), "secret", b"a" * 16, b"n" * 32).unionByName(crypto.encrypt_containers(plain.filter(~odd), "secret", b"b" * 16, b"m" * 32))
    back = files.from_containers(crypto.decrypt_containers(sealed.select("object_id", "container"), "secret"))
    name = F.get_json_object("meta", "$.original_filename")
    return back.select(F.substring_index(name, ".", 1).cast("int").alias("n_nationkey"), F.sha2("original_bytes", 256).alias("checksum"), "error")
