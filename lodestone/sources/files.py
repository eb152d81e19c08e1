"""Files as rows: listing, limits, detection, parsing. Errors become rows, never failed jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone import plugins
from lodestone.functions.detect import detect
from lodestone.functions.arrow import once
from lodestone.functions.scalar import extension, sha256_hex
from lodestone.model import EXPORTS, FORMATS, LIMITS, object_id
from lodestone.operators.graph import record

CONTENT = "content string, warnings array<string>, support_level string, blobs map<string, binary>, kids array<struct<name: string, data: binary, relation: string>>"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """name, path, data, size, refusal of the files under ``path``; content of files above the limit is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.substring_index("path", "/", -1)
    small = files.filter(F.col("length") <= LIMITS.file_bytes).select(name.alias("name"), "path", F.col("content").alias("data"), F.col("length").alias("size"), F.lit(None).cast("string").alias("refusal"))
    why = F.format_string("file exceeds import limit (%d bytes)", F.col("length"))
    large = files.filter(F.col("length") > LIMITS.file_bytes).select(name.alias("name"), "path", F.lit(None).cast("binary").alias("data"), F.col("length").alias("size"), why.alias("refusal"))
    return small.unionByName(large)


def identify(files: DataFrame) -> DataFrame:
    """files (name, path, data) as objects without content: detection, adapter, checksum, capabilities, export options, first history row.

    A format without an adapter is stored as unknown bytes. Only built-in expressions run here (and the
    detectors of plugins, where there are any), so a query that asks for no content parses nothing.
    """
    known = F.array(*map(F.lit, FORMATS))
    table = lambda attribute: F.create_map(*(x for f in FORMATS.values() for x in (F.lit(f.format), F.lit(getattr(f, attribute)))))
    found = files.withColumn("found", plugins.voted(detect(F.col("data"), F.col("name")), F.col("data"), F.col("name")))
    fallback = F.struct(
        F.lit("blob").alias("format_id"), F.lit("Unknown binary").alias("display"), F.lit("application/octet-stream").alias("mime"), F.col("found.extension").alias("extension"),
        F.lit(0.3).alias("confidence"), F.col("found.method").alias("method"), F.concat(F.lit("no adapter for "), F.col("found.format_id"), F.lit(" — preserved as bytes")).alias("notes"), F.lit("BINARY").alias("family"),
    )
    named = found.withColumn("detection", F.when(F.array_contains(known, F.col("found.format_id")), F.col("found")).otherwise(fallback)).drop("found")
    fmt = F.col("detection.format_id")
    targets = F.create_map(*(x for f, edges in EXPORTS.items() for x in (F.lit(f), F.array(*(F.struct(F.lit(t).alias("format"), F.lit(k).alias("kind")) for t, k in edges)))))
    verbs = F.create_map(*(x for f in FORMATS.values() for x in (F.lit(f.format), F.array(*(F.lit(v) for v, on in (("detect", True), ("read", f.read), ("create", f.create), ("edit", f.edit), ("export", f.export), ("inspect", True)) if on)))))
    percent = F.concat(F.round(F.col("detection.confidence") * 100).cast("int").cast("string"), F.lit("%"))
    detail = F.concat(F.lit("detected "), fmt, F.lit(" ("), percent, F.lit(" via "), F.col("detection.method"), F.lit(")"))
    return named.select(
        object_id(F.col("path"), F.col("data")).alias("object_id"),
        F.lit(None).cast("string").alias("parent_id"),
        table("category")[fmt].alias("object_type"),
        F.col("name").alias("original_filename"),
        extension(F.col("name")).alias("original_extension"),
        fmt.alias("detected_format"),
        F.col("detection.mime").alias("mime"),
        F.coalesce(F.length("data"), F.lit(0)).cast("bigint").alias("size"),
        sha256_hex(F.coalesce("data", F.lit(b""))).alias("checksum"),
        table("support")[fmt].alias("support_level"),
        "detection",
        table("adapter")[fmt].alias("adapter"),
        verbs[fmt].alias("capabilities"),
        targets[fmt].alias("export_formats"),
        record(F.lit(None), "import", detail).alias("history"),
        F.col("data").alias("original_bytes"),
    )


def parsed_udf():
    """bytes, name, format -> content (JSON), warnings, support_level, blobs, kids; few files at a time."""
    shipped = list(plugins.PLUGINS.values())
    schema = T.StructType.fromDDL(CONTENT)
    made = to_arrow_type(schema)

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from lodestone.parsers import array_pieces, parse, to_json

        for plugin in shipped:
            plugins.register(plugin)
        for part in array_pieces(batches):
            got = (parse(*row) for row in zip(*(c.to_pylist() for c in part)))
            rows = [
                {"content": to_json(g.content), "warnings": g.warnings, "support_level": g.support, "blobs": list(g.blobs.items()), "kids": [{"name": n, "data": d, "relation": r} for n, d, r in g.children]}
                for g in got
            ]
            yield pa.array(rows, made)

    return once(run, schema)


def parse_objects(objects: DataFrame, column: str = "original_bytes") -> DataFrame:
    """objects with content (JSON), warnings, support_level, blobs and kids: the Arrow stage. Only what the readers need goes to Python."""
    rest = objects.drop("support_level", "content", "warnings", "blobs", "kids")
    done = rest.withColumn("__parsed", parsed_udf()(F.col(column), F.col("original_filename"), F.col("detected_format")))
    return done.select(*rest.columns, *(F.col(f"__parsed.{c}").alias(c) for c in ("content", "warnings", "support_level", "blobs", "kids")))


def import_files(files: DataFrame) -> DataFrame:
    """files (name, path, data) as parsed objects. A single call of ``identify`` and ``parse_objects``."""
    return parse_objects(identify(files))


def children(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects that parsing found inside others (chapters, tar inside gzip), and the edges to them."""
    inner = objects.select(F.col("object_id").alias("src_id"), F.posexplode("kids").alias("ordinal", "kid"))
    files = inner.select("src_id", "ordinal", F.col("kid.name").alias("name"), F.concat_ws("/", "src_id", "kid.name").alias("path"), F.col("kid.data").alias("data"), F.col("kid.relation").alias("relation"))
    edges = files.select("src_id", object_id(F.col("path"), F.col("data")).alias("dst_id"), "ordinal", "relation", F.lit("").alias("note"))
    return identify(files.select("name", "path", "data")), edges


def extract_archives(objects: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Entries of zip, tar and gzip objects as files (name, path, data, src_id, ordinal) — ready for ``import_files`` — and warnings by object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.parsers import pieces
        from lodestone.parsers.archives import extract

        for batch in pieces(batches):
            for key, data, fmt in zip(*(batch.column(c).to_pylist() for c in ("object_id", "original_bytes", "detected_format"))):
                if fmt not in ARCHIVES:
                    continue
                try:
                    found, warnings = extract(data, fmt, limit)
                except Exception as error:
                    found, warnings = [], [f"{type(error).__name__}: {error}"]
                rows = [(key, n, path, body, None) for n, (path, body) in enumerate(found)] + [(key, -1, None, None, w) for w in warnings]
                types = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["src_id", "ordinal", "path", "data", "warning"])

    ARCHIVES = ("zip", "tar", "gzip")
    # Told apart in the stage: a filter would have every file detected twice.
    archives = objects.select("object_id", F.when(F.col("detected_format").isin(*ARCHIVES), F.col("original_bytes")).alias("original_bytes"), "detected_format")
    out = archives.mapInArrow(run, "src_id string, ordinal int, path string, data binary, warning string")
    files = out.filter("warning IS NULL").select("src_id", "ordinal", F.substring_index("path", "/", -1).alias("name"), "path", "data")
    return files, out.filter("warning IS NOT NULL").select(F.col("src_id").alias("object_id"), "warning")


def to_containers(objects: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """object_id, container and the columns ``keep``: each object with its history and bytes saved as a container.

    Objects that have no column ``content`` yet are parsed in the same Python pass.
    """
    keep = keep or []
    unread, shipped = "content" not in objects.columns, list(plugins.PLUGINS.values())
    meta = ["object_id", "object_type", "original_filename", "original_extension", "detected_format", "mime", "size", "checksum", "support_level"]
    needs = [*meta, "history", "content", "original_bytes", "blobs"]

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from lodestone.parsers import array_pieces, parse, to_json
        from lodestone.sources.container import Node, dumps

        for plugin in shipped:
            plugins.register(plugin)

        def one(row: dict) -> bytes:
            if unread:
                got = parse(row["original_bytes"], row["original_filename"], row["detected_format"])
                row |= {"content": to_json(got.content), "blobs": got.blobs, "support_level": got.support}
            history = [{k: v for k, v in h.items() if k != "ts"} for h in row["history"] or []]
            return dumps(Node({k: row[k] for k in meta}, json.loads(row["content"] or "{}"), history, [], row["original_bytes"], dict(row["blobs"] or [])))

        for part in array_pieces(batches):
            rows = zip(*(c.to_pylist() for c in part))
            yield pa.array([one(dict(zip(needs, row))) for row in rows], pa.binary())

    given = [F.col(c) if c in objects.columns else F.lit(None).cast("map<string, binary>" if c == "blobs" else "string") for c in needs]
    key = given[0].alias("object_id")
    return objects.select(key, once(run, T.BinaryType())(*given).alias("container"), *keep)


def from_containers(rows: DataFrame, column: str = "container", keep: list[str] | None = None) -> DataFrame:
    """container_id, position, depth, parent_id, object_id, meta and content (JSON), original_bytes, steps, unknown, error of every object inside, and the columns ``keep``."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.parsers import pieces
        from lodestone.sources.container import loads, walk

        types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.string())
        for batch in pieces(batches):
            out: list[tuple] = []
            of: list[int] = []
            for at, (key, data) in enumerate(zip(batch.column("object_id").to_pylist(), batch.column(column).to_pylist())):
                try:
                    for n, (node, depth, parent) in enumerate(walk(loads(data or b""))):
                        meta, content = (json.dumps(x, ensure_ascii=False) for x in (node.meta, node.content))
                        out.append((key, n, depth, parent, node.meta.get("object_id"), meta, content, node.original, len(node.history), node.unknown, None))
                except ValueError as error:
                    out.append((key, 0, 0, None, None, None, None, None, 0, [], str(error)))
                of += [at] * (len(out) - len(of))
            kept = [batch.column(c).take(pa.array(of, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], t) for k, t in enumerate(types)), *kept], names=[*NAMES, *keep])

    NAMES = ["container_id", "position", "depth", "parent_id", "object_id", "meta", "content", "original_bytes", "steps", "unknown", "error"]
    schema = T.StructType.fromDDL("container_id string, position int, depth int, parent_id string, object_id string, meta string, content string, original_bytes binary, steps int, unknown array<string>, error string")
    for c in keep:
        schema = schema.add(rows.schema[c])
    return rows.select("object_id", column, *keep).mapInArrow(run, schema)
