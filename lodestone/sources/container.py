"""The object container: codec, chunk listing, and a Spark data source that reads and writes it.

Layout: a 32-byte big-endian header (magic, version, header size, flags), then chunks
(tag, 8-byte length, payload), the last of which is the SHA-256 of all before it.
Payloads of CONT, OBYT and BLOB are deflated where that pays (flag bits 0 to 2).
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values.
MAGIC = b"\x8bSFP\x0d\x0a\x1a\x0a"
VERSION, HEADER = (1, 0), struct.Struct(">8sHHII12s")
HEADER_SIZE = HEADER.size
FLAGS = {b"CONT": 1, b"OBYT": 2, b"BLOB": 4}
KNOWN = (b"META", b"CONT", b"HIST", b"RTBL", b"OTBL", b"OFMT", b"OBYT", b"BLOB", b"KIDS", b"ENCR", b"CKSM")
DEFLATE_FROM = 128
#: Bytes that a deflated payload may grow to; hostile files are refused beyond it.
INFLATED = 256 << 20


class ContainerError(ValueError):
    pass


@dataclass
class Node:
    """An object with its parts and children."""

    meta: dict
    content: dict = field(default_factory=dict)
    history: list = field(default_factory=list)
    relationships: list = field(default_factory=list)
    original: bytes | None = None
    blobs: dict[str, bytes] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)

    def summary(self) -> dict:
        return {k: self.meta.get(k) for k in ("object_id", "object_type", "original_filename", "detected_format", "size")} | {"children": len(self.children)}


def chunk(tag: bytes, payload: bytes) -> bytes:
    return tag + struct.pack(">Q", len(payload)) + payload


def chunks(data: bytes, at: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(tag, offset, payload) of each chunk; bounds are checked."""
    while at < len(data):
        if at + 12 > len(data):
            raise ContainerError("truncated chunk header")
        tag, n = struct.unpack_from(">4sQ", data, at)
        if n > len(data) - at - 12:
            raise ContainerError(f"chunk {tag!r} reaches past the end")
        yield tag, at, data[at + 12 : at + 12 + n]
        at += 12 + n


def _json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()


def _pack_blobs(blobs: dict[str, bytes]) -> bytes:
    return b"".join(struct.pack(">H", len(k.encode())) + k.encode() + struct.pack(">Q", len(v)) + v for k, v in blobs.items())


def _unpack_blobs(data: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(data):
        (n,) = struct.unpack_from(">H", data, at)
        key = data[at + 2 : at + 2 + n].decode()
        (size,) = struct.unpack_from(">Q", data, at + 2 + n)
        at += 10 + n
        out[key], at = data[at : at + size], at + size
    return out


def dumps(node: Node) -> bytes:
    flags, body = 0, []
    keeps = {k: node.meta.get(k) for k in ("detected_format", "mime", "original_filename", "original_extension", "size", "checksum")}
    parts = [(b"META", _json({"sfmeta": 1} | node.meta)), (b"CONT", _json(node.content)), (b"HIST", _json(node.history)), (b"RTBL", _json(node.relationships))]
    parts += [(b"OTBL", _json([c.summary() for c in node.children])), (b"OFMT", _json(keeps | {"preserved_bytes": node.original is not None}))]
    if node.original is not None and node.meta.get("detected_format") != "sfp":
        parts.append((b"OBYT", node.original))
    if node.blobs:
        parts.append((b"BLOB", _pack_blobs(node.blobs)))
    if node.children:
        parts.append((b"KIDS", b"".join(struct.pack(">Q", len(k)) + k for k in map(dumps, node.children))))
    for tag, payload in parts:
        if tag in FLAGS and len(payload) >= DEFLATE_FROM and len(small := zlib.compress(payload, 6)) < len(payload):
            payload, flags = small, flags | FLAGS[tag]
        body.append(chunk(tag, payload))
    out = HEADER.pack(MAGIC, *VERSION, HEADER.size, flags, bytes(12)) + b"".join(body)
    return out + chunk(b"CKSM", hashlib.sha256(out).digest())


def inflate(data: bytes) -> bytes:
    engine = zlib.decompressobj()
    out = engine.decompress(data, INFLATED + 1)
    if len(out) > INFLATED:
        raise ContainerError("payload inflates beyond the limit")
    return out


def checked(data: bytes) -> tuple[int, list[tuple[bytes, bytes]]]:
    """Flags and chunks (tag, payload) of a container whose frame and checksum are right."""
    if len(data) < HEADER.size + 12:
        raise ContainerError("file too small to be a container")
    magic, major, _, size, flags, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ContainerError("bad magic")
    if major > VERSION[0]:
        raise ContainerError(f"container major version {major} is newer than supported {VERSION[0]}")
    if size < HEADER.size or size > len(data):
        raise ContainerError("invalid header_size")
    out = []
    for tag, at, payload in chunks(data, size):
        if tag == b"CKSM":
            if len(payload) != 32:
                raise ContainerError("bad CKSM length")
            if hashlib.sha256(data[:at]).digest() != payload:
                raise ContainerError("checksum mismatch — container is corrupt or was modified")
            if at + 44 != len(data):
                raise ContainerError("trailing data after checksum")
            return flags, out
        out.append((tag, payload))
    raise ContainerError("missing CKSM checksum chunk")


def loads(data: bytes) -> Node:
    flags, parts = checked(data)
    found = dict(reversed(parts))  # the first chunk of a tag counts
    if b"ENCR" in found:
        raise ContainerError("the container is encrypted; decrypt it first")
    if b"META" not in found or b"CONT" not in found:
        raise ContainerError("missing required META/CONT chunks")
    part = lambda tag: inflate(found[tag]) if flags & FLAGS.get(tag, 0) else found[tag]
    node = Node(json.loads(found[b"META"]), json.loads(part(b"CONT")), json.loads(found.get(b"HIST", b"[]")), json.loads(found.get(b"RTBL", b"[]")))
    node.original = part(b"OBYT") if b"OBYT" in found else None
    node.blobs = _unpack_blobs(part(b"BLOB")) if b"BLOB" in found else {}
    kids, at = found.get(b"KIDS", b""), 0
    while at < len(kids):
        (n,) = struct.unpack_from(">Q", kids, at)
        node.children.append(loads(kids[at + 8 : at + 8 + n]))
        at += 8 + n
    node.unknown = [t.decode("latin-1") for t, _ in parts if t not in KNOWN]
    return node


def describe(data: bytes) -> list[dict]:
    """tag, offset, length, known of each chunk; no object is built."""
    if data[:8] != MAGIC:
        raise ContainerError("bad magic")
    size = HEADER.unpack_from(data)[3]
    return [{"tag": t.decode("latin-1"), "offset": at, "length": len(p), "known": t in KNOWN} for t, at, p in chunks(data, size)]


def walk(node: Node, depth: int = 0, parent: str | None = None) -> Iterator[tuple[Node, int, str | None]]:
    yield node, depth, parent
    for child in node.children:
        yield from walk(child, depth + 1, node.meta.get("object_id"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One row an object of the containers at ``path`` (a file or folder that executors see), in pre-order."""

    def __init__(self, path: str, metadata_only: bool):
        self.path, self.metadata_only = path, metadata_only

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "**/*.sfp"), recursive=True)) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            root = loads(f.read())
        for n, (node, depth, parent) in enumerate(walk(root)):
            m = node.meta
            content = None if self.metadata_only else json.dumps(node.content, ensure_ascii=False)
            yield (partition.path, n, depth, parent, m.get("object_id"), m.get("object_type"), m.get("original_filename"), m.get("detected_format"), m.get("size"), m.get("checksum"), content, None if self.metadata_only else node.original)


class _Message(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class _Writer(DataSourceWriter):
    """One container a row (object_id, container) under ``path``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        import os

        os.makedirs(self.path, exist_ok=True)
        n = 0
        for row in rows:
            name = "".join(c if c.isalnum() or c in "-_." else "_" for c in (row["object_id"] or uuid.uuid4().hex))
            partial = os.path.join(self.path, f".{name}.{uuid.uuid4().hex}")
            with open(partial, "wb") as f:
                f.write(row["container"])
            os.replace(partial, os.path.join(self.path, name + ".sfp"))  # a task that runs again leaves the same file
            n += 1
        return _Message(n)


class ContainerSource(DataSource):
    """spark.dataSource.register(ContainerSource); spark.read.format("sfp").load(path); df.write.format("sfp").save(path)."""

    @classmethod
    def name(cls):
        return "sfp"

    def schema(self):
        return "path string, position int, depth int, parent_id string, object_id string, object_type string, original_filename string, detected_format string, size bigint, checksum string, content string, original_bytes binary"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("metadataonly", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def is_sealed(data: bytes) -> bool:
    """Whether a container is encrypted: its first chunk says so."""
    return data[:8] == MAGIC and data[HEADER_SIZE : HEADER_SIZE + 4] == b"ENCR"
