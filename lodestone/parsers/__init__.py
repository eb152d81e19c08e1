"""Parsers of file bytes: total functions bytes -> Parsed. Errors become warnings and INSPECTION ONLY, never exceptions.

Each module registers readers by format; ``parse`` picks one. Nothing a file holds is executed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa

from lodestone.model import FORMATS


@dataclass
class Parsed:
    """What a reader finds: JSON-safe content, warnings, binary parts by key, child files, and a support level if not the format's own."""

    content: dict
    warnings: list[str] = field(default_factory=list)
    blobs: dict[str, bytes] = field(default_factory=dict)
    children: list[tuple[str, bytes, str]] = field(default_factory=list)  # name, bytes, relation
    support: str | None = None


Reader = Callable[[bytes, str, str], Parsed]
READERS: dict[str, Reader] = {}


def reader(*formats: str) -> Callable[[Reader], Reader]:
    def add(f: Reader) -> Reader:
        for name in formats:
            READERS.setdefault(name, f)  # the first registration of a format wins
        return f

    return add


@cache
def load() -> dict[str, Reader]:
    from lodestone.parsers import archives, audio, binaries, containers, database, documents, images, meshes, structured, texts, video

    del archives, audio, binaries, containers, database, documents, images, meshes, structured, texts, video
    return READERS


def parse(data: bytes | None, name: str | None, fmt: str) -> Parsed:
    data, name = data or b"", name or ""
    readers = load()
    if fmt not in readers:
        fmt = "blob"
    try:
        out = readers[fmt](data, name, fmt)
    except Exception as error:
        out = Parsed({"kind": FORMATS[fmt].category.lower() if fmt in FORMATS else "blob"}, [f"{type(error).__name__}: {error}"[:300]], support="INSPECTION ONLY")
    if out.support is None:
        out.support = FORMATS[fmt].support if fmt in FORMATS else "PARTIAL SUPPORT"
    return out


# Encoders are built once: for small files that costs as much as the encoding.
STRICT = json.JSONEncoder(ensure_ascii=False, default=str, allow_nan=False)
LENIENT = json.JSONEncoder(ensure_ascii=False, default=str)


def to_json(value) -> str:
    try:
        return STRICT.encode(value)
    except ValueError:
        return LENIENT.encode(value)


#: Bytes of files that are held as Python objects at once, about.
PIECE_BYTES = 2 << 20


def pieces(batches, most_bytes: int = PIECE_BYTES):
    """Record batches cut so that none holds much more than ``most_bytes`` (one file may)."""
    for batch in batches:
        n = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)) + 1))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)
        del batch  # not held while the next one is read


def array_pieces(batches, most_bytes: int = PIECE_BYTES):
    """Tuples of arrays cut in the same way."""
    for part in pieces((pa.RecordBatch.from_arrays(list(b), names=[str(i) for i in range(len(b))]) for b in batches), most_bytes):
        yield part.columns
