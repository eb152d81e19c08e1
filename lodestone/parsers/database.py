"""SQLite files (schema, counts, first rows, read-only) and unknown bytes."""

from __future__ import annotations

import sqlite3
import struct

import numpy as np

from lodestone.parsers import Parsed, reader

ENCODINGS = {1: "UTF-8", 2: "UTF-16le", 3: "UTF-16be"}
SAMPLE_ROWS = 5


@reader("sqlite")
def sqlite(data: bytes, name: str, fmt: str) -> Parsed:
    page = struct.unpack_from(">H", data, 16)[0]
    content = {"kind": "database", "page_size": 65536 if page == 1 else page, "user_version": struct.unpack_from(">I", data, 60)[0], "application_id": struct.unpack_from(">I", data, 68)[0], "text_encoding": ENCODINGS.get(struct.unpack_from(">I", data, 56)[0], "unknown")}
    safe = lambda v: f"<{len(v)} bytes>" if isinstance(v, bytes) else v
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        con.execute("PRAGMA query_only = 1")
        schema = [dict(zip(("type", "name", "table", "sql"), r)) for r in con.execute("SELECT type, name, tbl_name, sql FROM sqlite_master ORDER BY type, name")]
        warnings = []
        for row in schema:
            if row["type"] != "table":
                continue
            quoted = '"' + row["name"].replace('"', '""') + '"'
            try:
                row["row_count"] = con.execute(f"SELECT count(*) FROM {quoted}").fetchone()[0]
                found = con.execute(f"SELECT * FROM {quoted} LIMIT {SAMPLE_ROWS}")
                row["columns"] = [c[0] for c in found.description]
                row["sample"] = [[safe(v) for v in r] for r in found]
            except sqlite3.Error as error:
                warnings.append(f"{row['name']}: {error}")
    finally:
        con.close()
    kinds = [r["type"] for r in schema]
    return Parsed(content | {"schema": schema, "table_count": kinds.count("table"), "index_count": kinds.count("index")}, warnings)


def hex_lines(data: bytes, limit: int = 256) -> str:
    rows = (data[k : k + 16] for k in range(0, min(len(data), limit), 16))
    return "\n".join(f"{16 * i:08x}  {r[: limit - 16 * i].hex(' '):<47}  {''.join(chr(b) if 32 <= b < 127 else '.' for b in r)}" for i, r in enumerate(rows))


@reader("blob", "empty")
def blob(data: bytes, name: str, fmt: str) -> Parsed:
    counts = np.bincount(np.frombuffer(data[:1_000_000], np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, counts.sum())
    entropy = round(float(-(share * np.log2(share)).sum()), 3) + 0.0
    return Parsed({"kind": "blob", "hex_preview": hex_lines(data), "entropy": abs(entropy), "printable_ratio": round(float(counts[32:127].sum() / max(1, counts.sum())), 3)})
