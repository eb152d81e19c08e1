"""ZIP, TAR, GZIP and 7-Zip: safe listings, budgets, and extraction into child files."""

from __future__ import annotations

import io
import stat
import struct
import tarfile
import zipfile
import zlib

from lodestone.model import LIMITS
from lodestone.parsers import Parsed, reader


def safe_path(name: str) -> str:
    """Relative path without drive, root, '.' and empty parts; empty if any part is '..'."""
    name = name.replace("\\", "/")
    parts = [p for p in (name[2:] if name[1:2] == ":" else name).split("/") if p not in ("", ".")]
    return "" if ".." in parts else "/".join(parts)


def check_budget(total: int, compressed: int, entries: int) -> None:
    ratio = total / max(1, compressed)
    if entries > LIMITS.archive_entries:
        raise ValueError(f"archive has more than {LIMITS.archive_entries} entries")
    if total > LIMITS.archive_total:
        raise ValueError(f"archive expands beyond {LIMITS.archive_total} bytes")
    if compressed > 0 and total > LIMITS.ratio_from and ratio > LIMITS.archive_ratio:
        raise ValueError(f"suspicious compression ratio {ratio:.0f}:1 (> {LIMITS.archive_ratio}:1)")


def _listing(entries: list[dict], warnings: list[str], **more) -> Parsed:
    total = sum(e["size"] for e in entries)
    return Parsed({"kind": "archive", "entries": entries, "entry_count": len(entries), "total_uncompressed": total} | more, warnings)


@reader("zip", "jar", "pptx", "xlsx")
def zip_archive(data: bytes, name: str, fmt: str) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
    check_budget(sum(i.file_size for i in infos), sum(i.compress_size for i in infos), len(infos))
    entries, warnings = [], []
    for i in infos:
        path = safe_path(i.filename)
        if not path or stat.S_ISLNK(i.external_attr >> 16):
            warnings.append(f"skipped {'unsafe path' if not path else 'symbolic link'}: {i.filename!r}")
            continue
        entries.append({"path": path, "size": i.file_size, "compressed_size": i.compress_size, "is_dir": i.is_dir(), "crc": f"{i.CRC:08x}"})
    return _listing(entries, warnings)


@reader("tar")
def tar_archive(data: bytes, name: str, fmt: str) -> Parsed:
    entries, warnings = [], []
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for n, m in enumerate(t):
            if n >= LIMITS.archive_entries:
                raise ValueError(f"archive has more than {LIMITS.archive_entries} entries")
            path = safe_path(m.name)
            if not path or m.issym() or m.islnk():
                warnings.append(f"skipped {'link' if path else 'unsafe path'}: {m.name!r}")
                continue
            entries.append({"path": path, "size": m.size, "compressed_size": m.size, "is_dir": m.isdir(), "mtime": int(m.mtime), "mode": oct(m.mode)})
    return _listing(entries, warnings)


def gunzip(data: bytes) -> bytes:
    """The first member's content, refused beyond the budget."""
    engine = zlib.decompressobj(31)
    out = engine.decompress(data, LIMITS.archive_total + 1)
    check_budget(len(out), len(data), 1)
    return out


@reader("gzip")
def gzip_stream(data: bytes, name: str, fmt: str) -> Parsed:
    inner = gunzip(data)
    stem = name.rsplit("/", 1)[-1]
    stem = stem[:-4] + ".tar" if stem.endswith(".tgz") else stem.removesuffix(".gz") or "member"
    if inner[257:262] == b"ustar":
        out = tar_archive(inner, stem, "tar")
        out.content |= {"member": stem, "member_format": "tar"}
    else:
        out = _listing([{"path": stem, "size": len(inner), "compressed_size": len(data), "is_dir": False}], [], member=stem)
    out.children = [(stem, inner, "contains")]
    return out


@reader("7z")
def seven_zip(data: bytes, name: str, fmt: str) -> Parsed:
    major, minor, _, offset, size = struct.unpack_from("<BBIQQ", data, 6)
    return Parsed({"kind": "archive", "entries": [], "entry_count": 0, "version": f"{major}.{minor}", "next_header_offset": offset, "next_header_size": size}, ["7-Zip content is not decompressed"])


def extract(data: bytes, fmt: str, limit: int = 200) -> tuple[list[tuple[str, bytes]], list[str]]:
    """Files of an archive as (path, bytes): ``limit`` entries at most, none above the entry cap, no links, directories or unsafe paths."""
    out: list[tuple[str, bytes]] = []
    warnings: list[str] = []
    if fmt == "gzip":
        inner = gunzip(data)
        if inner[257:262] != b"ustar":
            return [("member", inner)], warnings
        data, fmt = inner, "tar"
    listed = (zip_archive if fmt == "zip" else tar_archive)(data, "", fmt)
    warnings += listed.warnings
    with zipfile.ZipFile(io.BytesIO(data)) if fmt == "zip" else tarfile.open(fileobj=io.BytesIO(data)) as a:
        members = a.infolist() if fmt == "zip" else a.getmembers()
        for m in members:
            path = safe_path(m.filename if fmt == "zip" else m.name)
            size = m.file_size if fmt == "zip" else m.size
            plain = not m.is_dir() and not stat.S_ISLNK(m.external_attr >> 16) if fmt == "zip" else m.isfile()
            if not path or not plain:
                continue
            if size > LIMITS.entry_bytes:
                warnings.append(f"entry too large: {path}")
                continue
            if len(out) >= limit:
                warnings.append(f"only the first {limit} entries were extracted")
                break
            out.append((path, a.read(m) if fmt == "zip" else a.extractfile(m).read()))
    return out, warnings


def create(files: list[tuple[str, bytes]], fmt: str) -> bytes:
    """A zip, tar or tar.gz with the files, entry times fixed so that equal input gives equal bytes."""
    out = io.BytesIO()
    if fmt == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, body in files:
                z.writestr(zipfile.ZipInfo(path), body, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for path, body in files:
            info = tarfile.TarInfo(path)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    if fmt == "tar":
        return out.getvalue()
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(out.getvalue()) + engine.flush()
