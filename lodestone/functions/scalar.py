"""Scalar functions as Column expressions: hashing, names and paths, dumps, budgets, geometry helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.model import LIMITS


def sha256_hex(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def blob_key(data: Column) -> Column:
    """Content address of a blob: the first 16 hex digits of its digest."""
    return F.substring(sha256_hex(data), 1, 16)


def latin(data: Column) -> Column:
    """One character a byte."""
    return F.decode(data, "ISO-8859-1")


def unsigned(data: Column, offset: int, size: int, little: bool = True) -> Column:
    """Unsigned integer of ``size`` bytes (7 at most) at ``offset``; null past the end."""
    places = range(offset + size, offset, -1) if little else range(offset + 1, offset + size + 1)
    digits = F.concat(*(F.hex(F.substring(data, p, 1)) for p in places))
    return F.when(F.length(data) >= offset + size, F.conv(digits, 16, 10).cast("bigint"))


def extension(name: Column) -> Column:
    """Lower-cased text behind the last dot; empty without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(name: Column) -> Column:
    """Base name without its last extension; 'object' for an empty name."""
    base = F.substring_index(F.replace(F.when(F.coalesce(name, F.lit("")) == "", "object").otherwise(name), F.lit("\\"), F.lit("/")), "/", -1)
    return F.when(F.contains(base, F.lit(".")), F.regexp_replace(base, r"(?s)\.[^.]*$", "")).otherwise(base)


def sanitize_path(name: Column) -> Column:
    """Safe relative path of an archive entry; empty where the entry must be skipped (any '..' part)."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    rooted = F.when(F.substring(slashed, 2, 1) == ":", F.substring(slashed, 3, 2**31 - 1)).otherwise(slashed)
    parts = F.filter(F.split(rooted, "/", -1), lambda p: ~p.isin("", "."))
    return F.when(name.isNull() | F.array_contains(parts, ".."), "").otherwise(F.array_join(parts, "/"))


def safe_filename(name: Column) -> Column:
    """Base name with anything but letters, digits, '_.- ' as '_', trimmed of blanks and dots, 120 characters at most."""
    given = F.when(F.coalesce(name, F.lit("")) == "", "file").otherwise(name)
    base = F.substring_index(F.replace(given, F.lit("\\"), F.lit("/")), "/", -1)
    clean = F.btrim(F.regexp_replace(base, r"(?U)[^\w.\- ]+", "_"), F.lit(" ."))
    return F.left(F.when(clean == "", "file").otherwise(clean), F.lit(120))


def hex_preview(data: Column, limit: int = 256) -> Column:
    """Dump of the first ``limit`` bytes, 16 a line: offset, hex and printable ASCII."""
    head = F.substring(data, 1, limit)
    digits, shown = F.lower(F.hex(head)), F.regexp_replace(latin(head), r"[^\x20-\x7e]", ".")

    def line(i: Column) -> Column:
        row = F.rtrim(F.regexp_replace(F.substring(digits, i * 32 + 1, F.lit(32)), "(..)", "$1 "))
        return F.concat(F.lpad(F.lower(F.hex(i * 16)), 8, "0"), F.lit("  "), F.rpad(row, 47, " "), F.lit("  "), F.substring(shown, i * 16 + 1, F.lit(16)))

    lines = F.ceil(F.length(head) / 16).cast("int")
    return F.when(lines > 0, F.array_join(F.transform(F.sequence(F.lit(0), lines - 1), line), "\n")).otherwise("")


def printable_ratio_parts(data: Column) -> tuple[Column, Column]:
    """Printable ASCII bytes (with tab, line feed, carriage return) among the first 4096, and how many bytes those are."""
    head = latin(F.substring(data, 1, 4096))
    return F.length(F.regexp_replace(head, r"[^\x20-\x7e\t\n\r]", "")), F.length(head)


def looks_like_text(data: Column) -> tuple[Column, Column]:
    """Whether the bytes seem to be text, and how surely. Only ASCII counts as printable."""
    printable, n = printable_ratio_parts(data)
    nul = F.contains(latin(F.substring(data, 1, 4096)), F.lit("\x00"))
    ratio = printable / n
    ok = F.when(n == 0, True).when(nul, False).otherwise(ratio > 0.92)
    sure = F.when(n == 0, 0.5).when(nul, 0.95).otherwise(F.round(F.least(F.lit(0.99), 0.5 + ratio / 2), 2))
    return ok, sure


def budget_refusal(total: Column, compressed: Column, entries: Column) -> Column:
    """Why an archive must not be extracted; null if it may."""
    ratio = total / F.greatest(compressed, F.lit(1))
    return (
        F.when(entries > LIMITS.archive_entries, f"archive has more than {LIMITS.archive_entries} entries")
        .when(total > LIMITS.archive_total, f"archive expands beyond {LIMITS.archive_total} bytes")
        .when(
            (compressed > 0) & (total > LIMITS.ratio_from) & (ratio > LIMITS.archive_ratio),
            F.format_string(f"suspicious compression ratio %.0f:1 (> {LIMITS.archive_ratio}:1)", ratio),
        )
    )


def bbox(xyz: Column) -> Column:
    """[min x, min y, min z, max x, max y, max z] of an array of coordinates, three a point; null if empty."""
    axis = lambda k: F.filter(xyz, lambda x, i: i % 3 == k)
    return F.when(F.size(xyz) >= 3, F.array(*(F.array_min(axis(k)) for k in range(3)), *(F.array_max(axis(k)) for k in range(3))))


def decimate(xyz: Column, most: int = 4000) -> Column:
    """Every n-th point, n = points // most, and ``most`` points at most; all of them if they are no more than that."""
    points = F.floor(F.size(xyz) / 3)
    step = F.greatest(F.lit(1), F.floor(points / most))
    thin = F.slice(F.filter(xyz, lambda x, i: (F.floor(i / 3) % step == 0) & (i < points * 3)), 1, most * 3)
    return F.when(points <= most, xyz).otherwise(thin)


def escape_html(text: Column) -> Column:
    """The five characters that HTML text and attributes must not hold."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def decode_text(data: Column) -> Column:
    """UTF-8 without its byte order mark, else Latin-1."""
    utf = F.try_validate_utf8(data.cast("string"))
    return F.coalesce(F.regexp_replace(utf, "^﻿", ""), latin(data))


def pe_traits(dos_ok: Column, writes_and_runs: Column, tls: Column, dll: Column, subsystem: Column) -> Column:
    """Remarks on a PE file, most serious first."""
    return F.array_compact(
        F.array(
            F.when(~dos_ok, "Malformed DOS header — possible crafted/corrupt sample"),
            F.when(writes_and_runs, "Section with WRITE+EXECUTE permissions (common in packers/shellcode loaders)"),
            F.when(tls, "TLS directory present (TLS callbacks run before entry point)"),
            F.when(subsystem == 2, "GUI subsystem — no console"),
            F.when(dll, "Dynamic-link library — loaded by other programs, never run directly"),
            F.lit("UNTRUSTED BINARY — static inspection only; files are never executed"),
        )
    )


def elf_traits(writes_and_runs: Column, rpath: Column, shared: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(writes_and_runs, "Segment with PF_W+PF_X (writable executable memory)"),
            F.when(rpath, "DT_RPATH/DT_RUNPATH present (library search-path override)"),
            F.when(shared, "Shared object / library — never loaded or executed"),
            F.lit("UNTRUSTED BINARY — static inspection only; files are never executed"),
        )
    )
