"""Static reports of PE, ELF and WebAssembly files. Nothing is ever executed."""

from __future__ import annotations

import struct

from lodestone.parsers import Parsed, reader

UNTRUSTED = "UNTRUSTED BINARY — static inspection only; files are never executed"
# Names of machines, subsystems, data directories, section flags.
MACHINES = {0x14C: "x86", 0x8664: "x86-64", 0x1C0: "ARM", 0xAA64: "ARM64"}
SUBSYSTEMS = {1: "native", 2: "windows-gui", 3: "windows-console", 9: "windows-ce", 10: "efi"}
DIRECTORIES = "export import resource exception security basereloc debug architecture globalptr tls loadconfig boundimport iat delayimport clr reserved".split()
FLAGS = {0x20: "CODE", 0x40: "INITIALIZED_DATA", 0x80: "UNINITIALIZED_DATA", 0x20000000: "EXECUTE", 0x40000000: "READ", 0x80000000: "WRITE"}
ELF_TYPES = {1: "relocatable", 2: "executable", 3: "shared", 4: "core"}
ELF_MACHINES = {3: "x86", 0x28: "ARM", 0x3E: "x86-64", 0xB7: "AArch64", 0xF3: "RISC-V", 8: "MIPS"}
SEGMENTS = {1: "LOAD", 2: "DYNAMIC", 3: "INTERP", 4: "NOTE", 6: "PHDR", 7: "TLS", 0x6474E551: "GNU_STACK", 0x6474E552: "GNU_RELRO"}
WASM_SECTIONS = "custom type import function table memory global export start element code data datacount".split()
WASM_KINDS = "func table memory global".split()


def text_at(data: bytes, at: int, most: int = 256) -> str:
    end = data.find(b"\0", at, at + most)
    return data[at : end if end >= 0 else at + most].decode("latin-1")


@reader("pe")
def pe(data: bytes, name: str, fmt: str) -> Parsed:
    at = struct.unpack_from("<I", data, 0x3C)[0] if len(data) > 0x40 else 0
    if data[at : at + 4] != b"PE\0\0" or not at:
        return Parsed({"kind": "binary", "format": "pe", "traits": ["Malformed DOS header — possible crafted/corrupt sample", UNTRUSTED]}, ["no PE header"])
    machine, count, stamp, _, _, optional, flags = struct.unpack_from("<HHIIIHH", data, at + 4)
    head = at + 24
    wide = struct.unpack_from("<H", data, head)[0] == 0x20B
    entry = struct.unpack_from("<I", data, head + 16)[0]
    base = struct.unpack_from("<Q" if wide else "<I", data, head + (24 if wide else 28))[0]
    subsystem = struct.unpack_from("<H", data, head + 68)[0]
    table = head + (112 if wide else 96)
    n = min(16, struct.unpack_from("<I", data, table - 4)[0], (head + optional - table) // 8)
    directories = {DIRECTORIES[k]: struct.unpack_from("<II", data, table + 8 * k) for k in range(n)}
    sections = []
    for k in range(count):
        raw = struct.unpack_from("<8sIIIIIIHHI", data, head + optional + 40 * k)
        sections.append({"name": raw[0].rstrip(b"\0").decode("latin-1"), "virtual_size": raw[1], "virtual_address": raw[2], "raw_size": raw[3], "raw_offset": raw[4], "flags": [f for bit, f in FLAGS.items() if raw[9] & bit]})

    def place(rva: int) -> int:
        for s in sections:
            if s["virtual_address"] <= rva < s["virtual_address"] + max(s["virtual_size"], s["raw_size"]):
                return rva - s["virtual_address"] + s["raw_offset"]
        return -1

    imports: list[dict] = []
    exports: list[str] = []
    where = place(directories.get("import", (0, 0))[0])
    total = 0
    while 0 < where <= len(data) - 20 and len(imports) < 80 and total < 400:
        first, _, _, dll, bound = struct.unpack_from("<5I", data, where)
        if not dll:
            break
        names, thunk = [], place(first or bound)
        step = 8 if wide else 4
        while 0 < thunk <= len(data) - step and total < 400:
            value = int.from_bytes(data[thunk : thunk + step], "little")
            if not value:
                break
            ordinal = value >> (8 * step - 1)
            names.append(f"ordinal {value & 0xFFFF}" if ordinal else text_at(data, place(value) + 2))
            thunk, total = thunk + step, total + 1
        imports.append({"dll": text_at(data, place(dll)), "functions": names})
        where += 20
    where = place(directories.get("export", (0, 0))[0])
    if 0 < where <= len(data) - 40:
        n, _, table = struct.unpack_from("<III", data, where + 24)
        table = place(struct.unpack_from("<I", data, where + 32)[0])
        exports = [text_at(data, place(struct.unpack_from("<I", data, table + 4 * k)[0])) for k in range(min(n, 400)) if 0 < table + 4 * k <= len(data) - 4]
    both = sum({"WRITE", "EXECUTE"} <= set(s["flags"]) for s in sections)
    dll = bool(flags & 0x2000)
    traits = [t for on, t in (
        (both, "Section with WRITE+EXECUTE permissions (common in packers/shellcode loaders)"),
        (directories.get("tls", (0, 0))[0], "TLS directory present (TLS callbacks run before entry point)"),
        (subsystem == 2, "GUI subsystem — no console"),
        (dll, "Dynamic-link library — loaded by other programs, never run directly"),
    ) if on] + [UNTRUSTED]
    return Parsed({
        "kind": "binary", "format": "pe", "machine": MACHINES.get(machine, hex(machine)), "pe32_plus": wide, "timestamp": stamp, "entry_point": entry, "image_base": base,
        "subsystem": SUBSYSTEMS.get(subsystem, str(subsystem)), "is_dll": dll, "sections": sections, "imports": imports, "exports": exports,
        "directories": {k: {"rva": v[0], "size": v[1]} for k, v in directories.items()}, "write_execute_sections": both, "traits": traits,
    })


@reader("elf")
def elf(data: bytes, name: str, fmt: str) -> Parsed:
    wide, e = data[4] == 2, "<" if data[5] == 1 else ">"
    kind, machine, _, entry, phoff, shoff, _, _, phsize, phnum, shsize, shnum, names_at = struct.unpack_from(e + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), data, 16)
    segments, sections = [], []
    for k in range(min(phnum, 128)):
        v = struct.unpack_from(e + ("IIQQQQQQ" if wide else "IIIIIIII"), data, phoff + k * phsize)
        t, flags, offset, address, size = (v[0], v[1], v[2], v[3], v[5]) if wide else (v[0], v[6], v[1], v[2], v[4])
        segments.append({"type": SEGMENTS.get(t, hex(t)), "offset": offset, "vaddr": address, "filesz": size, "flags": "".join(c if flags & b else "-" for c, b in (("R", 4), ("W", 2), ("X", 1)))})
    raw = [struct.unpack_from(e + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), data, shoff + k * shsize) for k in range(min(shnum, 200)) if shoff]
    names = data[raw[names_at][4] : raw[names_at][4] + raw[names_at][5]] if names_at < len(raw) else b""
    sections = [{"name": text_at(names, r[0]), "type": r[1], "offset": r[4], "size": r[5], "flags": r[2]} for r in raw]
    needed, soname, rpath = [], None, None
    strings = next((s for s in sections if s["name"] == ".dynstr"), None)
    dynamic = next((s for s in segments if s["type"] == "DYNAMIC"), None)
    if strings and dynamic:
        step = 16 if wide else 8
        for at in range(dynamic["offset"], dynamic["offset"] + dynamic["filesz"] - step + 1, step):
            tag, value = struct.unpack_from(e + ("QQ" if wide else "II"), data, at)
            word = text_at(data, strings["offset"] + value) if tag in (1, 14, 15, 29) else ""
            needed += [word] * (tag == 1)
            soname, rpath = word if tag == 14 else soname, word if tag in (15, 29) else rpath
            if not tag:
                break
    both = sum("W" in s["flags"] and "X" in s["flags"] for s in segments)
    traits = [t for on, t in ((both, "Segment with PF_W+PF_X (writable executable memory)"), (rpath, "DT_RPATH/DT_RUNPATH present (library search-path override)"), (kind == 3, "Shared object / library — never loaded or executed")) if on] + [UNTRUSTED]
    return Parsed({"kind": "binary", "format": "elf", "class": 64 if wide else 32, "endian": "little" if e == "<" else "big", "type": ELF_TYPES.get(kind, str(kind)), "machine": ELF_MACHINES.get(machine, hex(machine)), "entry_point": entry, "segments": segments, "sections": sections, "needed": needed, "soname": soname, "rpath": rpath, "write_execute_segments": both, "traits": traits})


def leb(data: bytes, at: int) -> tuple[int, int]:
    """An unsigned LEB128 number and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128 or shift > 63:
            return value, at


def write_leb(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


@reader("wasm")
def wasm(data: bytes, name: str, fmt: str) -> Parsed:
    version, at = struct.unpack_from("<I", data, 4)[0], 8
    sections, imports, exports = [], [], []

    def word(at: int) -> tuple[str, int]:
        n, at = leb(data, at)
        return data[at : at + n].decode("utf-8", "replace"), at + n

    while at < len(data) and len(sections) < 64:
        ident = data[at]
        size, body = leb(data, at + 1)
        label = WASM_SECTIONS[ident] if ident < len(WASM_SECTIONS) else f"unknown {ident}"
        sections.append({"id": ident, "name": label, "offset": body, "size": size})
        if label in ("import", "export"):
            n, p = leb(data, body)
            for _ in range(min(n, 200)):
                module, p = word(p) if label == "import" else ("", p)
                field, p = word(p)
                kind = WASM_KINDS[data[p]] if data[p] < 4 else str(data[p])
                (imports if label == "import" else exports).append({"module": module, "name": field, "kind": kind} if label == "import" else {"name": field, "kind": kind})
                p += 1
                if label == "export" or kind == "func":
                    _, p = leb(data, p)
                elif kind in ("table", "memory"):
                    p += kind == "table"
                    _, q = leb(data, p + 1)
                    p = leb(data, q)[1] if data[p] & 1 else q
                else:
                    p += 2
        at = body + size
    return Parsed({"kind": "binary", "format": "wasm", "version": version, "sections": sections, "imports": imports, "exports": exports}, [UNTRUSTED])


def create_wasm() -> bytes:
    """A module that exports add(i32, i32) -> i32."""
    section = lambda ident, body: bytes([ident]) + write_leb(len(body)) + body
    code = bytes([7, 0, 0x20, 0, 0x20, 1, 0x6A, 0x0B])
    return b"\0asm\1\0\0\0" + section(1, bytes([1, 0x60, 2, 0x7F, 0x7F, 1, 0x7F])) + section(3, b"\1\0") + section(7, b"\1\3add\0\0") + section(10, b"\1" + code)
