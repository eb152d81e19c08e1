"""Format detection as one CASE ladder over byte prefixes and text heuristics.

First match wins, in this order: empty, signatures, ISO media brands, tar, ASCII and
binary STL, MZ, AAC and MP3 frame marks, BSON length, text heuristics, extension,
unknown. Everything is a built-in expression but the look inside a ZIP, whose input is
null unless the file is one, so that no other file's bytes leave the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalar import extension, latin, looks_like_text, unsigned
from lodestone.model import DETECTION

# Hex signature at offset 0 | format | display | mime | extension | family
_SIGNATURES = """
89504E470D0A1A0A|png|PNG image|image/png|png|IMAGE
FFD8FF|jpeg|JPEG image|image/jpeg|jpg|IMAGE
474946383761|gif|GIF image|image/gif|gif|ANIMATION
474946383961|gif|GIF image|image/gif|gif|ANIMATION
424D|bmp|BMP image|image/bmp|bmp|IMAGE
49492A00|tiff|TIFF image|image/tiff|tiff|IMAGE
4D4D002A|tiff|TIFF image|image/tiff|tiff|IMAGE
255044462D|pdf|PDF document|application/pdf|pdf|DOCUMENT
504B0304|zip|ZIP archive|application/zip|zip|ARCHIVE
504B0506|zip|ZIP archive (empty)|application/zip|zip|ARCHIVE
1F8B|gzip|GZIP stream|application/gzip|gz|ARCHIVE
377ABCAF271C|7z|7-Zip archive|application/x-7z-compressed|7z|ARCHIVE
7F454C46|elf|ELF binary|application/x-elf|elf|EXECUTABLE
0061736D|wasm|WebAssembly module|application/wasm|wasm|EXECUTABLE
664C6143|flac|FLAC audio|audio/flac|flac|AUDIO
4F676753|ogg|OGG container|audio/ogg|ogg|AUDIO
52494646|riff|RIFF container|application/octet-stream|riff|MULTIMEDIA_CONTAINER
1A45DFA3|ebml|EBML / Matroska|video/x-matroska|mkv|VIDEO
53514C69746520666F726D6174203300|sqlite|SQLite database|application/vnd.sqlite3|sqlite|DATABASE
676C5446|glb|glTF binary (GLB)|model/gltf-binary|glb|3D
8B5346500D0A1A0A|sfp|SFP container|application/x-sfp|sfp|PROTOCOL
D0CF11E0A1B11AE1|ole|OLE compound document|application/x-ole-storage|doc|DOCUMENT
494433|mp3|MP3 audio (ID3 tag)|audio/mpeg|mp3|AUDIO
10000000774F4646|woff|WOFF font|font/woff|woff|BINARY
774F4632|woff2|WOFF2 font|font/woff2|woff2|BINARY
"""
# Brand | format | display | mime | extension | family
_BRANDS = """
qt  |mov|QuickTime video|video/quicktime|mov|VIDEO
isom|mp4|MPEG-4 video|video/mp4|mp4|VIDEO
mp41|mp4|MPEG-4 video|video/mp4|mp4|VIDEO
mp42|mp4|MPEG-4 video|video/mp4|mp4|VIDEO
avc1|mp4|MPEG-4 video|video/mp4|mp4|VIDEO
M4A |mp4|MPEG-4 audio|audio/mp4|m4a|AUDIO
M4V |mp4|MPEG-4 video|video/mp4|m4v|VIDEO
3gp4|mp4|3GPP video|video/3gpp|3gp|VIDEO
heic|heic|HEIF image|image/heic|heic|IMAGE
avif|avif|AVIF image|image/avif|avif|IMAGE
"""
# Extension | format | display | mime | family; the first row of an extension counts
_EXTENSIONS = """
txt|txt|Plain text|text/plain|TEXT
log|txt|Log text|text/plain|TEXT
md|md|Markdown|text/markdown|TEXT
markdown|md|Markdown|text/markdown|TEXT
csv|csv|CSV table|text/csv|TEXT
tsv|csv|TSV table|text/tab-separated-values|TEXT
json|json|JSON data|application/json|TEXT
jsonl|json|JSON Lines|application/x-ndjson|TEXT
xml|xml|XML document|application/xml|TEXT
html|html|HTML document|text/html|TEXT
htm|html|HTML document|text/html|TEXT
svg|svg|SVG image|image/svg+xml|IMAGE
yaml|yaml|YAML data|application/yaml|TEXT
yml|yaml|YAML data|application/yaml|TEXT
toml|toml|TOML data|application/toml|TEXT
rtf|rtf|RTF document|application/rtf|DOCUMENT
ini|ini|INI config|text/plain|TEXT
obj|obj|Wavefront OBJ mesh|model/obj|3D
stl|stl|STL mesh|model/stl|3D
gltf|gltf|glTF scene|model/gltf+json|3D
bson|bson|BSON document|application/bson|TEXT
docx|docx|Word document|application/vnd.openxmlformats-officedocument.wordprocessingml.document|DOCUMENT
epub|epub|EPUB book|application/epub+zip|DOCUMENT
py|python|Python source|text/x-python|SOURCE_CODE
js|javascript|JavaScript source|text/javascript|SOURCE_CODE
mjs|javascript|JavaScript module|text/javascript|SOURCE_CODE
ts|typescript|TypeScript source|text/x-typescript|SOURCE_CODE
c|c|C source|text/x-c|SOURCE_CODE
h|c-header|C header|text/x-c|SOURCE_CODE
cpp|cpp|C++ source|text/x-c++|SOURCE_CODE
cc|cpp|C++ source|text/x-c++|SOURCE_CODE
hpp|cpp-header|C++ header|text/x-c++|SOURCE_CODE
java|java|Java source|text/x-java|SOURCE_CODE
rs|rust|Rust source|text/x-rust|SOURCE_CODE
go|go|Go source|text/x-go|SOURCE_CODE
cs|csharp|C# source|text/x-csharp|SOURCE_CODE
css|css|CSS stylesheet|text/css|SOURCE_CODE
sh|shell|Shell script|text/x-shellscript|SOURCE_CODE
rb|ruby|Ruby source|text/x-ruby|SOURCE_CODE
wav|wav|WAV audio|audio/wav|AUDIO
mp3|mp3|MP3 audio|audio/mpeg|AUDIO
flac|flac|FLAC audio|audio/flac|AUDIO
ogg|ogg|OGG audio|audio/ogg|AUDIO
aac|aac|AAC audio|audio/aac|AUDIO
m4a|mp4|MPEG-4 audio|audio/mp4|AUDIO
mp4|mp4|MPEG-4 video|video/mp4|VIDEO
m4v|mp4|MPEG-4 video|video/mp4|VIDEO
mkv|mkv|Matroska video|video/x-matroska|VIDEO
webm|webm|WebM video|video/webm|VIDEO
avi|avi|AVI video|video/x-msvideo|VIDEO
mov|mov|QuickTime video|video/quicktime|VIDEO
webp|webp|WebP image|image/webp|IMAGE
exe|pe|PE executable|application/vnd.microsoft.portable-executable|EXECUTABLE
dll|pe|PE library|application/vnd.microsoft.portable-executable|EXECUTABLE
sys|pe|PE driver|application/vnd.microsoft.portable-executable|EXECUTABLE
elf|elf|ELF binary|application/x-elf|EXECUTABLE
so|elf|ELF shared object|application/x-elf|EXECUTABLE
o|elf|ELF object|application/x-elf|EXECUTABLE
wasm|wasm|WebAssembly module|application/wasm|EXECUTABLE
zip|zip|ZIP archive|application/zip|ARCHIVE
jar|zip|Java archive (ZIP)|application/java-archive|ARCHIVE
tar|tar|TAR archive|application/x-tar|ARCHIVE
gz|gzip|GZIP stream|application/gzip|ARCHIVE
tgz|gzip|GZIP stream (tarball)|application/gzip|ARCHIVE
7z|7z|7-Zip archive|application/x-7z-compressed|ARCHIVE
"""
# Kinds of ZIP | display | mime | confidence | notes | family
_ZIPS = """
epub|EPUB book|application/epub+zip|0.95|ZIP with EPUB mimetype entry|DOCUMENT
docx|Word document (OOXML)|application/vnd.openxmlformats-officedocument.wordprocessingml.document|0.95|ZIP with OOXML word/ part|DOCUMENT
pptx|PowerPoint (OOXML)|application/vnd.openxmlformats-officedocument.presentationml.presentation|0.9|ZIP with OOXML ppt/ part|DOCUMENT
xlsx|Excel (OOXML)|application/vnd.openxmlformats-officedocument.spreadsheetml.sheet|0.9|ZIP with OOXML xl/ part|DOCUMENT
jar|Java archive (ZIP)|application/java-archive|0.9|ZIP with Java manifest|ARCHIVE
zip|ZIP archive|application/zip|0.97|PKZIP local headers|ARCHIVE
"""
FIELDS = [c.split()[0] for c in DETECTION.split(", ")]
LOCAL_HEADER = b"PK\x03\x04"


def rows(table: str) -> list[list[str]]:
    return [line.split("|") for line in table.strip("\n").split("\n")]


EXTENSIONS = {r[0]: r[1:] for r in rows(_EXTENSIONS)}
SOURCE_EXTENSIONS = [e for e, r in EXTENSIONS.items() if r[3] == "SOURCE_CODE"]


def found(format_id, display, mime, ext, confidence, method, notes, family) -> Column:
    values = (format_id, display, mime, ext, confidence, method, notes, family)
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(f) for f, v in zip(FIELDS, values)))


def kind_of_zip(data: bytes) -> str:
    """What an archive's first 40 local headers tell about its purpose."""
    names, at = [], 0
    while at >= 0 and at + 30 < len(data) and len(names) < 40 and data.startswith(LOCAL_HEADER, at):
        name_length, extra = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (26, 28))
        names.append(data[at + 30 : at + 30 + name_length])
        at = data.find(LOCAL_HEADER, at + 30 + name_length + extra)
    listed = b"\n".join(names)
    clues = (
        ("epub", b"mimetype" in listed and b"application/epub+zip" in data[:8192]),
        ("docx", b"word/document.xml" in listed or (b"[Content_Types].xml" in listed and b"word/" in listed)),
        ("pptx", b"ppt/" in listed),
        ("xlsx", b"xl/" in listed),
        ("jar", b"META-INF/MANIFEST.MF" in listed),
    )
    return next((kind for kind, seen in clues if seen), "zip")


@F.pandas_udf(T.StringType())
def zip_kind(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else kind_of_zip(bytes(d)))


def signature_branches(s: Column) -> list[tuple[Column, Column]]:
    out = []
    data, inside = s["data"], s["zip"]
    for digits, fmt, display, mime, ext, family in rows(_SIGNATURES):
        size = len(digits) // 2
        hit = F.substring(data, 1, size) == F.lit(bytes.fromhex(digits))
        notes = f"signature {bytes.fromhex(digits)[:8]!r}"
        if fmt == "zip":
            kinds = F.lit(None).cast(f"struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in DETECTION.split(', '))}>")
            for kind, kind_display, kind_mime, sure, why, kind_family in reversed(rows(_ZIPS)):
                how = "magic" if kind == "zip" else "container"
                kinds = F.when(inside == kind, found(kind, kind_display, kind_mime, kind, float(sure), how, why, kind_family)).otherwise(kinds)
            out.append((hit, kinds))
        elif fmt == "gzip":
            out.append((hit, found(fmt, display, mime, ext, 0.97, "magic", "GZIP member header", family)))
        elif fmt == "riff":
            form = latin(F.substring(data, 9, 4))
            riff = (
                F.when(form == "WAVE", found("wav", "WAV audio", "audio/wav", "wav", 0.99, "magic", "RIFF/WAVE container", "AUDIO"))
                .when(form == "AVI ", found("avi", "AVI video", "video/x-msvideo", "avi", 0.99, "magic", "RIFF/AVI container", "VIDEO"))
                .when(form == "WEBP", found("webp", "WebP image", "image/webp", "webp", 0.99, "magic", "RIFF/WEBP container", "IMAGE"))
                .otherwise(found(fmt, display, mime, ext, 0.8, "magic", F.concat(F.lit("RIFF form: "), form), family))
            )
            out.append((hit & (F.length(data) >= 12), riff))
            out.append((hit, unknown(s)))
        elif fmt == "ebml":
            head = latin(F.substring(data, 1, 4096))
            ebml = (
                F.when(F.contains(head, F.lit("webm")), found("webm", "WebM video", "video/webm", "webm", 0.95, "container", "EBML DocType 'webm'", "VIDEO"))
                .when(F.contains(head, F.lit("matroska")), found("mkv", "Matroska video", mime, ext, 0.95, "container", "EBML DocType 'matroska'", "VIDEO"))
                .otherwise(found("mkv", "Matroska/EBML container", mime, ext, 0.7, "magic", "EBML header without recognised DocType", "VIDEO"))
            )
            out.append((hit, ebml))
        else:
            out.append((hit, found(fmt, display, mime, ext, 0.99, "magic", notes, family)))
    return out


def unknown(s: Column) -> Column:
    return found("blob", "Unknown binary", "application/octet-stream", s["ext"], 0.3, "extension", "no signature matched — preserved as raw bytes", "BINARY")


def media_brand(data: Column) -> Column:
    brand = latin(F.substring(data, 9, 4))
    notes = F.concat(F.lit("ISO-BMFF ftyp brand '"), brand, F.lit("'"))
    out = found("mp4", "ISO-BMFF container", "video/mp4", "mp4", 0.85, "container", notes, "MULTIMEDIA_CONTAINER")
    for name, fmt, display, mime, ext, family in rows(_BRANDS):
        out = F.when(brand == name, found(fmt, display, mime, ext, 0.97, "container", notes, family)).otherwise(out)
    return out


def executable(s: Column) -> Column:
    data = s["data"]
    at = unsigned(data, 0x3C, 4)
    real = (F.length(data) > 0x40) & (at > 0) & (at < F.length(data) - 4) & (data.substr((at + 1).cast("int"), F.lit(4)) == F.lit(b"PE\x00\x00"))
    mime = "application/vnd.microsoft.portable-executable"
    ext = F.when(s["ext"] == "dll", "dll").otherwise("exe")
    return F.when(real, found("pe", "PE executable", mime, ext, 0.99, "magic", "MZ + PE\\0\\0 signature", "EXECUTABLE")).otherwise(
        found("pe", "PE executable", mime, "exe", 0.9, "magic", "MZ DOS stub", "EXECUTABLE")
    )


def looks_like_json(sample: Column) -> Column:
    """Starts as JSON does, and brackets outside of strings don't stay open within 2000 characters."""
    trimmed = F.regexp_replace(sample, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.substring(trimmed, 1, 2000), r'(?s)"(\\.|[^"\\])*\\?("|$)', "")
    opened = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    return trimmed.rlike(r'^[\[{"]') & ~F.startswith(trimmed, F.lit("{\\")) & (opened <= 0)


def looks_like_csv(sample: Column) -> Column:
    """Two lines or more (12 are looked at) with the same number of commas, at least one."""
    lines = F.slice(F.filter(F.split(sample, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda r: r.rlike(r"(?U)\S")), 1, 12)
    commas = F.array_distinct(F.transform(lines, lambda r: F.length(r) - F.length(F.replace(r, F.lit(","), F.lit("")))))
    return (F.size(lines) >= 2) & (F.size(commas) == 1) & (commas[0] >= 1)


def text_sample(data: Column) -> Column:
    head = F.substring(data, 1, 4096)
    return F.coalesce(F.try_validate_utf8(head.cast("string")), latin(head))


def text_branches(s: Column) -> list[tuple[Column, Column]]:
    """The branches for bytes that look like text; the last always holds."""
    sure, sample, ext, body = s["sure"], s["sample"], s["ext"], s["body"]
    first = lambda n: F.substring(sample, 1, n)
    line = s["line"]
    within = lambda *e: ext.isin(*e)
    starts = lambda s: F.startswith(body, F.lit(s))
    cap = lambda most: F.least(F.lit(most), sure)

    def row(fmt, display, mime, confidence, notes, family="TEXT"):
        return found(fmt, display, mime, fmt, confidence, "text-heuristic", notes, family)

    yaml_ext = within("yaml", "yml")
    yaml_body = first(2000).rlike(r"^[A-Za-z_](?U:[\w\-]*):(?U:\s*\S)") & F.contains(line, F.lit(":"))
    toml_body = starts("[") & body.rlike(r"^\[(?U:[\w.\-]+)\]")
    csv_body = F.contains(line, F.lit(",")) & F.contains(sample, F.lit("\n")) & looks_like_csv(sample)
    md_body = first(2000).rlike(r"(?m)^#{1,6}(?U:\s)|\*\*.+\*\*|\[.+\]\(.+\)")
    obj_body = (starts("v ") | starts("o ") | starts("# Wavefront")) & first(2000).rlike(r"(?m)^v(?U:\s+)-?(?U:\d)")
    rtf = "RTF document", "application/rtf"
    out = [
        (starts("{\\rtf"), row("rtf", *rtf, cap(0.95), "{\\rtf header", "DOCUMENT")),
        ((starts("{") | starts("[")) & (within("json", "jsonl") | looks_like_json(sample)), row("json", "JSON data", "application/json", cap(0.9), "JSON punctuation + structure")),
        (starts("<?xml") | (starts("<") & (ext == "xml")), row("xml", "XML document", "application/xml", cap(0.85), "XML declaration/structure")),
        (within("html", "htm") | first(1024).rlike(r"(?i)<!doctype(?U:\s)+html|<html((?U:\s)|>)"), row("html", "HTML document", "text/html", cap(0.9), "HTML structure")),
        ((ext == "svg") | (F.contains(first(2048), F.lit("<svg")) & F.contains(sample, F.lit("xmlns"))), row("svg", "SVG image", "image/svg+xml", cap(0.9), "<svg> root element", "IMAGE")),
        (yaml_ext | (yaml_body & within("txt", "")), row("yaml", "YAML data", "application/yaml", F.when(yaml_ext, cap(0.7)).otherwise(0.45), "key: value structure")),
        ((ext == "toml") | toml_body, row("toml", "TOML data", "application/toml", cap(0.75), "[table] + key = value")),
        ((ext == "csv") | csv_body, row("csv", "CSV table", "text/csv", F.when(ext == "csv", cap(0.8)).otherwise(0.55), "delimited rows of equal field count")),
        ((ext == "md") | (md_body & within("markdown", "txt", "")), row("md", "Markdown", "text/markdown", F.when(within("md", "markdown"), cap(0.8)).otherwise(0.5), "markdown constructs")),
        ((ext == "obj") | obj_body, row("obj", "Wavefront OBJ mesh", "model/obj", cap(0.8), "OBJ vertex records", "3D")),
        (ext == "rtf", row("rtf", *rtf, cap(0.9), "{\\rtf header", "DOCUMENT")),
    ]
    for e in SOURCE_EXTENSIONS:
        fmt, display, mime, family = EXTENSIONS[e]
        out.append((ext == e, found(fmt, display, mime, e, cap(0.75), "text-heuristic", "text + known source extension", family)))
    out.append((within("txt", "log", ""), row("txt", "Plain text", "text/plain", sure, "printable text")))
    out.append((F.lit(True), row("txt", "Plain text (unknown subtype)", "text/plain", F.round(sure * 0.8, 2), "printable text, no structure matched")))
    return out


def by_extension(s: Column) -> Column:
    """The extension's format with confidence 0.4, else unknown; one map lookup."""
    ext = s["ext"]
    table = F.create_map(*(x for e, r in EXTENSIONS.items() for x in (F.lit(e), F.array(*map(F.lit, r)))))
    hit = F.try_element_at(table, ext)
    notes = "extension match only (no strong signature)"
    return F.when(hit.isNull(), unknown(s)).otherwise(found(hit[0], hit[1], hit[2], ext, 0.4, "extension", notes, hit[3]))


def ladder(branches: list[tuple[Column, Column]]) -> Column:
    out = F.when(*branches[0])
    for hit, value in branches[1:]:
        out = out.when(hit, value)
    return out


def facts(data: Column, name: Column) -> Column:
    """What the branches look at, computed once a row."""
    is_zip = F.hex(F.substring(data, 1, 4)).isin("504B0304", "504B0506")
    ok, sure = looks_like_text(data)
    sample = text_sample(data)
    return F.struct(
        data.alias("data"),
        extension(name).alias("ext"),
        zip_kind(F.when(is_zip, data)).alias("zip"),
        ok.alias("ok"),
        sure.alias("sure"),
        sample.alias("sample"),
        F.regexp_replace(sample, r"(?U)^\s+", "").alias("body"),
        F.substring_index(sample, "\n", 1).alias("line"),
    )


def branches(s: Column) -> list[tuple[Column, Column]]:
    data, n = s["data"], F.length(s["data"])
    tar = (n > 262) & (F.substring(data, 258, 5) == F.lit(b"ustar"))
    triangles = unsigned(data, 80, 4)
    first, second = unsigned(data, 0, 1), unsigned(data, 1, 1)
    return [
        (n == 0, found("empty", "Empty file", "application/x-empty", s["ext"], 1.0, "magic", "zero-byte file", "BINARY")),
        *signature_branches(s),
        ((n >= 12) & (F.substring(data, 5, 4) == F.lit(b"ftyp")), media_brand(data)),
        (tar, found("tar", "TAR archive", "application/x-tar", "tar", 0.95, "magic", "ustar magic at offset 257", "ARCHIVE")),
        (
            latin(F.substring(data, 1, 256)).rlike(r"(?s)^[ \t-\r]*solid[\x20-\x7e]{0,80}?[ \t-\r]*(facet|endsolid)"),
            found("stl", "STL mesh (ASCII)", "model/stl", "stl", 0.85, "text-heuristic", "ASCII 'solid ... facet' structure", "3D"),
        ),
        (
            (n < 200_000_000) & (triangles > 0) & (triangles * 50 + 84 == n),
            found("stl", "STL mesh (binary)", "model/stl", "stl", 0.95, "magic", "binary STL triangle table matches file size", "3D"),
        ),
        (F.substring(data, 1, 2) == F.lit(b"MZ"), executable(s)),
        ((n > 2) & (first == 255) & (second.bitwiseAND(0xF6) == 0xF0), found("aac", "AAC audio (ADTS)", "audio/aac", "aac", 0.7, "magic", "ADTS syncword", "AUDIO")),
        ((n > 4) & (first == 255) & (second.bitwiseAND(0xE0) == 0xE0), found("mp3", "MP3 audio (MPEG frame)", "audio/mpeg", "mp3", 0.7, "magic", "MPEG audio frame sync", "AUDIO")),
        (
            n.between(5, 16_000_000) & (unsigned(data, 0, 4) == n) & (data.substr(n, F.lit(1)) == F.lit(b"\x00")),
            found("bson", "BSON document", "application/bson", "bson", 0.6, "text-heuristic", "BSON document length prefix", "TEXT"),
        ),
        (s["ok"], ladder(text_branches(s))),
        (F.lit(True), by_extension(s)),
    ]


def detect(data: Column, name: Column) -> Column:
    """Struct column of the detection of ``data`` (binary) under the file name ``name``. Null data counts as empty.

    The ladder is the body of a lambda over the facts, so each of them appears (and is computed) once; written out
    at every use, the expression would take seconds to plan and compile.
    """
    data, name = F.coalesce(data, F.lit(b"")), F.coalesce(name, F.lit(""))
    return F.transform(F.array(facts(data, name)), lambda s: ladder(branches(s)))[0]


def magic_report(data: Column, name: Column) -> Column:
    """The detection's format and confidence with the first 16 bytes in hex and ASCII."""
    head = F.substring(data, 1, 16)
    return F.struct(
        detect(data, name).alias("detection"),
        F.rtrim(F.regexp_replace(F.lower(F.hex(head)), "(..)", "$1 ")).alias("head_bytes_hex"),
        F.regexp_replace(latin(head), r"[^\x20-\x7e]", ".").alias("head_bytes_ascii"),
    )
