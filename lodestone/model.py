"""Data model: one file is one row of ``objects``; vocabularies, limits and catalogs are small relations.

The catalogs below are written as text so that they read as the tables they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vocabularies.
OBJECT_TYPES = (
    "TEXT DOCUMENT IMAGE AUDIO VIDEO ANIMATION 3D ARCHIVE EXECUTABLE SOURCE_CODE DATABASE BINARY DIRECTORY MULTIMEDIA_CONTAINER PROTOCOL UNKNOWN"
).split()
SUPPORT_LEVELS = ("FULL SUPPORT", "PARTIAL SUPPORT", "INSPECTION ONLY", "UNSUPPORTED")
CONVERSION_KINDS = ("LOSSLESS", "LOSSY", "STRUCTURAL", "RENDERED", "RECONSTRUCTED")
VERBS = ("detect", "read", "parse", "decode", "create", "edit", "encode", "export", "inspect")
RELATIONS = ("contains", "frame_of", "page_of", "derived_from", "stream_of")


@dataclass(frozen=True)
class Limits:
    """Guards against hostile input."""

    file_bytes: int = 64 << 20
    archive_entries: int = 10_000
    archive_total: int = 256 << 20
    archive_ratio: int = 200
    ratio_from: int = 4 << 20
    entry_bytes: int = 64 << 20
    json_depth: int = 200
    text_chars: int = 8 << 20
    image_pixels: int = 40_000_000
    children: int = 10_000
    bson_depth: int = 100
    csv_rows: int = 20_000
    recent: int = 50


LIMITS = Limits()

DETECTION = "format_id string, display string, mime string, extension string, confidence double, method string, notes string, family string"
HISTORY = "step int, action string, detail string, kind string, params string, ts timestamp"
EXPORT_OPTION = "format string, label string, kind string, notes string"
_FIELDS = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in DETECTION.split(", "))
OBJECTS = f"""object_id string, parent_id string, object_type string, version int, original_filename string,
    original_extension string, detected_format string, mime string, size bigint, checksum string, support_level string,
    detection struct<{_FIELDS}>, content string, warnings array<string>, original_bytes binary, adapter string"""

# Format | display | extensions | mime | category | support | verbs (r read, c create, e edit, x export) | detection | adapter
_FORMATS = """
txt|Plain text|txt,log|text/plain|TEXT|F|rcex|text-heuristic|text
md|Markdown|md,markdown|text/markdown|TEXT|F|rcex|text-heuristic|text
csv|CSV table|csv,tsv|text/csv|TEXT|P|rcex|text-heuristic|text
rtf|RTF document|rtf|application/rtf|DOCUMENT|P|rx|text-heuristic|text
html|HTML document|html,htm|text/html|TEXT|P|rcex|text-heuristic|markup
xml|XML document|xml|application/xml|TEXT|P|rcex|text-heuristic|markup
json|JSON data|json,jsonl|application/json|TEXT|F|rcex|text-heuristic|json
yaml|YAML data|yaml,yml|application/yaml|TEXT|P|rcex|text-heuristic|yaml-toml
toml|TOML data|toml|application/toml|TEXT|P|rcex|text-heuristic|yaml-toml
bson|BSON document|bson|application/bson|TEXT|I|r|text-heuristic|bson
png|PNG image|png|image/png|IMAGE|F|rcex|magic|raster
bmp|BMP image|bmp|image/bmp|IMAGE|F|rcex|magic|raster
gif|GIF image/animation|gif|image/gif|ANIMATION|F|rcex|magic|raster
jpeg|JPEG image|jpg,jpeg|image/jpeg|IMAGE|I|r|magic|raster
webp|WebP image|webp|image/webp|IMAGE|I|r|magic|raster
tiff|TIFF image|tiff,tif|image/tiff|IMAGE|I|r|magic|raster
svg|SVG image|svg|image/svg+xml|IMAGE|P|rcex|text-heuristic|svg
wav|WAV audio|wav|audio/wav|AUDIO|F|rcx|magic|wav
mp3|MP3 audio|mp3|audio/mpeg|AUDIO|I|r|magic|audio-inspect
flac|FLAC audio|flac|audio/flac|AUDIO|I|r|magic|audio-inspect
ogg|OGG container|ogg,oga|audio/ogg|AUDIO|I|r|magic|audio-inspect
aac|AAC audio (ADTS)|aac|audio/aac|AUDIO|I|r|magic|audio-inspect
mp4|MPEG-4 video|mp4,m4v,m4a,3gp|video/mp4|VIDEO|I|r|container|iso-bmff
mov|QuickTime video|mov|video/quicktime|VIDEO|I|r|container|iso-bmff
mkv|Matroska video|mkv|video/x-matroska|VIDEO|I|r|container|matroska
webm|WebM video|webm|video/webm|VIDEO|I|r|container|matroska
avi|AVI video|avi|video/x-msvideo|VIDEO|I|r|magic|avi
obj|Wavefront OBJ mesh|obj|model/obj|3D|P|rcx|text-heuristic|obj
stl|STL mesh|stl|model/stl|3D|P|rcx|magic|stl
gltf|glTF scene|gltf|model/gltf+json|3D|P|rcx|extension|gltf
glb|glTF binary (GLB)|glb|model/gltf-binary|3D|P|rcx|magic|gltf
zip|ZIP archive|zip,jar|application/zip|ARCHIVE|F|rcx|magic|zip
tar|TAR archive|tar|application/x-tar|ARCHIVE|F|rcx|magic|tar-gzip
gzip|GZIP stream|gz,tgz|application/gzip|ARCHIVE|P|rcx|magic|tar-gzip
7z|7-Zip archive|7z|application/x-7z-compressed|ARCHIVE|I|r|magic|seven-zip
pe|PE executable (EXE/DLL)|exe,dll,sys,ocx,cpl|application/vnd.microsoft.portable-executable|EXECUTABLE|I|r|magic|pe
elf|ELF binary|elf,so,o,bin|application/x-elf|EXECUTABLE|I|r|magic|elf
wasm|WebAssembly module|wasm|application/wasm|EXECUTABLE|P|rcx|magic|wasm
c|C source|c,h|text/x-c|SOURCE_CODE|F|rcex|text-heuristic|source
cpp|C++ source|cpp,cc,hpp,cxx|text/x-c++|SOURCE_CODE|F|rcex|text-heuristic|source
python|Python source|py|text/x-python|SOURCE_CODE|F|rcex|text-heuristic|source
javascript|JavaScript source|js,mjs|text/javascript|SOURCE_CODE|F|rcex|text-heuristic|source
java|Java source|java|text/x-java|SOURCE_CODE|F|rcex|text-heuristic|source
rust|Rust source|rs|text/x-rust|SOURCE_CODE|F|rcex|text-heuristic|source
go|Go source|go|text/x-go|SOURCE_CODE|F|rcex|text-heuristic|source
csharp|C# source|cs|text/x-csharp|SOURCE_CODE|F|rcex|text-heuristic|source
css|CSS stylesheet|css|text/css|SOURCE_CODE|F|rcex|text-heuristic|source
typescript|TypeScript source|ts|text/x-typescript|SOURCE_CODE|F|rcex|text-heuristic|source
shell|Shell script|sh|text/x-shellscript|SOURCE_CODE|F|rcex|text-heuristic|source
ruby|Ruby source|rb|text/x-ruby|SOURCE_CODE|F|rcex|text-heuristic|source
c-header|C header|h|text/x-c|SOURCE_CODE|F|rcex|text-heuristic|source
cpp-header|C++ header|hpp|text/x-c++|SOURCE_CODE|F|rcex|text-heuristic|source
sqlite|SQLite database|sqlite,sqlite3,db|application/vnd.sqlite3|DATABASE|P|rx|magic|sqlite
blob|Binary blob|bin,dat,|application/octet-stream|BINARY|P|rcx|extension|blob
empty|Empty file||application/x-empty|BINARY|P|rc|magic|blob
docx|Word document (OOXML)|docx|application/vnd.openxmlformats-officedocument.wordprocessingml.document|DOCUMENT|P|rcx|container|docx
epub|EPUB book|epub|application/epub+zip|DOCUMENT|P|rcx|container|epub
pdf|PDF document|pdf|application/pdf|DOCUMENT|P|rcx|magic|pdf
sfp|SFP container|sfp|application/x-sfp|PROTOCOL|F|rcex|magic|sfp
"""
_SUPPORT = {"F": SUPPORT_LEVELS[0], "P": SUPPORT_LEVELS[1], "I": SUPPORT_LEVELS[2]}


@dataclass(frozen=True)
class Format:
    format: str
    display: str
    extension: str
    mime: str
    category: str
    support: str
    read: bool
    create: bool
    edit: bool
    export: bool
    detection: str
    adapter: str


def _format(line: str) -> Format:
    name, display, extensions, mime, category, support, verbs, detection, adapter = line.split("|")
    return Format(name, display, extensions, mime, category, _SUPPORT[support], *(v in verbs for v in "rcex"), detection, adapter)


FORMATS: dict[str, Format] = {f.format: f for f in map(_format, _FORMATS.strip().split("\n"))}
SOURCE_LANGUAGES = tuple(f.format for f in FORMATS.values() if f.adapter == "source")

# Formats : target kind, target kind ... (L lossless, Y lossy, S structural, R rendered, C reconstructed)
_EXPORTS = """
txt : txt C, md C, html C, rtf C
md : txt C, md C, html C, rtf C
csv : txt C, md C, html C, rtf C, json S
rtf : txt C, html C, rtf C
html : txt S, html L, md C
xml : txt S, html C, md C
json : json L, yaml S, toml S, csv S, txt C
yaml : txt L, json S, yaml L
toml : txt L, json S, toml L
bson : json C
png bmp gif jpeg webp tiff : png L, bmp L, gif Y, ppm L, svg C
svg : svg L, txt S
wav : wav L, json S, txt R
mp3 flac ogg aac : json S
mp4 mov mkv webm avi : json S
obj : obj L, json S, stl C
stl : stl L, obj C, json S
gltf glb : json S, obj C
zip : zip S, json S
tar : tar L, json S
gzip : gzip L, json S
7z :
pe elf : json S, txt S
wasm : wasm L, json S
sqlite : sqlite L, json S, sql S
blob : blob L, txt S
docx : docx L, txt S, html C, json S
epub : epub L, txt S, html C, json S
pdf : pdf L, txt S, json S, html C
sfp : json S, txt S
empty : blob L, txt S
"""
_KIND = {"L": "LOSSLESS", "Y": "LOSSY", "S": "STRUCTURAL", "R": "RENDERED", "C": "RECONSTRUCTED"}


def _exports() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for line in _EXPORTS.strip().split("\n"):
        left, _, right = line.partition(":")
        edges = [(t.split()[0], _KIND[t.split()[1]]) for t in right.split(",") if t.strip()]
        for name in left.split():
            out[name] = edges + [("sfp", "LOSSLESS")]
    for name in SOURCE_LANGUAGES:
        out[name] = [(name, "LOSSLESS"), ("txt", "LOSSLESS"), ("html", "RECONSTRUCTED"), ("sfp", "LOSSLESS")]
    return out


#: format -> [(target, kind)]; every format can be saved as a container.
EXPORTS = _exports()

# Id | label | object types | formats (empty: any) | kind | parameters with defaults
_TRANSFORMS = """
image.resize|Resize image|IMAGE|png,bmp,gif,jpeg,webp,ppm|LOSSY|width=320,height=240,smooth=true
image.crop|Crop image|IMAGE|png,bmp,gif,jpeg,webp,ppm|LOSSLESS|x=0,y=0,width=64,height=64
image.rotate|Rotate 90/180/270|IMAGE|png,bmp,gif,jpeg,webp,ppm|LOSSLESS|degrees=90
image.grayscale|Grayscale|IMAGE|png,bmp,gif,jpeg,webp,ppm|LOSSY|
image.flip|Flip|IMAGE|png,bmp,gif,jpeg,webp,ppm|LOSSLESS|axis=horizontal
gif.extract_frame|Extract GIF frame|ANIMATION|gif|LOSSLESS|index=0
text.markdown_to_html|Markdown → HTML|TEXT|md|STRUCTURAL|
text.to_html_page|Text → HTML page|TEXT|txt,md,csv,json,xml,yaml,toml|RECONSTRUCTED|title=
text.stats|Text statistics|TEXT,SOURCE_CODE||LOSSLESS|
json.pretty|Pretty-print JSON|TEXT|json|LOSSLESS|sort_keys=false
json.minify|Minify JSON|TEXT|json|LOSSLESS|
json.to_yaml|JSON → YAML|TEXT|json|STRUCTURAL|
json.to_toml|JSON → TOML|TEXT|json|STRUCTURAL|
json.to_csv|JSON → CSV|TEXT|json|STRUCTURAL|
archive.extract_all|Extract archive children|ARCHIVE||STRUCTURAL|limit=200
document.extract_text|Extract text|DOCUMENT||STRUCTURAL|
pdf.extract_text|Extract PDF text|DOCUMENT|pdf|STRUCTURAL|
audio.waveform|Compute waveform peaks|AUDIO|wav|LOSSLESS|buckets=240
binary.static_analysis|Static analysis (safe)|EXECUTABLE||STRUCTURAL|
mesh.stats|Mesh statistics|3D||LOSSLESS|
"""


@dataclass(frozen=True)
class TransformRow:
    id: str
    label: str
    applies_to: tuple[str, ...]
    formats: tuple[str, ...]
    kind: str
    params: str


TRANSFORMS: dict[str, TransformRow] = {}
for _line in _TRANSFORMS.strip().split("\n"):
    _id, _label, _types, _formats, _conversion, _params = _line.split("|")
    TRANSFORMS[_id] = TransformRow(_id, _label, tuple(_types.split(",")), tuple(f for f in _formats.split(",") if f), _conversion, _params)


def formats(spark: SparkSession) -> DataFrame:
    """The format catalog (59 rows)."""
    columns = ["format", "display", "extension", "category", "mime", "read", "create", "edit", "export", "detection", "support"]
    return spark.createDataFrame([tuple(getattr(f, c) for c in columns) for f in FORMATS.values()], columns)


def exports(spark: SparkSession) -> DataFrame:
    """One row an export edge: format, target, kind, position."""
    rows = [(f, t, k, i) for f, edges in EXPORTS.items() for i, (t, k) in enumerate(edges)]
    return spark.createDataFrame(rows, "format string, target string, kind string, position int")


def transforms(spark: SparkSession) -> DataFrame:
    """The transform registry (20 rows)."""
    rows = [(t.id, t.label, list(t.applies_to), list(t.formats), t.kind, t.params) for t in TRANSFORMS.values()]
    return spark.createDataFrame(rows, "id string, label string, applies_to array<string>, formats array<string>, kind string, params string")


def object_id(path, data):
    """Deterministic id of an object: a digest of where it lies and what it holds."""
    return F.sha2(F.concat(F.coalesce(path, F.lit("")).cast("binary"), F.lit(b"\x00"), F.coalesce(data, F.lit(b""))), 256)
