"""Container trees of ISO media (MP4, MOV), Matroska (MKV, WebM) and AVI, with their tracks."""

from __future__ import annotations

import struct

from lodestone.parsers import Parsed, reader

# ISO boxes that hold boxes; Matroska ids by name, and those that hold elements.
BOXES = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf", b"dinf", b"meta"}
EBML = {
    0x1A45DFA3: "EBML", 0x4282: "DocType", 0x18538067: "Segment", 0x1549A966: "Info", 0x2AD7B1: "TimecodeScale", 0x4489: "Duration", 0x4D80: "MuxingApp",
    0x5741: "WritingApp", 0x7BA9: "Title", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0xD7: "TrackNumber", 0x83: "TrackType", 0x86: "CodecID", 0xE0: "Video",
    0xB0: "PixelWidth", 0xBA: "PixelHeight", 0xE1: "Audio", 0xB5: "SamplingFrequency", 0x9F: "Channels", 0x1254C367: "Tags", 0x1F43B675: "Cluster", 0x1C53BB6B: "Cues",
}
EBML_PARENTS = {"EBML", "Segment", "Info", "Tracks", "TrackEntry", "Video", "Audio", "Tags"}
EBML_TEXT = {"DocType", "MuxingApp", "WritingApp", "Title", "CodecID"}
TRACK_TYPES = {1: "video", 2: "audio", 17: "subtitle"}


def boxes(data: bytes, most: int = 4000, depth: int = 8) -> list[dict]:
    """Flat tree of boxes: type, offset, size, depth, parent (index or -1), body offset."""
    out: list[dict] = []
    waiting = [(0, len(data), 0, -1)]
    while waiting and len(out) < most:
        at, end, level, parent = waiting.pop()
        while at + 8 <= end and len(out) < most:
            size, head = struct.unpack_from(">I", data, at)[0], 8
            kind = data[at + 4 : at + 8]
            if size == 1 and at + 16 <= end:
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            size = size or end - at
            if size < head or at + size > end:
                break
            out.append({"type": kind.decode("latin-1"), "offset": at, "size": size, "depth": level, "parent": parent, "body": at + head})
            if kind in BOXES and level + 1 < depth:
                waiting.append((at + head + 4 * (kind == b"meta"), at + size, level + 1, len(out) - 1))
            at += size
    return out


@reader("mp4", "mov")
def iso_media(data: bytes, name: str, fmt: str) -> Parsed:
    tree = boxes(data)

    def within(k: int, root: int) -> bool:
        while k >= 0 and k != root:
            k = tree[k]["parent"]
        return k == root

    def below(root: int, kind: str) -> int | None:
        return next((b["body"] for k, b in enumerate(tree) if b["type"] == kind and within(k, root)), None)

    def duration(at: int | None) -> float:
        if at is None:
            return 0.0
        scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
        return round(length / scale, 3) if scale else 0.0

    tracks = []
    for k, box in enumerate(tree):
        if box["type"] != "trak":
            continue
        track = {"duration": duration(below(k, "mdhd"))}
        if (at := below(k, "hdlr")) is not None:
            track["handler"] = data[at + 8 : at + 12].decode("latin-1")
        if (at := below(k, "stsd")) is not None:
            track["codec"] = data[at + 12 : at + 16].decode("latin-1")
        if (at := below(k, "stsz")) is not None:
            track["samples"] = struct.unpack_from(">I", data, at + 8)[0]
        if (at := below(k, "tkhd")) is not None:
            place = at + (88 if data[at] == 1 else 76)
            track["width"], track["height"] = (v >> 16 for v in struct.unpack_from(">II", data, place))
        tracks.append(track)
    root = next((b["body"] for b in tree if b["type"] == "mvhd"), None)
    shown = [{k: b[k] for k in ("type", "offset", "size", "depth", "parent")} for b in tree]
    return Parsed({"kind": "video", "container": "iso-bmff", "boxes": shown, "tracks": tracks, "duration_sec": duration(root)})


def vint(data: bytes, at: int, keep_mark: bool) -> tuple[int, int]:
    """A Matroska variable-length integer and its size; (-1, 0) at the end or if damaged."""
    if at >= len(data) or not data[at]:
        return -1, 0
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep_mark else value & (1 << 7 * n) - 1), n


def elements(data: bytes, most: int = 20_000, depth: int = 6) -> list[dict]:
    """Flat tree of elements: name, offset, size, depth, parent, value."""
    out: list[dict] = []
    waiting = [(0, len(data), 0, -1)]
    while waiting:
        at, end, level, parent = waiting.pop()
        while at < end and len(out) < most:
            ident, n = vint(data, at, True)
            size, m = vint(data, at + n, False)
            if n == 0 or m == 0:
                break
            body = at + n + m
            size = min(end - body, len(data) - body) if size == (1 << 7 * m) - 1 else size
            if size < 0 or body + size > len(data):
                break
            name = EBML.get(ident, f"0x{ident:X}")
            row = {"name": name, "offset": at, "size": size, "depth": level, "parent": parent, "value": None}
            raw = data[body : body + size]
            if name in EBML_TEXT:
                row["value"] = raw.decode("utf-8", "replace").strip("\0")
            elif name in ("Duration", "SamplingFrequency") and size in (4, 8):
                row["value"] = struct.unpack(">f" if size == 4 else ">d", raw)[0]
            elif name in EBML.values() and name not in EBML_PARENTS and size <= 8:
                row["value"] = int.from_bytes(raw, "big")
            out.append(row)
            if name in EBML_PARENTS and level + 1 < depth:
                waiting.append((body, body + size, level + 1, len(out) - 1))
            at = body + size
    return out


@reader("mkv", "webm")
def matroska(data: bytes, name: str, fmt: str) -> Parsed:
    tree = elements(data)
    value = lambda n, default=None: next((e["value"] for e in tree if e["name"] == n), default)
    tracks = []
    for k, e in enumerate(tree):
        if e["name"] == "TrackEntry":
            inner = {k, *(j for j, x in enumerate(tree) if x["parent"] == k)}
            got = {x["name"]: x["value"] for x in tree if x["parent"] in inner and x["value"] is not None}
            tracks.append({"number": got.get("TrackNumber"), "type": TRACK_TYPES.get(got.get("TrackType"), "other"), "codec": got.get("CodecID"), "width": got.get("PixelWidth"), "height": got.get("PixelHeight"), "channels": got.get("Channels")})
    seconds = (value("Duration", 0.0) or 0.0) * (value("TimecodeScale", 1_000_000) or 1_000_000) / 1e9
    return Parsed({"kind": "video", "container": "matroska", "doctype": value("DocType"), "title": value("Title"), "elements": tree, "tracks": tracks, "duration_sec": round(seconds, 3)})


@reader("avi")
def avi(data: bytes, name: str, fmt: str) -> Parsed:
    """Chunks, and the main header's figures. Stream tables aren't listed as tracks: the count alone is reported, with a warning."""
    tree: list[dict] = []
    waiting = [(12, len(data), 0)]
    head, streams = {}, 0
    while waiting:
        at, end, level = waiting.pop()
        while at + 8 <= end and len(tree) < 4000:
            tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            row = {"tag": tag.decode("latin-1"), "offset": at, "size": size, "depth": level}
            if tag in (b"LIST", b"RIFF") and level < 6:
                row["form"] = data[at + 8 : at + 12].decode("latin-1")
                waiting.append((at + 12, min(end, at + 8 + size), level + 1))
            elif tag == b"avih" and at + 48 <= len(data):
                v = struct.unpack_from("<10I", data, at + 8)
                head = {"microseconds_per_frame": v[0], "total_frames": v[4], "streams": v[6], "width": v[8], "height": v[9]}
            streams += tag == b"strh"
            tree.append(row)
            at += 8 + size + (size & 1)
    seconds = head.get("microseconds_per_frame", 0) * head.get("total_frames", 0) / 1e6
    warnings = ["stream list could not be read"] if streams else []
    return Parsed({"kind": "video", "container": "riff", "chunks": tree, "tracks": [], "duration_sec": round(seconds, 3)} | head, warnings)
