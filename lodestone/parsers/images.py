"""PNG, BMP, GIF and PPM codecs over numpy, SVG summaries; formats without a decoder are inspected only."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import Counter

import numpy as np

from lodestone.model import LIMITS
from lodestone.parsers import Parsed, reader

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _size(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > LIMITS.image_pixels:
        raise ValueError(f"image size {width}x{height} is outside the limits")


def png_chunks(data: bytes):
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        tag, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(tag + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"PNG chunk {tag!r} is damaged")
        yield tag, body
        at += 12 + n


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters; left-looking ones run column by column of pixels, the rest on whole rows."""
    height, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((height + 1, width + step), dtype=np.uint8)
    for y in range(height):
        kind, row, above = raw[y, 0], raw[y, 1:], out[y]
        line = out[y + 1]
        if kind == 0:
            line[step:] = row
        elif kind == 1:
            line[step:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line[step:] = row + above[step:]
        elif kind in (3, 4):
            for x in range(step, width + step, step):
                a, b, c = (v.astype(np.int16) for v in (line[x - step : x], above[x : x + step], above[x - step : x]))
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                line[x : x + step] = (row[x - step : x] + guess).astype(np.uint8)
        else:
            raise ValueError(f"unknown PNG filter {kind}")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """RGBA (height, width, 4) of an 8-bit, non-interlaced PNG."""
    parts: dict[bytes, bytes] = {}
    for tag, body in png_chunks(data):
        parts[tag] = parts.get(tag, b"") + body
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    _size(width, height)
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only 8-bit, non-interlaced PNG is decoded")
    n = CHANNELS[colour]
    raw = zlib.decompressobj().decompress(parts[b"IDAT"], height * (width * n + 1))
    px = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width * n + 1), n).reshape(height, width, n)
    out = np.full((height, width, 4), 255, dtype=np.uint8)
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        out[..., :3] = palette[px[..., 0]]
        alpha = np.full(len(palette), 255, np.uint8)
        given = np.frombuffer(parts.get(b"tRNS", b""), np.uint8)
        alpha[: len(given)] = given[: len(alpha)]
        out[..., 3] = alpha[px[..., 0]]
    else:
        out[..., :3] = px[..., :3] if n > 2 else px[..., :1]
        if n in (2, 4):
            out[..., 3] = px[..., -1]
    return out


def encode_png(px: np.ndarray) -> bytes:
    """Grey, RGB or RGBA as the content needs; no row filter."""
    height, width, _ = px.shape
    opaque, grey = bool((px[..., 3] == 255).all()), bool((px[..., :1] == px[..., :3]).all())
    colour, body = (6, px) if not opaque else (0, px[..., :1]) if grey else (2, px[..., :3])
    rows = np.concatenate((np.zeros((height, 1), np.uint8), np.ascontiguousarray(body).reshape(height, -1)), axis=1)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    (start,) = struct.unpack_from("<I", data, 10)
    _, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    _size(width, abs(height))
    if bits not in (24, 32) or packing not in (0, 3):
        raise ValueError(f"BMP with {bits} bits and compression {packing} is not decoded")
    n, stride = bits // 8, (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * n].reshape(abs(height), width, n)
    if height > 0:
        rows = rows[::-1]
    alpha = rows[..., 3:] if n == 4 and rows[..., 3].any() else np.full((*rows.shape[:2], 1), 255, np.uint8)
    return np.concatenate((rows[..., 2::-1], alpha), axis=2)


def flatten_white(px: np.ndarray) -> np.ndarray:
    a = px[..., 3:].astype(np.int32)
    return ((px[..., :3] * a + 255 * (255 - a)) // 255).astype(np.uint8)


def encode_bmp(px: np.ndarray) -> bytes:
    """24 bits, transparency on white, rows from the bottom up."""
    height, width, _ = px.shape
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : width * 3] = flatten_white(px)[::-1, :, ::-1].reshape(height, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def lzw_decode(data: bytes, bits: int, most: int) -> np.ndarray:
    """Palette indices; the table holds (previous entry, last index) and strings are written backwards."""
    clear, stop = 1 << bits, (1 << bits) + 1
    out = bytearray()
    table: list[bytes] = []
    size, have, held, last = bits + 1, 0, 0, None
    for byte in data:
        held |= byte << have
        have += 8
        while have >= size:
            code, held, have = held & ((1 << size) - 1), held >> size, have - size
            if code == clear or not table:
                table, size, last = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
                if code == clear:
                    continue
            if code == stop or len(out) >= most:
                return np.frombuffer(bytes(out[:most]), np.uint8)
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("damaged LZW stream")
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
    return np.frombuffer(bytes(out[:most]), np.uint8)


def lzw_encode(indices: bytes, bits: int) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    out, held, have = bytearray(), 0, 0
    codes, size = {bytes([k]): k for k in range(clear)}, bits + 1

    def put(code: int) -> None:
        nonlocal held, have
        held |= code << have
        have += size
        while have >= 8:
            out.append(held & 255)
            held >>= 8
            have -= 8

    put(clear)
    known, following = b"", stop + 1
    for k in range(len(indices)):
        longer = known + indices[k : k + 1]
        if longer in codes:
            known = longer
            continue
        put(codes[known])
        if following < 4096:
            codes[longer] = following
            if following == 1 << size:
                size += 1
            following += 1
        else:
            put(clear)
            codes, size, following = {bytes([j]): j for j in range(clear)}, bits + 1, stop + 1
        known = indices[k : k + 1]
    if known:
        put(codes[known])
    put(stop)
    if have:
        out.append(held & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = b""
    while at < len(data) and data[at]:
        out, at = out + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
    return out, at + 1


def decode_gif(data: bytes) -> dict:
    """width, height, loop, frames: box, delay in ms (20 at least), disposal, and the canvas after drawing (disposal isn't applied)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _size(width, height)
    at, shared, loop = 13, None, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, delay, disposal, clear_index = [], 20, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, after = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, clear_index = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
                delay = max(20, struct.unpack_from("<H", body, 1)[0] * 10)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loop = struct.unpack_from("<H", body, 12)[0]
            at = after
        elif data[at] == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
            bits = data[at]
            body, at = _blocks(data, at + 1)
            got = lzw_decode(body, bits, w * h)
            index = np.zeros(w * h, np.uint8)
            index[: len(got)] = got
            index = index.reshape(h, w)
            if flags & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
                plain = np.empty_like(index)
                plain[order] = index
                index = plain
            if palette is None:
                raise ValueError("GIF frame without a palette")
            colour = np.dstack((palette[np.minimum(index, len(palette) - 1)], np.full((h, w), 255, np.uint8)))
            shown = np.ones((h, w), bool) if clear_index is None else index != clear_index
            box = canvas[y : y + h, x : x + w]
            box[shown[: box.shape[0], : box.shape[1]]] = colour[: box.shape[0], : box.shape[1]][shown[: box.shape[0], : box.shape[1]]]
            frames.append({"x": x, "y": y, "width": w, "height": h, "delay_ms": delay, "disposal": disposal, "canvas": canvas.copy()})
            delay, disposal, clear_index = 20, 0, None
        else:
            at += 1
    return {"width": width, "height": height, "loop": loop, "frames": frames}


def _palette(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact colours if 254 suffice, else a 6x6x6 cube with 8 greys; index 255 is transparent."""
    rgb = px[..., :3].reshape(-1, 3)
    colours, index = np.unique(rgb, axis=0, return_inverse=True)
    if len(colours) > 254:
        levels = np.arange(6) * 51
        cube = np.array([(r, g, b) for r in levels for g in levels for b in levels])
        colours = np.concatenate((cube, np.repeat(np.linspace(0, 255, 8).astype(int)[:, None], 3, axis=1)))
        q = (rgb.astype(int) + 25) // 51
        index = q[:, 0] * 36 + q[:, 1] * 6 + q[:, 2]
    table = np.zeros((256, 3), np.uint8)
    table[: len(colours)] = colours
    index = index.reshape(-1).astype(np.uint8)
    index[px[..., 3].ravel() < 128] = 255
    return table, index


def encode_gif(frames: list[np.ndarray], delay_ms: int = 100, loop: int | None = None) -> bytes:
    height, width, _ = frames[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x70, 0, 0)]
    if loop is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for px in frames:
        table, index = _palette(px)
        body = lzw_encode(index.tobytes(), 8)
        clear = bool((index == 255).any())
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 4 | clear, delay_ms // 10, 255 if clear else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x87) + table.tobytes() + b"\x08")
        out += [bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)] + [b"\0"]
    return b"".join(out) + b";"


def decode_ppm(data: bytes) -> np.ndarray:
    """P3 and P6 with comments, any maximum up to 65535 (scaled to 255)."""
    tokens, at = [], 2
    if data[:2] not in (b"P3", b"P6"):
        raise ValueError("not a PPM")
    while len(tokens) < 3:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
        if not m:
            raise ValueError("damaged PPM header")
        tokens.append(int(m[1]))
        at = m.end()
    width, height, top = tokens
    _size(width, height)
    n = width * height * 3
    if data[:2] == b"P6":
        wide = top > 255
        values = np.frombuffer(data, ">u2" if wide else "u1", n, at + 1)
    else:
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    rgb = (values.astype(np.int64) * 255 // top).astype(np.uint8).reshape(height, width, 3)
    return np.concatenate((rgb, np.full((height, width, 1), 255, np.uint8)), axis=2)


def encode_ppm(px: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + np.ascontiguousarray(px[..., :3]).tobytes()


def encode_svg(px: np.ndarray) -> bytes:
    height, width, _ = px.shape
    picture = base64.b64encode(encode_png(px)).decode()
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><image width="{width}" height="{height}" href="data:image/png;base64,{picture}"/></svg>'.encode()


DECODERS = {"png": decode_png, "bmp": decode_bmp, "ppm": decode_ppm}
ENCODERS = {"png": encode_png, "bmp": encode_bmp, "gif": lambda px: encode_gif([px]), "ppm": encode_ppm, "svg": encode_svg}


def pixels_of(data: bytes, fmt: str) -> np.ndarray:
    return decode_gif(data)["frames"][0]["canvas"] if fmt == "gif" else DECODERS[fmt](data)


@reader("png", "bmp", "ppm")
def raster(data: bytes, name: str, fmt: str) -> Parsed:
    px = DECODERS[fmt](data)
    content = {"kind": "image", "width": px.shape[1], "height": px.shape[0], "mode": "RGBA", "pixels": {"__blob__": "pixels"}}
    return Parsed(content, blobs={"pixels": px.tobytes()})


@reader("gif")
def animation(data: bytes, name: str, fmt: str) -> Parsed:
    got = decode_gif(data)
    frames = [{k: v for k, v in f.items() if k != "canvas"} | {"pixels": {"__blob__": f"frame{i}"}} for i, f in enumerate(got["frames"])]
    content = {"kind": "animation", "width": got["width"], "height": got["height"], "loop": got["loop"], "frame_count": len(frames), "frames": frames}
    return Parsed(content, blobs={f"frame{i}": f["canvas"].tobytes() for i, f in enumerate(got["frames"])})


@reader("jpeg", "webp", "tiff")
def undecoded(data: bytes, name: str, fmt: str) -> Parsed:
    return Parsed({"kind": "image", "format": fmt}, [f"no decoder for {fmt} here; original bytes preserved"], support="INSPECTION ONLY")


@reader("svg")
def svg(data: bytes, name: str, fmt: str) -> Parsed:
    text = data.decode("utf-8", "replace")
    attribute = lambda p: (m := re.search(p + '="([^"]+)"', text)) and m[1]
    counts = dict(sorted(Counter(re.findall(r"<(\w+)", text)).items()))
    return Parsed({"kind": "vector", "text": text, "raw": text, "element_counts": counts, "viewBox": attribute("viewBox"), "width": attribute(r"\bwidth"), "height": attribute(r"\bheight")})
