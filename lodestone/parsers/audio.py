"""WAV samples; headers and tags of MP3, FLAC, OGG and AAC."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np

from lodestone.parsers import Parsed, reader

# kbit/s of MPEG-1 and MPEG-2 layer III by index, sample rates by version bits and index.
BITRATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
MP3_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


def peaks(pcm: bytes, channels: int, buckets: int = 240) -> list[float]:
    """Greatest amplitude of each bucket of 16-bit samples, over all channels."""
    n = len(pcm) // (2 * channels)
    if not n:
        return []
    step = max(1, n // buckets)
    loud = np.abs(np.frombuffer(pcm, "<i2", n * channels).astype(np.int32)).reshape(n, channels).max(axis=1)
    return [round(int(v) / 32768, 3) for v in np.maximum.reduceat(loud, np.arange(0, n, step))[:buckets]]


@reader("wav")
def wav(data: bytes, name: str, fmt: str) -> Parsed:
    with wave.open(io.BytesIO(data)) as w:
        channels, width, rate, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        pcm = w.readframes(min(frames, rate * 60))
    content = {"kind": "audio", "channels": channels, "sample_width": width, "sample_rate": rate, "frames": frames, "duration": round(frames / rate, 4) if rate else 0}
    return Parsed(content | {"peaks": peaks(pcm, channels) if width == 2 else []}, blobs={"pcm": pcm})


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3(data: bytes) -> tuple[dict, int]:
    """Text frames (60 at most) of an ID3v2 tag, and where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end, at, tags = 10 + _syncsafe(data[6:10]), 10, {}
    old = data[3] < 3
    while at + (6 if old else 10) <= min(end, len(data)) and data[at] and len(tags) < 60:
        if old:
            tag, n, head = data[at : at + 3], int.from_bytes(data[at + 3 : at + 6], "big"), 6
        else:
            raw = data[at + 4 : at + 8]
            tag, n, head = data[at : at + 4], _syncsafe(raw) if data[3] == 4 else int.from_bytes(raw, "big"), 10
        body = data[at + head : at + head + n]
        if tag[:1] == b"T" and body:
            encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[tag.decode("latin-1")] = body[1:].decode(encoding, "replace").strip("\0")
        at += head + n
    return tags, end


@reader("mp3")
def mp3(data: bytes, name: str, fmt: str) -> Parsed:
    tags, at = id3(data)
    count, seconds, first = 0, 0.0, None
    while at + 4 <= len(data):
        a, b, c = data[at], data[at + 1], data[at + 2]
        version, index, rate_index = b >> 3 & 3, c >> 4, c >> 2 & 3
        if a != 255 or b & 0xE0 != 0xE0 or version == 1 or index in (0, 15) or rate_index == 3:
            if count:
                break
            at += 1
            continue
        rate, kbit = MP3_RATES[version][rate_index], BITRATES[1 if version == 3 else 2][index]
        samples = 1152 if version == 3 else 576
        first = first or {"bitrate_kbps": kbit, "sample_rate": rate, "mpeg_version": {3: "1", 2: "2", 0: "2.5"}[version]}
        count, seconds, at = count + 1, seconds + samples / rate, at + samples // 8 * kbit * 1000 // rate + (c >> 1 & 1)
    warnings = [] if count else ["no MPEG audio frame found"]
    return Parsed({"kind": "audio", "codec": "mp3", "tags": tags, "frame_count": count, "duration": round(seconds, 3)} | (first or {}), warnings)


def vorbis_comments(body: bytes) -> dict:
    (n,) = struct.unpack_from("<I", body)
    at, out = 4 + n, {"vendor": body[4 : 4 + n].decode("utf-8", "replace")}
    (count,) = struct.unpack_from("<I", body, at)
    at += 4
    for _ in range(min(count, 100)):
        (n,) = struct.unpack_from("<I", body, at)
        key, _, value = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        out[key.lower()], at = value, at + 4 + n
    return out


@reader("flac")
def flac(data: bytes, name: str, fmt: str) -> Parsed:
    at, content = 4, {"kind": "audio", "codec": "flac", "tags": {}}
    while at + 4 <= len(data):
        kind, n = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind & 127 == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            rate, total = bits >> 44, bits & (1 << 36) - 1
            content |= {"sample_rate": rate, "channels": (bits >> 41 & 7) + 1, "bits_per_sample": (bits >> 36 & 31) + 1, "total_samples": total, "duration": round(total / rate, 3) if rate else 0}
        elif kind & 127 == 4:
            content["tags"] = vorbis_comments(body)
        at += 4 + n
        if kind & 128:
            break
    return Parsed(content)


@reader("ogg")
def ogg(data: bytes, name: str, fmt: str) -> Parsed:
    at, pages, granule, packets = 0, 0, 0, []
    while at + 27 <= len(data) and data[at : at + 4] == b"OggS":
        lacing = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + len(lacing)
        if pages < 3:
            packets.append(data[body : body + sum(lacing)])
        granule, pages, at = max(granule, struct.unpack_from("<q", data, at + 6)[0]), pages + 1, body + sum(lacing)
    content = {"kind": "audio", "pages": pages, "tags": {}}
    head = packets[0] if packets else b""
    if head[:7] == b"\x01vorbis":
        channels, rate = head[11], struct.unpack_from("<I", head, 12)[0]
        content |= {"codec": "vorbis", "channels": channels, "sample_rate": rate, "duration": round(granule / rate, 3) if rate else 0}
    elif head[:8] == b"OpusHead":
        content |= {"codec": "opus", "channels": head[9], "sample_rate": 48000, "duration": round(granule / 48000, 3)}
    for p in packets[1:]:
        for mark in (b"\x03vorbis", b"OpusTags"):
            if p.startswith(mark):
                content["tags"] = vorbis_comments(p[len(mark) :])
    return Parsed(content, [] if pages else ["no OGG page found"])


@reader("aac")
def aac(data: bytes, name: str, fmt: str) -> Parsed:
    at, count, rate, channels = 0, 0, 0, 0
    while at + 7 <= len(data) and data[at] == 255 and data[at + 1] & 0xF6 == 0xF0:
        n = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        index = data[at + 2] >> 2 & 15
        if n < 7 or index >= len(AAC_RATES):
            break
        rate, channels = AAC_RATES[index], (data[at + 2] & 1) << 2 | data[at + 3] >> 6
        count, at = count + 1, at + n
    return Parsed({"kind": "audio", "codec": "aac", "frame_count": count, "sample_rate": rate, "channels": channels, "duration": round(count * 1024 / rate, 3) if rate else 0})
