"""OBJ, STL and glTF meshes as vertex arrays with bounds and thinned previews."""

from __future__ import annotations

import base64
import json
import re
import struct

import numpy as np

from lodestone.parsers import Parsed, reader

PREVIEW = 4000
STL_ROW = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])
NUMBER = rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def geometry(points: np.ndarray) -> dict:
    """bbox and preview_positions of points (n, 3)."""
    if not len(points):
        return {"preview_positions": []}
    step = max(1, len(points) // PREVIEW)
    thin = points if len(points) <= PREVIEW else points[::step][:PREVIEW]
    return {"bbox": [*map(float, points.min(axis=0)), *map(float, points.max(axis=0))], "preview_positions": [float(v) for v in thin.ravel()]}


def obj_mesh(text: str) -> tuple[np.ndarray, list[list[int]], dict, list[str]]:
    """Vertices, faces as zero-based corners, counts and names, warnings."""
    points, faces, warnings = [], [], []
    found: dict[str, list] = {k: [] for k in ("vn", "vt", "o", "g", "mtllib", "usemtl")}
    triangles = 0
    for line in text.split("\n"):
        tag, *rest = line.split() or [""]
        try:
            if tag == "v" and len(rest) >= 3:
                points.append([float(v) for v in rest[:3]])
            elif tag in ("vn", "vt") and len(rest) >= (3 if tag == "vn" else 1):
                found[tag].append([float(v) for v in rest[:3]])
            elif tag == "f":
                triangles += max(0, len(rest) - 2) or 1
                corners = [int(c) for r in rest if (c := r.split("/")[0])]
                faces.append([c - 1 if c > 0 else len(points) + c for c in corners])
            elif tag in found and rest:
                found[tag].append(rest if tag == "mtllib" else " ".join(rest))
        except ValueError:
            warnings.append(f"bad numeric data in line: {line[:60]!r}")
    counts = {
        "vertices": len(points), "normals": len(found["vn"]), "texcoords": len(found["vt"]), "faces": triangles, "objects": found["o"][:50], "groups": found["g"][:50],
        "mtllib": [m for ms in found["mtllib"] for m in ms][:10], "materials": sorted(set(found["usemtl"]))[:50],
    }
    return np.array(points, dtype=float).reshape(-1, 3), faces, counts, warnings


@reader("obj")
def obj(data: bytes, name: str, fmt: str) -> Parsed:
    points, _, counts, warnings = obj_mesh(data.decode("utf-8", "replace"))
    return Parsed({"kind": "mesh", "format": "obj"} | counts | geometry(points), warnings)


def obj_triangles(text: str) -> np.ndarray:
    """(n, 3, 3): polygons as fans; corners that don't exist lie at the origin."""
    points, faces, _, _ = obj_mesh(text)
    at = lambda c: points[c] if 0 <= c < len(points) else np.zeros(3)
    fans = [(at(f[0]), at(f[k]), at(f[k + 1])) for f in faces for k in range(1, len(f) - 1)]
    return np.array(fans, dtype=float).reshape(-1, 3, 3)


def encode_stl(triangles: np.ndarray) -> bytes:
    rows = np.zeros(len(triangles), STL_ROW)
    rows["corners"] = triangles
    return b"synthetic binary STL".ljust(80, b"\0") + struct.pack("<I", len(rows)) + rows.tobytes()


def stl_triangles(data: bytes) -> np.ndarray:
    if len(data) >= 84 and struct.unpack_from("<I", data, 80)[0] * 50 + 84 == len(data):
        return np.frombuffer(data, STL_ROW, min(200_000, (len(data) - 84) // 50), 84)["corners"].astype(float)
    found = re.findall(rb"vertex\s+(%s)\s+(%s)\s+(%s)" % (NUMBER, NUMBER, NUMBER), data)
    return np.array(found[: len(found) // 3 * 3], dtype=float).reshape(-1, 3, 3)


@reader("stl")
def stl(data: bytes, name: str, fmt: str) -> Parsed:
    triangles = stl_triangles(data)
    binary = not data.lstrip()[:5] == b"solid" or struct.unpack_from("<I", data.ljust(84, b"\0"), 80)[0] * 50 + 84 == len(data)
    content = {"kind": "mesh", "format": "stl", "encoding": "binary" if binary else "ascii", "vertices": len(triangles) * 3, "faces": len(triangles)}
    return Parsed(content | geometry(triangles.reshape(-1, 3)))


def encode_obj(triangles: np.ndarray) -> bytes:
    lines = ["v %.6f %.6f %.6f" % tuple(p) for p in triangles.reshape(-1, 3)]
    lines += [f"f {k} {k + 1} {k + 2}" for k in range(1, 3 * len(triangles), 3)]
    return ("\n".join(lines) + "\n").encode()


def gltf_parts(data: bytes) -> tuple[dict, bytes]:
    """Scene JSON and binary chunk; plain JSON has its buffer inline or not at all."""
    if data[:4] != b"glTF":
        return json.loads(data), b""
    at, scene, binary = 12, {}, b""
    while at + 8 <= len(data):
        n, kind = struct.unpack_from("<I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        scene, binary = (json.loads(body), binary) if kind == b"JSON" else (scene, body if kind[:3] == b"BIN" else binary)
        at += 8 + n
    return scene, binary


@reader("gltf", "glb")
def gltf(data: bytes, name: str, fmt: str) -> Parsed:
    scene, binary = gltf_parts(data)
    points, warnings = [], []
    for mesh in scene.get("meshes", [])[:20]:
        for primitive in mesh.get("primitives", [])[:20]:
            try:
                accessor = scene["accessors"][primitive["attributes"]["POSITION"]]
                view = scene["bufferViews"][accessor["bufferView"]]
                uri = scene["buffers"][view.get("buffer", 0)].get("uri", "")
                raw = base64.b64decode(uri.partition(",")[2]) if uri.startswith("data:") else binary
                if accessor["type"] != "VEC3" or accessor["componentType"] != 5126:
                    continue
                n, step, start = min(accessor["count"], PREVIEW), view.get("byteStride", 12), view.get("byteOffset", 0) + accessor.get("byteOffset", 0)
                points.append(np.ndarray((n, 3), "<f4", raw, start, (step, 4)).astype(float))
            except (KeyError, IndexError, TypeError, ValueError) as error:
                warnings.append(f"primitive skipped: {error}")
    counts = {k: len(scene.get(k, [])) for k in ("scenes", "nodes", "meshes", "materials", "textures", "animations", "accessors")}
    every = np.concatenate(points) if points else np.zeros((0, 3))
    return Parsed({"kind": "mesh", "format": fmt, "asset": scene.get("asset", {}), "vertices": len(every)} | counts | geometry(every), warnings)


# A cube and a pyramid.
CUBE = [(x, y, z) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]
CUBE_FACES = [(1, 2, 4, 3), (5, 7, 8, 6), (1, 5, 6, 2), (3, 4, 8, 7), (1, 3, 7, 5), (2, 6, 8, 4)]
PYRAMID = [(-1, 0, -1), (1, 0, -1), (1, 0, 1), (-1, 0, 1), (0, 1.5, 0)]
PYRAMID_FACES = [(1, 2, 3, 4), (1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 1)]


def create_obj(kind: str = "cube") -> bytes:
    points, faces = (PYRAMID, PYRAMID_FACES) if kind == "pyramid" else (CUBE, CUBE_FACES)
    lines = [f"o {kind}"] + ["v " + " ".join(map(str, p)) for p in points] + ["f " + " ".join(map(str, f)) for f in faces]
    return ("\n".join(lines) + "\n").encode()


def create_glb() -> bytes:
    """One triangle."""
    body = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4").tobytes()
    scene = {
        "asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3", "min": [0, 0, 0], "max": [1, 1, 0]}],
        "bufferViews": [{"buffer": 0, "byteLength": len(body)}], "buffers": [{"byteLength": len(body)}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + body
    return struct.pack("<4sII", b"glTF", 2, 12 + len(chunks)) + chunks
