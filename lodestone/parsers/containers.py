"""Containers as files: the object inside with its children, a manifest and a tree."""

from __future__ import annotations

from lodestone.parsers import Parsed, reader


@reader("sfp")
def sfp(data: bytes, name: str, fmt: str) -> Parsed:
    """The root object's content; children come as files where their bytes were preserved. The file name given overrides the saved one."""
    from lodestone.sources.container import describe, is_sealed, loads, walk

    if is_sealed(data):
        return Parsed({"kind": "project", "encrypted": True, "chunks": describe(data)}, ["encrypted container: decrypt it to read the objects"], support="INSPECTION ONLY")
    root = loads(data)
    tree = ["  " * depth + f"{n.meta.get('original_filename') or '(unnamed)'} [{n.meta.get('detected_format')}]" for n, depth, _ in walk(root)]
    manifest = [n.summary() | {"depth": depth, "parent_id": parent} for n, depth, parent in walk(root)]
    kids = [(c.meta.get("original_filename") or "child", c.original, "contains") for c in root.children if c.original is not None]
    content = root.content | {"kind": root.content.get("kind", "project"), "manifest": manifest, "tree": "\n".join(tree), "chunks": describe(data), "unknown_chunks": root.unknown}
    return Parsed(content, blobs=dict(root.blobs), children=kids)
