import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import model, plugins
from lodestone.functions import crypto
from lodestone.operators import creators, exports, transforms
from lodestone.operators.catalog import applicable, refusal, search
from lodestone.parsers import archives, audio, binaries, database, documents, images, meshes, parse, structured, texts, video
from lodestone.sources import container, files


def test_catalog_sizes(spark):
    assert (len(model.FORMATS), len(model.TRANSFORMS)) == (59, 20)
    assert {a for f in model.FORMATS.values() for a in [f.adapter]} >= {"text", "json", "raster", "pdf", "sfp"} and len({f.adapter for f in model.FORMATS.values()}) == 28
    assert search(model.formats(spark), "AUDIO").count() == 5
    assert all(kind in model.CONVERSION_KINDS for edges in model.EXPORTS.values() for _, kind in edges)
    assert refusal("svg", "png") and refusal("7z", "json") and not refusal("json", "yaml")


def test_image_round_trips():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (17, 23, 4), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    px[..., 3] = 255
    for fmt in ("bmp", "ppm"):
        assert (images.DECODERS[fmt](images.ENCODERS[fmt](px)) == px).all()
    frames = creators.bouncing(4)
    got = images.decode_gif(images.encode_gif(frames, 120, 0))
    assert got["loop"] == 0 and [f["delay_ms"] for f in got["frames"]] == [120] * 4
    assert all((f["canvas"] == want).all() for f, want in zip(got["frames"], frames))


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(3)
    px = rng.integers(0, 256, (6, 5, 3)).astype(int)
    rows = b""
    for y in range(6):
        kind = y % 5
        row = bytes([kind])
        for x in range(5):
            for c in range(3):
                a = px[y, x - 1, c] if x else 0
                b = px[y - 1, x, c] if y else 0
                d = px[y - 1, x - 1, c] if x and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row += bytes([(px[y, x, c] - [0, a, b, (a + b) // 2, near][kind]) % 256])
        rows += row
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    png = images.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.decode_png(png)[..., :3] == px).all()
    with pytest.raises(ValueError):
        images.decode_png(png[:-6] + b"\0" * 6)


def test_structured():
    tree = {"app": "x", "n": [1, 2.5, True, None, "true", "a: b"], "w": {"h": 3, "s": ""}, "rows": [{"a": 1, "b": "y"}]}
    assert structured.from_yaml(structured.to_yaml({"a": 1, "b": "true", "c": {"d": [1, "x"]}})) == {"a": 1, "b": "true", "c": {"d": [1, "x"]}}
    assert structured.to_toml(tree) is None and structured.to_toml({"a": 1, "t": {"b": "x", "u": {"c": None}}}) == 'a = 1\n[t]\nb = "x"\n[t.u]\nc = ""\n'
    assert structured.to_csv([{"a": 1, "b": None}, {"a": "x,y", "c": [1]}]) == 'a,b,c\n1,,\n"x,y",,[1]\n' and structured.to_csv({"a": 1}) is None
    assert structured.shape([{"a": 1}, 2]) == [{"a": "int"}, "... 2 items"]
    assert parse(b'{"a":1}\n{"a":2}\n', "x", "json").content["jsonl"] and parse(b"{", "x", "json").support == "INSPECTION ONLY"
    doc = b"\x16\x00\x00\x00\x02hello\x00\x06\x00\x00\x00world\x00\x00"
    assert parse(doc, "x", "bson").content["data"] == {"hello": "world"}


def test_markdown_and_rtf():
    assert texts.markdown_html("# A **b**\n- x\n- y\n\np [l](u)\n```\n<c>\n```") == '<h1>A <strong>b</strong></h1>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<p>p <a href="u">l</a></p>\n<pre><code>\n&lt;c&gt;\n</code></pre>'
    assert texts.rtf_text("{\\rtf1{\\fonttbl{\\f0 X;}}Hi\\par \\'e9\\u8364?}")[0] == "Hi\né€?"


def test_archives():
    for fmt in ("zip", "tar", "tar.gz"):
        data = archives.create([("a/b.txt", b"hi"), ("../evil", b"x"), ("c", b"")], fmt)
        kind = {"tar.gz": "gzip"}.get(fmt, fmt)
        got = parse(data, "x." + fmt, kind)
        assert got.content["entry_count"] == 2 and any("evil" in w for w in got.warnings)
        assert archives.extract(data, kind)[0] == [("a/b.txt", b"hi"), ("c", b"")]
    bomb = parse(archives.create([("z", bytes(20 << 20))], "zip"), "b", "zip")
    assert bomb.support == "INSPECTION ONLY" and "ratio" in bomb.warnings[0]


def test_binaries_and_media():
    got = parse(binaries.create_wasm(), "w", "wasm").content
    assert got["exports"] == [{"name": "add", "kind": "func"}] and [s["name"] for s in got["sections"]] == ["type", "function", "export", "code"]
    assert binaries.leb(binaries.write_leb(624485), 0) == (624485, 3)
    assert meshes.stl_triangles(meshes.encode_stl(meshes.obj_triangles(meshes.create_obj().decode()))).shape == (12, 3, 3)
    assert parse(meshes.create_glb(), "g", "glb").content["bbox"] == [0, 0, 0, 1, 1, 0]
    assert parse(documents.create_pdf(["Hello (PDF)", "two"]), "p", "pdf").content["raw_text"] == "Hello (PDF)\ntwo"
    assert parse(documents.create_docx(["One & two"]), "d", "docx").content["paragraphs"] == ["One & two"]
    assert parse(documents.create_epub("T", "B"), "e", "epub").children[0][2] == "page_of"
    box = lambda t, b: (8 + len(b)).to_bytes(4, "big") + t + b
    mvhd = bytes(12) + (1000).to_bytes(4, "big") + (2500).to_bytes(4, "big")
    movie = parse(box(b"ftyp", b"isom0000") + box(b"moov", box(b"mvhd", mvhd) + box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + b"vide")))), "m", "mp4").content
    assert movie["duration_sec"] == 2.5 and movie["tracks"] == [{"duration": 0.0, "handler": "vide"}]
    el = lambda i, b: i + bytes([0x80 | len(b)]) + b
    mkv = el(b"\x1a\x45\xdf\xa3", el(b"\x42\x82", b"webm")) + el(b"\x18\x53\x80\x67", el(b"\x16\x54\xae\x6b", el(b"\xae", el(b"\x83", b"\1") + el(b"\x86", b"V_VP9"))))
    assert video.matroska(mkv, "", "webm").content["tracks"][0]["codec"] == "V_VP9"
    assert audio.peaks(np.array([0, 100, -32768, 5], "<i2").tobytes(), 1, 2) == [0.003, 1.0]


def test_sqlite(tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "t.db")
    con.executescript("CREATE TABLE a(x, y); INSERT INTO a VALUES (1, 'p'), (2, 'q'); CREATE INDEX i ON a(x);")
    con.commit()
    con.close()
    got = parse((tmp_path / "t.db").read_bytes(), "t", "sqlite").content
    assert (got["table_count"], got["index_count"]) == (1, 1) and next(r for r in got["schema"] if r["type"] == "table")["sample"] == [[1, "p"], [2, "q"]]
    assert database.blob(bytes((i * 37 + 11) & 255 for i in range(512)), "", "blob").content["entropy"] == 8.0


@pytest.mark.parametrize("fmt", sorted(set(model.FORMATS) - {"sfp"}))
def test_readers_are_total(fmt):
    rng = np.random.default_rng(5)
    for data in (b"", b"\0", b"x" * 50, rng.integers(0, 256, 400, dtype=np.uint8).tobytes()):
        assert parse(data, "n", fmt).support in model.SUPPORT_LEVELS


def imported(spark, *wanted):
    return files.import_files(creators.create_files(spark, list(wanted)))


def test_import_transform_export(spark):
    objects = imported(spark, ("image", {"width": 40, "height": 20}), ("json", {"data": [{"b": 1, "a": "x"}]}), ("archive", {"files": [("n.txt", "hi")]}))
    sized = transforms.run(objects, "image.resize", {"width": 10, "height": 6, "smooth": False})
    rows = {r["original_filename"]: r for r in sized.collect()}
    assert rows["created.png"]["refusal"] is None and json.loads(rows["created.png"]["content"])["width"] == 10 and rows["created.json"]["refusal"]
    assert [len(rows[n]["history"]) for n in ("created.png", "created.json")] == [2, 1]
    out = exports.export_objects(sized, "png").collect()
    assert len(out) == 3 and [images.decode_png(bytes(r["data"])).shape for r in out if r["data"]] == [(6, 10, 4)] and sum(r["refusal"] is not None for r in out) == 2
    pulled = transforms.run(objects.filter("detected_format = 'zip'"), "archive.extract_all").first()
    assert [k["name"] for k in pulled["kids"]] == ["n.txt"] and len(pulled["history"]) == 3
    text = exports.export_objects(transforms.run(objects, "json.pretty"), "csv").filter("refusal IS NULL").first()
    assert bytes(text["data"]) == b"b,a\n1,x\n" and text["kind"] == "STRUCTURAL"


def test_pixel_relation_agrees_with_arrays(spark):
    from lodestone.operators import pixels

    px = creators.pattern("gradient", 16, 12)

    def table(df, w, h):
        out = np.zeros((h, w, 4), np.uint8)
        for r in df.collect():
            out[r["y"], r["x"]] = [r[c] for c in "rgba"]
        return out

    made = pixels.create(spark, 1, 16, 12)
    assert (table(made, 16, 12) == px).all()
    assert (table(pixels.rotate(made, 90, 16, 12), 12, 16) == np.rot90(px, -1)).all()
    assert (table(pixels.resize_nearest(made, 16, 12, 9, 25), 9, 25) == transforms.resize(px, 9, 25, False)).all()
    smooth = pixels.resize_bilinear(made, spark.range(1).withColumnRenamed("id", "image"), 16, 12, 11, 7)
    assert np.abs(table(smooth, 11, 7).astype(int) - transforms.resize(px, 11, 7, True)).max() <= 1


def test_applicable(spark):
    rows = spark.createDataFrame([("o", "ANIMATION", "gif"), ("p", "TEXT", "json")], "o string, object_type string, detected_format string")
    got = {(r["o"], r["id"]) for r in applicable(rows).collect()}
    assert ("o", "gif.extract_frame") in got and ("o", "image.resize") not in got and ("p", "json.pretty") in got


def node(depth):
    return container.Node({"object_id": f"n{depth}", "detected_format": "txt", "size": 1}, {"kind": "text", "text": "x" * 500}, [], [], b"y" * 300, {"k": b"z" * 9}, [node(depth + 1)] * 2 if depth < 2 else [])


def test_container_round_trip_and_damage():
    data = container.dumps(node(0))
    back = container.loads(data)
    assert len(list(container.walk(back))) == 7 and back.original == b"y" * 300 and back.blobs == {"k": b"z" * 9} and container.dumps(back) == data
    for damaged in (data[:40] + bytes([data[40] ^ 1]) + data[41:], data + b"x", data[:-1], b"x" + data[1:]):
        with pytest.raises(container.ContainerError):
            container.loads(damaged)
    head, rest = data[:32], data[32:-44]
    import hashlib

    body = head + container.chunk(b"XTRA", b"?") + rest
    assert container.loads(body + container.chunk(b"CKSM", hashlib.sha256(body).digest())).unknown == ["XTRA"]
    assert [c["tag"] for c in container.describe(data)][-1] == "CKSM"


def test_encryption(spark):
    rows = spark.createDataFrame([("a", bytearray(container.dumps(node(1)))), ("b", bytearray(b"junk"))], "object_id string, container binary")
    salt = b"s" * 16
    sealed = crypto.encrypt_containers(rows, "pw", salt, b"n" * 32).cache()
    got = {r["object_id"]: r for r in sealed.collect()}
    assert b"xxxxx" not in bytes(got["a"]["container"]) and got["b"]["error"]
    good = {r["object_id"]: r for r in crypto.decrypt_containers(sealed.filter("error IS NULL"), "pw").collect()}
    assert bytes(good["a"]["container"]) == container.dumps(node(1))
    assert "wrong password" in crypto.decrypt_containers(sealed.filter("error IS NULL"), "no").first()["error"]
    assert "already" in crypto.encrypt_containers(sealed.filter("error IS NULL"), "pw", salt).first()["error"]
    other = crypto.encrypt_containers(rows.filter("object_id = 'a'"), "pw").cache()  # a salt of its own, and the same id again
    both = crypto.decrypt_containers(sealed.filter("error IS NULL").unionByName(other), "pw").collect()
    assert [bytes(r["container"]) for r in both] == [container.dumps(node(1))] * 2
    frame = bytes(got["a"]["container"])
    short = frame[: container.HEADER_SIZE] + b"".join(container.chunk(t, p) for t, p in container.checked(frame)[1] if t != b"OBYT")
    cut = spark.createDataFrame([("a", bytearray(short + container.chunk(b"CKSM", hashlib.sha256(short).digest())))], "object_id string, container binary")
    assert "modified" in crypto.decrypt_containers(cut, "pw").first()["error"]
    with pytest.raises(ValueError):
        crypto.password_key("p", salt, "argon2id")


def test_export_history(spark):
    objects = imported(spark, ("text", {"text": "x"}), ("json", {"data": {"a": 1}}))
    rows = exports.export_objects(objects.unionByName(objects), "html").collect()
    done = [r for r in rows if r["refusal"] is None]
    assert len(rows) == 4 and done
    assert all((r["history"][-1]["action"], r["history"][-1]["kind"], r["history"][-1]["detail"]) == ("export:html", r["kind"], f"exported to {r['filename']} [{r['kind']}]") for r in done)
    refused = exports.export_objects(objects, "png").collect()
    assert all(r["refusal"] and len(r["history"]) == 1 for r in refused)


def test_plugins_are_asked_on_import(spark, monkeypatch):
    monkeypatch.setattr(plugins, "PLUGINS", {})
    tables = plugins.model.FORMATS, plugins.READERS, plugins.model.EXPORTS
    kept = [dict(t) for t in tables]
    try:
        plugins.register(plugins.ppm())
        data = images.encode_ppm(creators.pattern("checker", 16, 16))
        rows = spark.createDataFrame([("a.bin", "1", bytearray(data)), ("b.txt", "2", bytearray(b"plain words")), ("c.png", "3", bytearray(images.encode_png(creators.pattern("checker", 4, 4))))], "name string, path string, data binary")
        got = {r["original_filename"]: (r["detected_format"], r["detection"]["method"], json.loads(r["content"]).get("width")) for r in files.import_files(rows).collect()}
        assert got["a.bin"] == ("ppm", "plugin", 16) and got["b.txt"][0] == "txt" and got["c.png"][0] == "png"
    finally:
        for t, before in zip(tables, kept):
            t.clear()
            t.update(before)


def test_plugin_and_edits(spark):
    from lodestone.operators.edits import set_text
    from lodestone.operators.graph import record

    plugin = plugins.ppm()
    data = images.encode_ppm(creators.pattern("checker", 16, 16))
    assert plugin.detect(data, "x") >= 0.9 and plugin.read(data, "x", "ppm").content["width"] == 16
    rows = spark.createDataFrame([("txt", "old"), ("json", "{}"), ("png", "")], "detected_format string, text string").withColumn("history", record(F.lit(None), "import", F.lit("")))
    got = {r["detected_format"]: r for r in set_text(rows, F.lit("not json")).collect()}
    assert got["txt"]["text"] == "not json" and len(got["txt"]["history"]) == 2 and got["json"]["refusal"] == "invalid JSON" and got["png"]["refusal"]


def test_stream(spark, tmp_path):
    from lodestone.streaming.ingest import stream_objects

    (tmp_path / "a.json").write_text("[1]")
    q = stream_objects(spark, str(tmp_path)).select("original_filename", "detected_format").writeStream.format("memory").queryName("ingested").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("ingested").collect()] == [("a.json", "json")]


def test_whole_table_queries(spark, tmp_path):
    """Rows of every language, of null lang and of null and empty text come through, each with all its stages."""
    import hashlib

    from lodestone.plans import all_queries

    data = [(1, "Salut", "fr"), (2, "Hallo\nÄÖ", "de"), (3, "Hello THERE", "en"), (4, "你好 World", "zh"), (5, "No language", None), (6, None, "fr"), (7, "", None), (8, "Salut", "es")]
    spark.createDataFrame([(*r, "s") for r in data], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    run = lambda name: all_queries()[name](spark, str(tmp_path))
    sealed = run("encrypt_roundtrip_all").select("doc_id", "sealed", "hidden", "checksum").collect()
    assert sorted(tuple(r) for r in sealed) == [(k, True, True, sha(t)) for k, t, _ in data]
    edited = run("doc_set_text_edit_all").select("doc_id", "text", "original_checksum", "steps").collect()
    assert sorted(tuple(r) for r in edited) == [(k, (t or "").lower(), sha(t), 2) for k, t, _ in data]
    names = ["FILE", "FORMAT DETECTION", "FORMAT ADAPTER", "UNIVERSAL OBJECT", "OBJECT GRAPH", "TRANSFORMATION", "EXPORT ADAPTER", "TARGET FILE"]
    stages = run("pipeline_stages_all").collect()
    assert sorted((r["object_id"], r["position"], r["stage"]) for r in stages) == [(str(k), i, n) for k, _, _ in data for i, n in enumerate(names)]
    assert all(r["detail"] for r in stages)
    assert {r["object_id"]: r["detail"] for r in stages if r["position"] == 0} == {str(k): f"doc{k}.bin — {len((t or '').encode())} bytes" for k, t, _ in data}
