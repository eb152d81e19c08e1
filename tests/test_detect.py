import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.functions.detect import detect, kind_of_zip


def packed(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


CASES = [
    ("a.bin", b"", "empty"), ("x.txt", b"\x89PNG\r\n\x1a\nrest", "png"), ("x.png", b"\xff\xd8\xff\xe0", "jpeg"), ("x", b"GIF89a....", "gif"),
    ("x", packed("word/document.xml"), "docx"), ("x", packed("META-INF/MANIFEST.MF"), "jar"), ("x", packed("a.txt"), "zip"),
    ("x.mkv", b"\x1aE\xdf\xa3..webm", "webm"), ("r", b"RIFF1234WAVEfmt", "wav"), ("r", b"RIFF1234XXXX", "riff"), ("r", b"RIFF12", "blob"),
    ("m", b"\0\0\0\x20ftypisom0000", "mp4"), ("m", b"\0\0\0\x20ftypqt  0000", "mov"), ("t", bytes(257) + b"ustar" + bytes(300), "tar"),
    ("j.txt", b'{"a": [1,2]}', "json"), ("c.x", b"a,b\n1,2\n", "csv"), ("t", b"# Title\nhello", "md"), ("y", b"key: value\nb: 2\n", "yaml"),
    ("s.py", b"import os\n", "python"), ("u.zz", b"hello there", "txt"), ("f.xyz", bytes(range(128, 256)), "blob"), ("f.mkv", bytes(range(128, 250)), "mkv"),
    ("e.dll", b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0" + bytes(20), "pe"), ("q", b"solid cube\n facet normal", "stl"), ("h", b"<!DOCTYPE html><p>", "html"),
    ("a", b"\xff\xf1\x50\x80\x01\x02", "aac"), ("m", b"\xff\xfb\x90\x00\x01\x02", "mp3"), ("b", b"\x05\0\0\0\0", "bson"), ("v", b"v 1 2 3\nf 1 2 3\n", "obj"),
    ("r", b"{\\rtf1 x}", "rtf"), ("x", b"<?xml version='1.0'?><a/>", "xml"), ("x", b'<svg xmlns="a"></svg>', "svg"), ("BM", b"BM is text here", "bmp"),
]


def test_detection(spark):
    df = spark.createDataFrame([(n, bytearray(d), w) for n, d, w in CASES], "name string, data binary, want string")
    got = df.select("name", "want", detect(F.col("data"), F.col("name")).alias("d")).select("name", "want", "d.format_id").collect()
    assert [(r["name"], r["format_id"]) for r in got] == [(n, w) for n, _, w in CASES]


def test_null_bytes_count_as_empty(spark):
    df = spark.createDataFrame([(None, None)], "name string, data binary")
    assert df.select(detect(F.col("data"), F.col("name"))["format_id"]).first()[0] == "empty"


def test_extension_never_beats_content(spark):
    df = spark.createDataFrame([("photo.jpg", bytearray(b"%PDF-1.4"))], "name string, data binary")
    row = df.select(detect(F.col("data"), F.col("name")).alias("d")).first()["d"]
    assert (row["format_id"], row["confidence"], row["method"]) == ("pdf", 0.99, "magic")


@pytest.mark.parametrize("given, want", [("C:\\a\\..\\b", ""), ("/x//./y", "x/y"), ("C:a/b", "a/b"), ("../e", ""), ("a\\b", "a/b"), ("..a/b", "..a/b")])
def test_paths(spark, given, want):
    from lodestone.parsers.archives import safe_path

    assert spark.createDataFrame([(given,)], "p string").select(S.sanitize_path(F.col("p"))).first()[0] == want == safe_path(given)


def test_hex_preview_agrees_with_the_reader(spark):
    from lodestone.parsers.database import hex_lines

    for data in (b"hello world, 16+ bytes\x00\x01", bytes(range(256)) * 2, b"x"):
        assert spark.createDataFrame([(bytearray(data),)], "d binary").select(S.hex_preview(F.col("d"))).first()[0] == hex_lines(data)


def test_kind_of_zip():
    assert kind_of_zip(packed("xl/workbook.xml")) == "xlsx" and kind_of_zip(b"PK\x05\x06") == "zip"


def test_budget(spark):
    df = spark.createDataFrame([(10, 10, 1), (5 << 20, 1000, 1), (1, 1, 20_000), (300 << 20, 300 << 20, 1)], "t long, c long, n long")
    got = [r[0] for r in df.select(S.budget_refusal(F.col("t"), F.col("c"), F.col("n"))).collect()]
    assert got[0] is None and "ratio" in got[1] and "entries" in got[2] and "expands" in got[3]
