"""What the Python stages hold and how many of them a task needs don't grow with the input."""

import hashlib
import re

import pyarrow as pa
import pytest

from lodestone.parsers import PIECE_BYTES
from lodestone.plans import all_queries
from lodestone.sources import files


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("memory"))
    texts = ["# T\n\n* a **b**", "plain", "", None, "é" * 300, '{"a": 1}', "x,y\n1,2\n"] * 3
    spark.createDataFrame([(k, t, None, "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, f'{{"k": {k}}}') for k in range(30)], "event_id long, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def python_stages(df) -> int:
    return sum(bool(re.match(r"\W*(\(\d+\)\W*)?(MapInArrow|ArrowEvalPython|BatchEvalPython)", line)) for line in plan(df))


@pytest.mark.parametrize("name,most", [("encrypt_roundtrip", 5), ("encrypt_roundtrip_all", 5), ("sfp_roundtrip", 3), ("sfp_chunks", 3), ("zip_extract", 3), ("doc_md_html", 3), ("event_json_pretty", 3), ("event_json_to_toml", 3), ("event_json_minify", 3)])
def test_few_python_stages_and_no_join(spark, sf_dir, name, most):
    df = all_queries()[name](spark, sf_dir)
    assert python_stages(df) <= most
    assert not any("Join" in line for line in plan(df))


@pytest.mark.parametrize("name", ["event_json_pretty", "event_json_to_toml", "event_json_minify"])
def test_only_what_is_read_is_computed(spark, sf_dir, name):
    """No checksum, history or catalog entry goes through Python (or is made) where only the content is asked for."""
    text = "\n".join(plan(all_queries()[name](spark, sf_dir)))
    assert "MapInArrow" not in text and "sha2(" not in text and "detected " not in text


def test_stages_work_in_pieces():
    """A batch as large as Spark makes them is cut; nothing is lost on the way, and one large file is one piece."""
    from lodestone.parsers import array_pieces

    data = [bytes([k % 251]) * (PIECE_BYTES // 100) for k in range(1000)] + [bytes(3 * PIECE_BYTES)]
    got = list(array_pieces([(pa.array(data), pa.array(range(1001)))]))
    assert max(sum(map(len, a.to_pylist())) for a, _ in got[:-1]) <= 2 * PIECE_BYTES and len(got) >= 10
    assert [x for a, _ in got for x in a.to_pylist()] == data and [x for _, k in got for x in k.to_pylist()] == list(range(1001))


def test_columns_come_along(spark):
    """Columns that are kept stay with their rows through containers of one object or none."""
    from lodestone.functions import crypto

    rows = spark.createDataFrame([(f"{k}.txt", str(k), bytearray(b"text %d" % k)) for k in range(20)], "name string, path string, data binary")
    read, unread = files.to_containers(files.import_files(rows), ["original_filename"]), files.to_containers(files.identify(rows), ["original_filename"])
    assert sorted((r["original_filename"], bytes(r["container"])) for r in read.collect()) == sorted((r["original_filename"], bytes(r["container"])) for r in unread.collect())
    sealed = crypto.encrypt_containers(unread.select("object_id", "container"), "p", b"s" * 16, b"n" * 32)
    kept = sealed.selectExpr("object_id", "IF(object_id < '8', container, x'00') AS container", "object_id AS label")
    back = files.from_containers(crypto.decrypt_containers(kept, "p", keep=["label"]), keep=["label"]).collect()
    assert len(back) == 20 and all(r["container_id"] == r["label"] and (r["error"] is None) == (r["label"] < "8") for r in back)
    assert {hashlib.sha256(r["original_bytes"]).hexdigest() for r in back if r["error"] is None} <= {hashlib.sha256(b"text %d" % k).hexdigest() for k in range(20)}
