"""Authenticated encryption of containers with Spark's own AES-GCM.

A container's chunks become an array; each payload is encrypted by ``aes_encrypt`` in the
JVM under its own nonce (base XOR index + 1), bound to its tag and place by the
associated data, and the chunks are put together again, all within the row. Keys come
from a password by PBKDF2. Argon2 and device keys need what is not here and are refused.
"""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.arrow import once
from lodestone.sources.container import HEADER_SIZE, MAGIC, ContainerError, checked

# Fixed values.
ITERATIONS, SALT, NONCE, AAD = 600_000, 16, 12, b"SFP-ENCR-v1|"
PAYLOADS = ("META", "CONT", "HIST", "RTBL", "OTBL", "OFMT", "OBYT", "BLOB", "KIDS")
FRAME = T.StructType(
    [
        T.StructField("header", T.BinaryType()), T.StructField("encr", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("parts", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("nth", T.IntegerType()), T.StructField("nonce", T.BinaryType())]))),
        T.StructField("key", T.BinaryType()),
    ]
)


def password_key(password: str, salt: bytes, kdf: str = "pbkdf2-sha256", iterations: int = ITERATIONS) -> bytes:
    if kdf != "pbkdf2-sha256":
        raise ValueError(f"key derivation {kdf!r} is not available here")
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def device_key() -> bytes:
    raise ValueError("device keys are only available on Windows")


def framed(data: bytes | None, given: bytes | None) -> dict:
    """Header, ENCR note, chunks in order (payload chunks numbered, with their nonces), and what is wrong.

    Nonces come from ``given``, or from the note where that is null.
    """
    try:
        data = data or b""
        _, parts = checked(data)
        encr = next((p.decode() for t, p in parts if t == b"ENCR"), None)
        start = given if given is not None else base64.b64decode(json.loads(encr).get("nonce") or "") if encr else bytes(NONCE)
        if len(start) != NONCE:
            raise ContainerError("the nonce is malformed, the file is damaged")
        n, out = 0, []
        for tag, payload in parts:
            name = tag.decode("latin-1")
            if name == "ENCR":
                continue
            numbered = name in PAYLOADS and bool(payload)
            nonce = (int.from_bytes(start, "big") ^ (n + 1)).to_bytes(NONCE, "big") if numbered else None
            out.append({"tag": name, "payload": payload, "nth": n if numbered else None, "nonce": nonce})
            n += numbered
        return {"header": data[:HEADER_SIZE], "encr": encr, "error": None, "parts": out}
    except (ContainerError, ValueError) as error:
        return {"header": None, "encr": None, "error": str(error), "parts": []}


def split_frame(password: str | None = None):
    """container, base nonce -> ``framed``; with a password also the key of the note's salt, derived once a task."""
    made = to_arrow_type(FRAME)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from lodestone.parsers import array_pieces

        keys: dict[str, bytes] = {}

        def key(encr: str | None) -> bytes | None:
            note = json.loads(encr) if encr and password is not None else None
            if not isinstance(note, dict) or note.get("mode") != "password" or (note.get("kdf") or "pbkdf2-sha256") != "pbkdf2-sha256" or note.get("salt") is None:
                return None
            salt = str(note["salt"])
            if salt not in keys:
                keys[salt] = password_key(password, base64.b64decode(salt))
            return keys[salt]

        for data, base in array_pieces(batches):
            got = [framed(*row) for row in zip(data.to_pylist(), base.to_pylist())]
            yield pa.array([g | {"key": key(g["encr"])} for g in got], made)

    return once(run, FRAME)


def _latin_chunk(tag, payload):
    """A chunk as text, one character a byte."""
    size = F.unhex(F.lpad(F.hex(F.length(payload)), 16, "0"))
    return F.decode(F.concat(F.encode(tag, "ISO-8859-1"), size, payload), "ISO-8859-1")


def _aad(p):
    return F.concat(F.lit(AAD), F.encode(p["tag"], "ISO-8859-1"), F.unhex(F.lpad(F.hex(p["nth"]), 8, "0")))


def _whole(rows: DataFrame, keep: list[str]) -> DataFrame:
    """object_id, container of header and note (null: none), parts and bodies, where there is no error; error, and the columns ``keep``."""
    header = F.when(F.col("error").isNull(), F.col("f.header"))  # no header, no container
    noted = F.coalesce(_latin_chunk(F.lit("ENCR"), F.encode("note", "UTF-8")), F.lit(""))
    chunks = F.array_join(F.zip_with("f.parts", "bodies", lambda p, body: _latin_chunk(p["tag"], body)), "")
    out = rows.select("object_id", F.concat(header, F.encode(F.concat(noted, chunks), "ISO-8859-1")).alias("out"), "error", *keep)
    seal = F.concat(F.lit(b"CKSM"), F.unhex(F.lit("0000000000000020")), F.unhex(F.sha2("out", 256)))
    return out.select("object_id", F.concat("out", seal).alias("container"), "error", *keep)


def encrypt_containers(rows: DataFrame, password: str, salt: bytes | None = None, nonce: bytes | None = None) -> DataFrame:
    """object_id, container (encrypted), error of rows (object_id, container); encrypted ones are refused. Rows are independent.

    One salt (hence one key derivation) a call; the base nonce of each container is derived from the given
    random one and its content, so no nonce comes twice under the key. Pass salt and nonce only to repeat a result.
    """
    salt, nonce = salt or secrets.token_bytes(SALT), nonce or secrets.token_bytes(32)
    key = password_key(password, salt)
    base = F.substring(F.unhex(F.sha2(F.concat(F.lit(nonce), F.unhex(F.sha2("container", 256))), 256)), 1, NONCE)
    framed = rows.select("object_id", split_frame()("container", base).alias("f"), base.alias("base"))

    def seal(p):
        sealed = F.aes_encrypt(p["payload"], F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), p["nonce"], _aad(p))
        return F.when(p["nth"].isNotNull(), F.substring(sealed, NONCE + 1, 2**31 - 1)).otherwise(p["payload"])  # the nonce is in the note, not in front

    error = F.when(F.col("f.encr").isNotNull(), "this container is already encrypted").otherwise(F.col("f.error"))
    tags = F.transform(F.filter("f.parts", lambda p: p["nth"].isNotNull()), lambda p: p["tag"])
    fixed = {"v": 1, "salt": base64.b64encode(salt).decode(), "mode": "password", "kdf": "pbkdf2-sha256", "kdf_params": {"iterations": ITERATIONS, "hash": "sha256"}}
    note = F.concat(F.lit(json.dumps(fixed)[:-1] + ', "nonce": "'), F.base64("base"), F.lit('", "chunks": '), F.to_json(tags), F.lit("}"))
    done = framed.select("object_id", "f", error.alias("error"), F.transform("f.parts", seal).alias("bodies"), note.alias("note"))
    return _whole(done, [])


def decrypt_containers(rows: DataFrame, password: str, keep: list[str] | None = None) -> DataFrame:
    """object_id, container (plain), error and the columns ``keep`` of rows (object_id, container); containers of different salts may come together.

    Salt, derivation and nonce are those of each container's own note; a salt's key is
    derived once a task. Wrong passwords, changed chunks, chunks that the note lists but
    that are missing, and plain containers are told apart by their error. Rows are independent.
    """

    keep = keep or []
    of = lambda field: F.get_json_object("f.encr", f"$.{field}")
    framed = rows.select("object_id", split_frame(password)("container", F.lit(None).cast("binary")).alias("f"), *keep)
    usable = (of("mode") == "password") & (F.coalesce(of("kdf"), F.lit("pbkdf2-sha256")) == "pbkdf2-sha256")
    keyed = framed.select("object_id", "f", usable.alias("usable"), of("kdf").alias("kdf"), of("mode").alias("mode"), of("chunks").alias("listed"), F.col("f.key").alias("key"), *keep)

    def open_one(p):
        opened = F.try_aes_decrypt(F.concat(p["nonce"], p["payload"]), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), _aad(p))
        return F.when(p["nth"].isNotNull() & F.col("key").isNotNull(), opened).otherwise(p["payload"])

    opened = keyed.withColumn("bodies", F.transform("f.parts", open_one))
    present = F.array_sort(F.array_distinct(F.transform(F.filter("f.parts", lambda p: p["nth"].isNotNull()), lambda p: p["tag"])))
    listed = F.array_sort(F.array_distinct(F.coalesce(F.from_json("listed", "array<string>"), F.array().cast("array<string>"))))
    why = (
        F.when(F.col("f.error").isNotNull(), F.col("f.error"))
        .when(F.col("f.encr").isNull(), "the container is not encrypted")
        .when(F.coalesce("mode", F.lit("")) != "password", "the container was not encrypted with a password")
        .when(~F.col("usable"), F.concat(F.lit("key derivation "), "kdf", F.lit(" is not available here")))
        .when(F.exists("bodies", lambda b: b.isNull()), "wrong password, or the container was modified")
        .when((F.size(listed) > 0) & (listed != present), "the note lists other chunks than the container has, it was modified")
    )
    done = opened.select("object_id", "f", "bodies", why.alias("error"), F.lit(None).cast("string").alias("note"), *keep)
    return _whole(done, keep)


def is_encrypted(container) -> "F.Column":
    """Whether the first chunk of a container says that it is encrypted."""
    return (F.substring(container, 1, 8) == F.lit(MAGIC)) & (F.substring(container, HEADER_SIZE + 1, 4) == F.lit(b"ENCR"))
