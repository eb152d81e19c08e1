"""Queries over the driver's tables, one or more an operator, with their DuckDB counterparts.

Documents, pages and conversations stand for files: their text is the file's bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions import detect as D
from lodestone.functions import scalar as S
from lodestone.operators import graph, pixels, samples, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def data() -> Column:
    return F.encode("text", "UTF-8")


# DuckDB pieces
_HEX = "hex(encode(coalesce(text, '')))"
_BYTES = f"list_transform(range(least(octet_length(encode(coalesce(text, ''))), 4096)), lambda i: substr({_HEX}, 2 * i::BIGINT + 1, 2))"
_IS_TEXT = f"""
    b AS (SELECT *, {_BYTES} AS bytes FROM src),
    p AS (SELECT * EXCLUDE (bytes), len(bytes) AS n, list_contains(bytes, '00') AS nul,
                 len(list_filter(bytes, lambda h: (h >= '20' AND h <= '7E') OR h IN ('09', '0A', '0D'))) AS printable FROM b),
    t AS (SELECT *, CASE WHEN n = 0 THEN true WHEN nul THEN false ELSE printable / n > 0.92 END AS ok,
                 CASE WHEN n = 0 THEN 0.5 WHEN nul THEN 0.95 ELSE round(least(0.99, 0.5 + printable::DOUBLE / n / 2), 2) END::DOUBLE AS sure FROM p)"""


@query(f"""WITH src AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), {_IS_TEXT}
    SELECT lang, CASE WHEN n = 0 THEN 'empty' WHEN text LIKE 'BM%' THEN 'bmp' WHEN ok THEN 'text' ELSE 'blob' END AS kind, count(*) AS files,
           sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words,
           sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, count(DISTINCT sha256(text)) AS checksums
    FROM t GROUP BY ALL""")
def object_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detect, checksum and measure every document, then count by language and kind."""
    d = docs(spark, sf_dir).withColumns({"found": D.detect(data(), F.lit("")), "stats": text.stats(F.col("text")), "sum": S.sha256_hex(data())})
    kind = F.col("found.format_id")
    kind = F.when(kind.isin("empty", "bmp", "blob"), kind).otherwise("text")
    return d.groupBy("lang", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("stats.chars").alias("chars"),
        F.sum("stats.words").alias("words"),
        F.sum("stats.lines").alias("lines"),
        F.countDistinct("sum").alias("checksums"),
    )


@query("""SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words,
       length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
       len(list_distinct(list_transform(regexp_extract_all(text, '\\S+'), lambda w: lower(w)))) AS unique_words
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def doc_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS checksum, left(sha256(coalesce(text, '')), 16) AS blob_key,
       octet_length(encode(coalesce(text, ''))) AS size FROM documents""")
def doc_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", S.sha256_hex(data()).alias("checksum"), S.blob_key(data()).alias("blob_key"), F.octet_length("text").cast("bigint").alias("size"))


@query(f"WITH src AS (SELECT doc_id, text FROM documents), {_IS_TEXT} SELECT doc_id, ok, sure, printable FROM t")
def doc_is_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, sure = S.looks_like_text(data())
    return docs(spark, sf_dir).select("doc_id", ok.alias("ok"), sure.alias("sure"), S.printable_ratio_parts(data())[0].cast("bigint").alias("printable"))


@query(f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {_IS_TEXT},
    s AS (SELECT *, left(text, 2000) AS head, split_part(left(text, 4096), chr(10), 1) AS line,
                 list_filter(string_split(left(text, 4096), chr(10)), lambda r: regexp_matches(r, '\\S'))[1:12] AS lines FROM t),
    c AS (SELECT *, list_distinct(list_transform(lines, lambda r: length(r) - length(replace(r, ',', '')))) AS commas FROM s)
    SELECT doc_id, CASE
        WHEN n = 0 THEN 'empty' WHEN text LIKE 'BM%' THEN 'bmp' WHEN NOT ok THEN 'blob'
        WHEN regexp_matches(left(text, 1024), '(?i)<!doctype\\s+html|<html[\\s>]') THEN 'html'
        WHEN regexp_matches(head, '^[A-Za-z_][\\w\\-]*:\\s*\\S') AND line LIKE '%:%' THEN 'yaml'
        WHEN line LIKE '%,%' AND contains(left(text, 4096), chr(10)) AND len(lines) >= 2 AND len(commas) = 1 AND commas[1] >= 1 THEN 'csv'
        WHEN regexp_matches(head, '(?m)^#{{1,6}}\\s|\\*\\*.+\\*\\*|\\[.+\\]\\(.+\\)') THEN 'md'
        ELSE 'txt' END AS format_id
    FROM c""")
def doc_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", D.detect(data(), F.lit("")).alias("d")).select("doc_id", "d.format_id")


@query(f"""WITH src AS (SELECT page_id, coalesce(html, '') AS text FROM pages), {_IS_TEXT}
    SELECT page_id, CASE WHEN n = 0 THEN 'empty' WHEN ok THEN 'html' ELSE 'blob' END AS format_id,
           CASE WHEN n = 0 THEN 1.0 WHEN ok THEN least(0.9, sure) ELSE 0.3 END::DOUBLE AS confidence FROM t""")
def page_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    found = D.detect(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), F.lit("page"))
    return p.select("page_id", found.alias("d")).select("page_id", "d.format_id", "d.confidence")


@query()
def doc_detect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.magic_report(data(), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")))
    return docs(spark, sf_dir).select("doc_id", found.alias("r")).select("doc_id", "r.detection.*", "r.head_bytes_hex", "r.head_bytes_ascii")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS position, length(regexp_extract(line, '^(#{1,6})', 1)) AS level,
           regexp_extract(line, '^#{1,6}\\s+(.+)$', 1) AS heading
    FROM l WHERE regexp_matches(line, '^#{1,6}\\s+[^\\n]+$')""")
def doc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", F.posexplode(text.headings(F.col("text"))).alias("position", "h"))
    return found.select("doc_id", F.col("position").cast("bigint").alias("position"), F.col("h.level").cast("bigint").alias("level"), F.col("h.text").alias("heading"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    SELECT doc_id, len(lines) AS lines, length(text) AS chars,
           len(list_filter(lines, lambda x: regexp_matches(regexp_replace(x, '^\\s+', ''), '^(//|#|\\*|/\\*)'))) AS comment_lines,
           len(list_filter(lines, lambda x: NOT regexp_matches(x, '\\S'))) AS blank_lines,
           len(regexp_extract_all(text, '(?m)^\\s*(def|class)\\s+\\w+')) AS definition_like
    FROM d""")
def doc_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.source_stats(F.col("text"), "python").alias("s")).select("doc_id", "s.*")


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""SELECT doc_id, md5('<!doctype html><html><head><meta charset=''utf-8''><title>' || {_ESCAPE.format('source')} || '</title></head><body><pre>'
       || {_ESCAPE.format("coalesce(text, '')")} || '</pre></body></html>') AS page_md5 FROM documents""")
def doc_html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(F.encode(text.html_page(F.col("text"), F.col("source")), "UTF-8")).alias("page_md5"))


@query("""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    b AS (SELECT doc_id, n, unnest(list_transform(range(least(n, 1000000)), lambda i: substr(h, 2 * i::BIGINT + 1, 2))) AS pair FROM d),
    c AS (SELECT doc_id, n, pair, count(*) AS k FROM b GROUP BY ALL)
    SELECT doc_id, round(coalesce(-sum(k / n * log2(k / n)), 0)::DOUBLE, 3) AS entropy,
           round(coalesce(sum(k) FILTER (pair >= '20' AND pair <= '7E') / max(n), 0)::DOUBLE, 3) AS printable_ratio
    FROM c GROUP BY doc_id UNION ALL SELECT doc_id, 0.0::DOUBLE, 0.0::DOUBLE FROM d WHERE n = 0""")
def doc_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.byte_profile(docs(spark, sf_dir), "doc_id", data())


@query("""WITH d AS (SELECT doc_id, left(lower(hex(encode(coalesce(text, '')))), 512) AS h FROM documents),
    l AS (SELECT doc_id, i, substr(h, 32 * i::BIGINT + 1, 32) AS row FROM d, range(16) r(i) WHERE length(h) > 32 * i),
    c AS (SELECT doc_id, i, row, list_transform(range(length(row) // 2), lambda k: substr(row, 2 * k::BIGINT + 1, 2)) AS pairs FROM l)
    SELECT doc_id, count(*) AS lines, string_agg(format('{:08x}', 16 * i) || '  ' || rpad(array_to_string(pairs, ' '), 47, ' ') || '  '
        || array_to_string(list_transform(pairs, lambda p: CASE WHEN p >= '20' AND p <= '7e' THEN decode(from_hex(p)) ELSE '.' END), ''), chr(10) ORDER BY i) AS dump
    FROM c GROUP BY doc_id""")
def doc_hex_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    dump = S.hex_preview(data())
    shown = docs(spark, sf_dir).filter(F.col("text") != "").select("doc_id", dump.alias("dump"))
    return shown.select("doc_id", F.size(F.split("dump", "\n")).cast("bigint").alias("lines"), "dump")


@query("""SELECT doc_id, lower(coalesce(text, '')) AS text, octet_length(encode(lower(coalesce(text, '')))) AS size, sha256(coalesce(text, '')) AS original_checksum,
       2 AS steps, 'edit.set_text' AS last_action, 'text replaced (' || length(lower(coalesce(text, ''))) || ' chars)' AS last_detail FROM documents""")
def doc_set_text_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document edited."""
    return _lowered(docs(spark, sf_dir))


@query("""SELECT doc_id, lower(coalesce(text, '')) AS text, octet_length(encode(lower(coalesce(text, '')))) AS size, sha256(coalesce(text, '')) AS original_checksum,
       2 AS steps, 'edit.set_text' AS last_action, 'text replaced (' || length(lower(coalesce(text, ''))) || ' chars)' AS last_detail FROM documents""")
def doc_set_text_edit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lowered(docs(spark, sf_dir))


def _lowered(some: DataFrame) -> DataFrame:
    """Edits change the text and the history; the original bytes stay what they were."""
    from lodestone.operators.edits import set_text

    objects = some.select(
        "doc_id", F.lit("txt").alias("detected_format"), "text", data().alias("original_bytes"), graph.record(F.lit(None), "import", F.lit("imported")).alias("history")
    )
    edited = set_text(objects, F.lower("text"))
    last = F.element_at("history", -1)
    return edited.select("doc_id", "text", "size", S.sha256_hex(F.col("original_bytes")).alias("original_checksum"), F.size("history").alias("steps"), last["action"].alias("last_action"), last["detail"].alias("last_detail"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE array_to_string(list_filter(string_split(replace(url, '://', '/./'), '/'), lambda p: p NOT IN ('', '.')), '/') END AS path,
       regexp_replace(list_extract(string_split(url, '/'), -1), '[^\\w.\\- ]+', '_', 'g') AS base
    FROM pages""")
def url_sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("a/../"), "url")).otherwise(F.replace("url", F.lit("://"), F.lit("\\.\\")))
    base = F.regexp_replace(F.substring_index("url", "/", -1), r"(?U)[^\w.\- ]+", "_")
    return p.select("page_id", S.sanitize_path(path).alias("path"), base.alias("base"))


@query("""WITH u AS (SELECT page_id, list_extract(string_split(coalesce(url, ''), '/'), -1) AS last FROM pages),
    c AS (SELECT page_id, last, trim(regexp_replace(CASE WHEN last = '' THEN '' ELSE last END, '[^\\w.\\- ]+', '_', 'g'), ' .') AS clean FROM u)
    SELECT page_id, left(CASE WHEN clean = '' THEN 'file' ELSE clean END, 120) AS filename,
           CASE WHEN contains(last, '.') THEN regexp_replace(last, '\\.[^.]*$', '') ELSE last END AS stem FROM c""")
def url_safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.safe_filename(F.col("url")).alias("filename"), S.stem(F.col("url")).alias("stem"))


@query("SELECT format, display, extension, category, mime, read, create_, edit, export, detection, support FROM (VALUES "
       + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in (f.format, f.display, f.extension, f.category, f.mime, f.read, f.create, f.edit, f.export, f.detection, f.support)) + ")" for f in model.FORMATS.values())
       + ") t(format, display, extension, category, mime, read, create_, edit, export, detection, support) ORDER BY category, format")
def format_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.formats(spark).withColumnRenamed("create", "create_").orderBy("category", "format")


@query("SELECT format FROM (VALUES " + ", ".join(f"('{f.format}', '{f.extension}', '{f.category}', '{f.mime}')" for f in model.FORMATS.values())
       + ") t(format, extension, category, mime) WHERE contains(lower(format || extension || category || mime), 'audio')")
def format_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.catalog import search

    return search(model.formats(spark), "Audio").select("format")


@query("SELECT format, count(*) AS targets, count(*) FILTER (kind = 'LOSSLESS') AS lossless FROM (VALUES "
       + ", ".join(f"('{f}', '{t}', '{k}')" for f, edges in model.EXPORTS.items() for t, k in edges) + ") t(format, target, kind) GROUP BY format")
def conversion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.exports(spark).groupBy("format").agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("kind") == "LOSSLESS").alias("lossless"))


@query(f"""WITH src AS (SELECT doc_id, text FROM documents), {_IS_TEXT}
    SELECT doc_id, CASE WHEN text LIKE 'BM%' OR NOT ok THEN 0 ELSE 1 END + 0 AS any_text FROM t""")
def doc_any_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = S.looks_like_text(data())
    return docs(spark, sf_dir).select("doc_id", F.when(F.startswith("text", F.lit("BM")) | ~ok, 0).otherwise(1).alias("any_text"))


@query()
def applicable_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.catalog import applicable

    objects = docs(spark, sf_dir).select("doc_id", D.detect(data(), F.lit("")).alias("d")).select("doc_id", F.col("d.family").alias("object_type"), F.col("d.format_id").alias("detected_format"))
    return applicable(objects).groupBy("id").agg(F.count(F.lit(1)).alias("objects"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def catalog_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(" UNION ALL ".join(f"(SELECT '{t}' AS table_name, {k}::BIGINT AS id FROM {t} ORDER BY {k} LIMIT 5)" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("pages", "page_id"))))
def catalog_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each table (a sample is what the catalog shows)."""
    parts = [table(spark, sf_dir, t).orderBy(k).limit(5).select(F.lit(t).alias("table_name"), F.col(k).cast("bigint").alias("id")) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("pages", "page_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def conversation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Roots (conversations), and edges to their turns; a turn hangs below the turn before it."""
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("conv"), F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn").alias("id"), "turn").distinct()
    edges = c.select(F.col("conv").alias("src_id"), F.col("id").alias("dst_id"), F.col("turn").cast("int").alias("ordinal"), F.lit("contains").alias("relation"), F.lit("").alias("note"))
    return c.select(F.col("conv").alias("id")).distinct(), edges


@query("""SELECT 'c' || conv_id AS object_id, count(DISTINCT turn) AS children FROM conversations GROUP BY conv_id""")
def conv_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges = conversation_graph(spark, sf_dir)
    return graph.summary(roots.withColumnRenamed("id", "object_id"), edges)


@query("""SELECT DISTINCT 'c' || conv_id AS root, 'c' || conv_id || 't' || turn AS id, 1 AS depth, turn::INT AS last FROM conversations
    UNION ALL SELECT DISTINCT 'c' || conv_id, 'c' || conv_id, 0, -1 FROM conversations""")
def conv_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges = conversation_graph(spark, sf_dir)
    return graph.walk(roots, edges).select("root", "id", "depth", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(-1)).alias("last"))


@query("SELECT 'c' || conv_id AS root, 'c' || conv_id || 't' || min(turn) AS id FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def conv_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of the assistant in each conversation, by the pre-order walk."""
    roots, edges = conversation_graph(spark, sf_dir)
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn").alias("id")).distinct()
    return graph.find(graph.walk(roots, edges).join(said, "id"), F.lit(True)).select("root", "id")


@query("""WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
    SELECT 'c' || conv_id AS src_id, role, n AS edges FROM c""")
def conv_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    new = c.select(F.concat(F.lit("c"), "conv_id").alias("conv"), F.col("role"), F.concat_ws("-", "conv_id", "turn", "role").alias("id"), "turn")
    none = conversation_graph(spark, sf_dir)[1].limit(0)
    added = graph.add_children(none, F.col("conv"), new, ["turn", "role"])
    return added.groupBy("src_id", F.element_at(F.split("dst_id", "-"), -1).alias("role")).agg(F.count(F.lit(1)).alias("edges"))


@query("""SELECT conv_id, max(turn) + 2 AS steps, 'close' AS action, 'ended after ' || count(*) || ' turns' AS detail, 'STRUCTURAL' AS kind FROM conversations GROUP BY conv_id""")
def conv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of each conversation: a step for each turn number, then one recorded at its end."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count(F.lit(1)).alias("turns"))
    first = graph.record(F.lit(None), "turn", F.lit("turn"))
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda k: first[0].withField("step", (k + 1).cast("int")))
    done = graph.record(steps, "close", F.concat(F.lit("ended after "), "turns", F.lit(" turns")), "STRUCTURAL")
    end = F.element_at(done, -1)
    return c.select("conv_id", end["step"].cast("bigint").alias("steps"), end["action"].alias("action"), end["detail"].alias("detail"), end["kind"].alias("kind"))


@query("""SELECT user_id, ts, event_id FROM (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 objects put last (the limit is the store's)."""
    return graph.recent(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query("""WITH s AS (SELECT doc_id::VARCHAR AS object_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
    n AS (SELECT * FROM (VALUES (0, 'FILE'), (1, 'FORMAT DETECTION'), (2, 'FORMAT ADAPTER'), (3, 'UNIVERSAL OBJECT'), (4, 'OBJECT GRAPH'), (5, 'TRANSFORMATION'), (6, 'EXPORT ADAPTER'), (7, 'TARGET FILE')) v(position, stage))
    SELECT object_id, position, stage, CASE position WHEN 0 THEN 'doc' || object_id || '.bin — ' || size || ' bytes' WHEN 1 THEN NULL WHEN 2 THEN 'text adapter' WHEN 3 THEN 'TEXT — content ' || chr(39) || 'text' || chr(39)
        WHEN 4 THEN '0 direct children, 0 relationships' WHEN 5 THEN '1 recorded operations' WHEN 6 THEN '5 real export targets' ELSE 'choose an EXPORT AS target above' END AS detail FROM s, n""")
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of every document; the detection's detail is that of doc_detect and null here."""
    return _stages(docs(spark, sf_dir)).withColumn("detail", F.when(F.col("position") != 1, F.col("detail")))


@query()
def pipeline_stages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(docs(spark, sf_dir))


def _stages(some: DataFrame) -> DataFrame:
    objects = some.select(
        F.col("doc_id").cast("string").alias("object_id"), F.concat(F.lit("doc"), "doc_id", F.lit(".bin")).alias("original_filename"), F.octet_length("text").alias("size"),
        D.detect(data(), F.lit("x.bin")).alias("detection"), F.lit("text").alias("adapter"), F.lit("TEXT").alias("object_type"), F.lit("text").alias("kind"),
        F.lit(0).alias("children"), F.lit(0).alias("relationships"), F.lit(1).alias("steps"), F.lit(5).alias("targets"),
    )
    return graph.pipeline_stages(objects)


@query("""SELECT vec_id, list_min(list_filter(e, lambda x, i: (i - 1) % 3 = 0)) AS min_x, list_max(list_filter(e, lambda x, i: (i - 1) % 3 = 2)) AS max_z,
       len(e) // 3 AS vertices, list_sum(list_filter(e, lambda x, i: ((i - 1) // 3) % greatest(1, (len(e) // 3) // 4) = 0 AND (i - 1) < (len(e) // 3) * 3)[1:12])::DOUBLE AS thinned_sum
    FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1024)) AS e FROM embeddings)""")
def emb_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as xyz triples: bounds, and four points at most after thinning (whole numbers, so sums are exact)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 1024)).alias("e"))
    box = S.bbox(F.col("e"))
    total = F.aggregate(S.decimate(F.col("e"), 4), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", box[0].alias("min_x"), box[5].alias("max_z"), F.floor(F.size("e") / 3).alias("vertices"), total.alias("thinned_sum"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (value * 100)::INT % 32768 AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, i // greatest(1, n // 8) AS bucket, round(max(abs(v))::DOUBLE / 32768, 3) AS peak FROM s WHERE i // greatest(1, n // 8) < 8 GROUP BY ALL""")
def event_waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples.by_time(table(spark, sf_dir, "events").withColumn("v", F.round(F.col("value") * 100).cast("int") % 32768), "user_id", ["ts", "event_id"], "v")
    return samples.waveform(s, "user_id", F.col("i"), F.col("value"), 8)


_GRADIENT = "SELECT x::INT AS x, y::INT AS y, (x * 255 // 63)::INT AS r, (y * 255 // 47)::INT AS g, 160 AS b, 255 AS a FROM range(64) h(x), range(48) v(y)"


def gradient(spark: SparkSession) -> DataFrame:
    return pixels.create(spark, 1, 64, 48)


@query(f"WITH p AS ({_GRADIENT}) SELECT x - 10 AS x, y - 5 AS y, r, g, b, a FROM p WHERE x BETWEEN 10 AND 29 AND y BETWEEN 5 AND 19")
def px_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.crop(gradient(spark), 10, 5, 20, 15, 64, 48).drop("image")


@query(f"WITH p AS ({_GRADIENT}) SELECT 47 - y AS x, x AS y, r, g, b, a FROM p")
def px_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rotate(gradient(spark), 90, 64, 48).drop("image")


@query(f"WITH p AS ({_GRADIENT}) SELECT 63 - x AS x, y, r, g, b, a FROM p")
def px_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.flip(gradient(spark), "horizontal", 64, 48).drop("image")


@query(f"WITH p AS ({_GRADIENT}), g AS (SELECT x, y, (r * 299 + g * 587 + b * 114) // 1000 AS v, a FROM p) SELECT x, y, v AS r, v AS g, v AS b, a FROM g")
def px_grayscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.grayscale(gradient(spark)).drop("image")


@query(f"WITH p AS ({_GRADIENT}) SELECT tx::INT AS x, ty::INT AS y, r, g, b, a FROM range(37) h(tx), range(90) v(ty), p WHERE p.x = least(63, tx * 64 // 37) AND p.y = least(47, ty * 48 // 90)")
def px_resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.resize_nearest(gradient(spark), 64, 48, 37, 90).drop("image")


@query(f"""WITH p AS ({_GRADIENT}), t AS (SELECT tx, ty, tx * (63.0::DOUBLE / 32) AS fx, ty * (47.0::DOUBLE / 23) AS fy FROM range(33) h(tx), range(24) v(ty)),
    c AS (SELECT tx, ty, floor(fx)::INT AS x0, floor(fy)::INT AS y0, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM t),
    q AS (SELECT tx, ty, x0 AS x, y0 AS y, (1 - wx) * (1 - wy) AS w FROM c UNION ALL SELECT tx, ty, least(x0 + 1, 63), y0, wx * (1 - wy) FROM c
          UNION ALL SELECT tx, ty, x0, least(y0 + 1, 47), (1 - wx) * wy FROM c UNION ALL SELECT tx, ty, least(x0 + 1, 63), least(y0 + 1, 47), wx * wy FROM c)
    SELECT tx::INT AS x, ty::INT AS y, floor(round(sum(r * w), 6) + 0.5)::INT AS r, floor(round(sum(g * w), 6) + 0.5)::INT AS g, floor(round(sum(b * w), 6) + 0.5)::INT AS b, floor(round(sum(a * w), 6) + 0.5)::INT AS a
    FROM q JOIN p USING (x, y) WHERE w > 0 GROUP BY ALL""")
def px_resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.resize_bilinear(gradient(spark), spark.range(1).withColumnRenamed("id", "image"), 64, 48, 33, 24).drop("image")


@query("""SELECT source, count(*) AS entries, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total,
       CASE WHEN count(*) > 10000 THEN 'archive has more than 10000 entries' WHEN sum(octet_length(encode(coalesce(text, '')))) > 268435456 THEN 'archive expands beyond 268435456 bytes' END AS refusal
    FROM documents GROUP BY source""")
def extraction_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text").cast("bigint")).alias("total"))
    return sizes.withColumn("refusal", S.budget_refusal(F.col("total"), F.col("total"), F.col("entries")))


@query("SELECT i, ((i * 37 + 11) & 255)::INT AS byte FROM range(512) r(i)")
def blob_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.blob_pattern(spark, 512)


@query("""WITH f AS (SELECT o_orderkey AS face, 3 + (o_orderkey % 4)::INT AS n FROM orders),
    t AS (SELECT face, n, unnest(range(1, n - 1)) AS k FROM f) SELECT face, k::INT AS k, 0 AS a, k::INT AS b, k::INT + 1 AS c FROM t""")
def mesh_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as polygons of 3 to 6 corners, fanned into triangles."""
    faces = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("face"), F.lit(6).alias("vertices"), F.transform(F.sequence(F.lit(1), 3 + (F.col("o_orderkey") % 4).cast("int")), lambda i: i).alias("corners"))
    return samples.fan_triangles(faces, ["face"])


@query("""WITH l AS (SELECT n_nationkey AS k, list_transform([n_name, n_regionkey::VARCHAR], lambda v: v) AS v FROM nation)
    SELECT 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS csv FROM nation""")
def nation_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.exports import table_to_csv

    return table_to_csv(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], order=["n_nationkey"])


@query("""SELECT r_regionkey, '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' AS row_json FROM region""")
def csv_rows_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.exports import row_to_json

    return table(spark, sf_dir, "region").select("r_regionkey", row_to_json(["r_regionkey", "r_name"], F.array(F.col("r_regionkey").cast("string"), "r_name")).alias("row_json"))
