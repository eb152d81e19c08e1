"""The object graph as edges (src_id, dst_id, ordinal, relation, note), history rows, recents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.model import HISTORY, LIMITS

#: Depth at which a walk gives up; deeper graphs are cut there.
MAX_DEPTH = 100


def add_children(edges: DataFrame, parent: Column, children: DataFrame, order: list, relation: str = "contains") -> DataFrame:
    """edges with one more for each row of ``children`` (id): ordinals follow the parent's last one."""
    new = children.select(parent.alias("src_id"), F.col("id").alias("dst_id"), *order)
    last = edges.groupBy("src_id").agg(F.max("ordinal").alias("last"))
    numbered = new.withColumn("nth", F.row_number().over(W.partitionBy("src_id").orderBy(*order))).join(last, "src_id", "left")
    rows = numbered.select(
        "src_id", "dst_id", (F.col("nth") + F.coalesce(F.col("last") + 1, F.lit(0)) - 1).cast("int").alias("ordinal"), F.lit(relation).alias("relation"), F.lit("").alias("note")
    )
    return edges.unionByName(rows)


def walk(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id, depth, path of every object below (and with) the roots; ordered by path it is the pre-order walk.

    A recursive query over the edges: each level is one join, the path holds the ordinals from the root.
    """
    spark = roots.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE down(root, id, depth, path) MAX RECURSION LEVEL {MAX_DEPTH} AS (
                SELECT id, id, 0, CAST(array() AS array<int>) FROM {{roots}}
                UNION ALL
                SELECT root, dst_id, depth + 1, concat(path, array(ordinal)) FROM down JOIN {{edges}} ON src_id = down.id)
            SELECT root, id, depth, path FROM down""",
        roots=roots.select("id"),
        edges=edges.select("src_id", "dst_id", "ordinal"),
    )


def find(walked: DataFrame, wanted: Column) -> DataFrame:
    """The first object of each root's pre-order walk that is wanted: root, id, path."""
    return walked.filter(wanted).groupBy("root").agg(F.min_by("id", "path").alias("id"), F.min("path").alias("path"))


def summary(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Each object with its number of children (one aggregation, one join)."""
    counts = edges.groupBy(F.col("src_id").alias("object_id")).agg(F.count(F.lit(1)).alias("children"))
    return objects.join(counts, "object_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def record(history: Column, action: str, detail: Column, kind: str | Column = "LOSSLESS", params: Column | None = None, ts: Column | None = None) -> Column:
    """history with one more step, numbered on."""
    history = F.coalesce(history, F.array().cast(f"array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in HISTORY.split(', '))}>>"))
    step = F.struct(
        (F.size(history) + 1).alias("step"),
        F.lit(action).alias("action"),
        detail.cast("string").alias("detail"),
        F.lit(kind).alias("kind"),
        (F.lit("{}") if params is None else params).alias("params"),
        (F.lit(None) if ts is None else ts).cast("timestamp").alias("ts"),
    )
    return F.array_append(history, step)


def recent(puts: DataFrame, key: str, when: list[str], most: int = LIMITS.recent) -> DataFrame:
    """The objects put last: the latest row a key, the ``most`` newest of them in order."""
    latest = F.struct(*when)
    newest = puts.groupBy(key).agg(F.max(latest).alias("latest"))
    return newest.orderBy(F.desc("latest")).limit(most).select(key, "latest.*")


def pipeline_stages(objects: DataFrame) -> DataFrame:
    """object_id, position, stage, detail: the eight stages that every object goes through.

    objects: object_id, original_filename, size, detection, adapter, object_type, kind, children, relationships, steps, targets.
    """
    text = lambda *p: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in p))
    c, s = F.col, lambda n: F.col(n).cast("string")
    percent = F.concat(F.round(c("detection.confidence") * 100).cast("int").cast("string"), F.lit("%"))
    stages = [
        ("FILE", text(F.when(F.coalesce("original_filename", F.lit("")) == "", "(unnamed)").otherwise(c("original_filename")), " — ", s("size"), " bytes")),
        ("FORMAT DETECTION", text(c("detection.display"), " (", percent, " via ", c("detection.method"), ")")),
        ("FORMAT ADAPTER", text(c("adapter"), " adapter")),
        ("UNIVERSAL OBJECT", text(c("object_type"), " — content '", F.coalesce("kind", F.lit("?")), "'")),
        ("OBJECT GRAPH", text(s("children"), " direct children, ", s("relationships"), " relationships")),
        ("TRANSFORMATION", text(s("steps"), " recorded operations")),
        ("EXPORT ADAPTER", text(s("targets"), " real export targets")),
        ("TARGET FILE", F.lit("choose an EXPORT AS target above")),
    ]
    every = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), d.alias("detail")) for i, (n, d) in enumerate(stages)))
    return objects.select("object_id", F.explode(every).alias("s")).select("object_id", "s.*")


def tree_lines(walked: DataFrame, label: Column) -> DataFrame:
    """root, report: each root's walk as indented lines."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), label)
    listed = walked.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("lines"))
    return listed.select("root", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("report"))
