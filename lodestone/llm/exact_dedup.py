"""Exact deduplication over a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. New rows are reduced to one row
a digest first (map-side aggregation, so a group of copies of any size costs one row
a task), then a sort-merge anti-join against the index, which is read in its buckets,
leaves the unseen digests, and these are appended. A table is taken in two loads, rows
of the greater ids first, so that of equal texts the greatest id is in the index when
the others come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, shared_dir


def digest(text: Column) -> Column:
    """Binary SHA-256 of the UTF-8 text; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest of every row, read from the texts once."""
    return materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")


class DigestIndex:
    """Digests seen so far, each with the id of the row that stays and how many rows share that id and text.

    ``name`` is a table name; its files lie under ``path`` (default: the shared
    folder of the session), so another session can ``open`` them again.
    """

    SCHEMA = "digest BINARY, keep_id BIGINT, keeps BIGINT"

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 64, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"lodestone_digests_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def open(self) -> "DigestIndex":
        """Register files that an earlier session left under ``path``."""
        if not self.exists():
            self.spark.sql(
                f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
        return self

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, rows: DataFrame) -> DataFrame:
        """Add the digests of ``rows`` (doc_id, digest) that the index lacks; they are returned with keep_id and keeps.

        Of equal texts the largest doc_id stays; a digest that the index has keeps
        its earlier row, so a later copy is dropped whatever its id.
        """
        by_id = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("keeps"))
        # A null id sorts before all others, so it stays only where the group has no other.
        fresh = by_id.groupBy("digest").agg(F.max(F.struct("doc_id", "keeps")).alias("most")).select("digest", F.col("most.doc_id").alias("keep_id"), F.col("most.keeps").alias("keeps"))
        if self.exists():
            fresh = fresh.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        fresh = materialise(fresh, "fresh")
        (
            fresh.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )
        return fresh


def loads(rows: DataFrame) -> list[DataFrame]:
    """The rows (doc_id, digest) in two parts: ids of the upper half of the range, and the rest with null ids."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or low == high:
        return [rows]
    newer = F.coalesce(F.col("doc_id") > (low + high) // 2, F.lit(False))
    return [rows.filter(newer), rows.filter(~newer)]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; an empty table gives no rows; a null doc_id never wins
    against another id and stays only where its whole group has null ids; repeated
    rows (same id and text) count in group_size (rows of ``docs`` with equal text) and
    share one verdict. With an ``index`` that has a text already, keep_id is its row.
    Columns other than doc_id and text are ignored.
    """
    rows, own = digested(docs), index or DigestIndex(docs.sparkSession)
    for part in [rows] if index else loads(rows):
        own.append_new(part)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    # One row a digest, with the index in its buckets; the join of all rows below is between plain files, so that a group of copies can be split.
    verdicts = materialise(sizes.join(own.table().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "verdicts")
    if index is None:
        own.close()
    return rows.join(verdicts.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: of each text that the index lacks the row with the largest id.

    Of rows that share id and text one stays (any of them). Other cases as in exact_dedup.
    """
    rows, own = digested(docs), index or DigestIndex(docs.sparkSession)
    fresh = [own.append_new(part) for part in ([rows] if index else loads(rows))]
    if index is None:
        own.close()
    every = fresh[0]
    for more in fresh[1:]:
        every = every.unionByName(more)
    keep = every.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"))
    same = (F.col("__of") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__keep_id"))
    stay = docs.select("*", digest(F.col("text")).alias("__of")).join(keep.hint("merge"), same, "left_semi")
    if every.filter("keeps > 1").limit(1).count():
        stay = stay.dropDuplicates(["__of", "doc_id"])
    return stay.drop("__of")
