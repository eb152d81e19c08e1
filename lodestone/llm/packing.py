"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous rounds.

Pieces of documents and gaps (the free ends of open sequences) are tables; both are
range-sorted by size, and each row gets its rank among the rows of its size. Pieces of
over half a sequence go first, then those of over a quarter, then the rest. A round
takes the largest pieces that can all have a gap of their own, one a gap. The successor
of a piece is the first gap, by rising size, that holds it; several pieces with one
successor are moved on by their rank (a piece's place is its own rank plus the
greatest lead that the gaps too small for a smaller or equal piece have), so pieces and gaps meet
in a join by place. The gaps shrink by what they took, and rounds repeat until no piece is left;
sequences are opened when nothing fits. Where many pieces are left for each gap, pieces of one
small size go several at a time. The driver sees only the pieces' counts by size, at most
``capacity``, and derives those of the gaps from the runs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, slices, utf8, vocabulary
from lodestone.llm.common import materialise

#: Shards over which the rows of each size are ranked: one for so many rows of the table, up to a number.
SHARD_ROWS, MOST_SHARDS = 2_000, 256
#: Rows in a file of a round's tables, about.
FILE_ROWS = 50_000
#: A round gives a gap several pieces of one size only up to this part of what is left for each gap, and of a sequence.
SHARE = 8


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids followed by ``end_id``; only longer ones are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        last = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            ids, ends = encoder.encode_block(*utf8(batch))
            packed, begin = ids.astype("<u4").tobytes(), 0
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own, n = packed[4 * begin : 4 * end] + last, end - begin + 1
                begin = end
                at, piece = 0, 0
                step = n % capacity or min(n, capacity)
                while at < n:
                    for column, value in zip(rows, (doc_id, piece, at, step, zlib.crc32(own[4 * at : 4 * (at + step)]))):
                        column.append(value)
                    at, piece, step = at + step, piece + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(left: dict[int, int], room: dict[int, int], most: int) -> list[tuple[int, int, int, int]]:
    """A round's runs (length, pieces in a bundle, bundles, place of the first), at most one a length.

    ``left`` and ``room`` count pieces and gaps by size; ``most`` bounds the size of a bundle.
    Places number the gaps by rising size.
    """
    sizes = np.array(sorted(room), dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum([room[g] for g in sizes.tolist()]))).astype(np.int64)
    total = int(upto[-1])
    small = lambda width: int(upto[np.searchsorted(sizes, width)])  # noqa: E731  gaps below a size
    each = sum(left.values()) // max(1, total)
    items = []
    for size, n in left.items():
        bundle = max(1, min(each // SHARE, most // size, n))
        items.append((bundle * size, size, bundle, n // bundle))
    chosen, taken = [], 0
    for width, size, bundle, n in sorted(items, reverse=True):  # the largest that can all have a gap
        n = min(n, total - small(width) - taken)
        if n > 0:
            chosen.append((width, size, bundle, n))
            taken += n
    runs, index, lead = [], 0, 0
    for width, size, bundle, n in reversed(chosen):
        lead = max(lead, small(width) - index)
        runs.append((size, bundle, n, index + lead))
        index += n
    return runs


def met_sizes(runs: list[tuple[int, int, int, int]], before: dict[int, int], room: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(gap, low, high, took): which places among the gaps of a size each run takes; fewer rows than runs and sizes together.

    ``before`` has the place of each size's first gap, ``room`` their number. Rows join by size, so no gap is held against every run.
    """
    out, sizes, at = [], sorted(before, key=before.__getitem__), 0
    for length, bundle, n, place in runs:  # by rising place, as sweep gives them
        while before[sizes[at]] + room[sizes[at]] <= place:
            at += 1
        low = place
        while low < place + n:
            gap = sizes[at]
            high = min(place + n, before[gap] + room[gap])
            out.append((gap, low, high, bundle * length))
            if high == before[gap] + room[gap]:
                at += 1
            low = high
    return out


def ranked(rows: DataFrame, size: str, order: list[str], count: int) -> DataFrame:
    """Adds rank: the row's place (from 0) among the rows of its ``size``, by a range-sort and prefix sums.

    Each size is split over shards by a hash of the row, so a size that holds most rows doesn't meet in one task.
    """
    shards = max(1, min(MOST_SHARDS, count // SHARD_ROWS))
    if shards == 1:  # one shard a size: the row's number in it is its rank
        return in_files(rows.repartitionByRange(size).withColumn("rank", F.row_number().over(W.partitionBy(size).orderBy(*order)) - 1), count)
    shard: Column = F.pmod(F.xxhash64(*order), F.lit(shards))
    dealt = rows.withColumn("shard", shard)
    before = W.partitionBy(size).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    # A row for each size and shard: at most capacity times MOST_SHARDS of them, so one task numbers them and they are broadcast.
    counts = dealt.groupBy(size, "shard").count().coalesce(1)
    starts = counts.select(size, "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy(size, "shard").orderBy(*order)
    sorted_rows = dealt.repartitionByRange(size, "shard").withColumn("nth", F.row_number().over(own) - 1)
    placed = sorted_rows.join(F.broadcast(starts), [size, "shard"]).withColumn("rank", F.col("nth") + F.col("first"))
    return in_files(placed.drop("shard", "nth", "first"), count)


def small_table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A table of whole numbers that the driver holds, as a local relation (no job and no Python worker reads it)."""
    columns = zip(*rows) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, type=pa.int64()) for n, c in zip(names, columns)}))


def in_files(rows: DataFrame, count: int) -> DataFrame:
    """As many partitions as ``count`` rows need files."""
    return rows.coalesce(-(-max(1, count) // FILE_ROWS))


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds ``end_id`` alone; a document of more
    than ``capacity`` ids is cut so that its first piece may be shorter; an empty table
    gives no rows; rows with one doc_id are packed each by itself; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialise(cut_pieces(docs, path, capacity, end_id), "pieces")
    by_size = lambda rows, size: {r[size]: r["count"] for r in rows.groupBy(size).count().collect()}  # noqa: E731  at most capacity rows
    left = by_size(cut, "length")
    if not left:
        return cut.select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"))
    pieces = materialise(ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], sum(left.values())), "ranked")
    gaps = spark.range(0).select(F.col("id").alias("sequence_id"), F.lit(0).cast("bigint").alias("used"), F.lit(capacity).cast("bigint").alias("gap"))
    taken, opened, placed, floors = dict.fromkeys(left, 0), 0, [], [capacity // 2, capacity // 4, 0]
    room: dict[int, int] = {}
    while left:
        band = {s: n for s, n in left.items() if s > floors[0]}
        if not band:
            floors.pop(0)
            continue
        runs = sweep(band, room, capacity // SHARE) or sweep(band, room, 1)
        if not runs:
            # As many as one size alone would take; small pieces mix, so for them what they fill, and a hundredth so that few are left over.
            more = math.ceil(sum(Fraction(n, capacity // s) if floors[0] else Fraction(101 * s * n, 100 * capacity) for s, n in band.items()))
            new = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(0).cast("bigint").alias("used"), F.lit(capacity).cast("bigint").alias("gap"))
            gaps, opened, room = gaps.unionByName(new), opened + more, room | {capacity: room.get(capacity, 0) + more}
            continue
        before = {g: sum(n for x, n in room.items() if x < g) for g in room}
        firsts = small_table(spark, list(before.items()), ["gap", "first"])
        places = ranked(gaps, "gap", ["sequence_id"], sum(room.values())).join(F.broadcast(firsts), "gap").withColumn("place", F.col("first") + F.col("rank")).drop("first", "rank")
        places = materialise(places, "gaps")
        plan = small_table(spark, [(*r, taken[r[0]]) for r in runs], ["length", "bundle", "bundles", "place", "taken"])
        nth = F.col("rank") - F.col("taken")
        items = pieces.join(F.broadcast(plan), "length").filter((nth >= 0) & (nth < F.col("bundle") * F.col("bundles")))
        items = items.withColumn("place", F.col("place") + F.floor(nth / F.col("bundle")).cast("bigint")).withColumn("within", nth % F.col("bundle") * F.col("length"))
        met = items.join(places, "place")
        put = met.select(*cut.columns, "sequence_id", (F.col("used") + F.col("within")).alias("offset"))
        placed.append(materialise(in_files(put, sum(bundle * n for _, bundle, n, _ in runs)), "placed"))
        for size, bundle, n, _ in runs:
            taken[size] += bundle * n
            left[size] -= bundle * n
        left = {s: n for s, n in left.items() if n}
        met_gaps = met_sizes(runs, before, room)
        took = F.broadcast(small_table(spark, met_gaps, ["gap", "low", "high", "took"]))
        inside = (places["gap"] == took["gap"]) & (places["place"] >= took["low"]) & (places["place"] < took["high"])
        shrunk = places.join(took, inside, "left").withColumn("used", F.col("used") + F.coalesce("took", F.lit(0)))
        least = min(left, default=capacity + 1)
        # A gap below the smallest piece that is left stays as it is. The runs tell the new sizes, so nothing is counted.
        gaps = shrunk.select("sequence_id", "used", (F.lit(capacity) - F.col("used")).alias("gap")).filter(F.col("gap") >= least)
        sizes = Counter(room)
        for gap, low, high, width in met_gaps:
            sizes[gap] -= high - low
            sizes[gap - width] += high - low
        room = {gap: n for gap, n in sizes.items() if n and gap >= least}
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return every
