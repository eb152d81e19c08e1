"""Near-duplicate documents by an LSH forest over MinHash signatures.

Texts become sets of word shingles; sets that are equal form one class, and everything
below works on classes. Each of ``TREES`` trees orders the classes by a tuple of minimum
hashes of its own.

* Neighbours: in ``ORDERS`` trees classes are range-sorted by ``DEPTH`` hashes. A row's
  neighbour in such an order has the longest common prefix with it of all rows; where
  that prefix holds ``BASE`` hashes or more, both are a candidate pair. So each row meets
  its likeliest partners, however many rows share its shorter prefixes, and confirmed
  links merge nearly all of every dense group for one pair a row and order.
* Regions: rows of a tree that share ``BASE`` hashes. Two sets of similarity s share a
  region with probability 1 - (1 - s^BASE)^TREES: at 0.75 about 2 pairs in a million
  don't. The depth at which a region is looked at adapts to it: a region whose rows the
  deeper prefixes have already put into one component is done; only those that still
  hold several are opened to their full width.
* An opened region is searched for links between its components, without loss: two
  sets of similarity 0.75 share one of the rarest quarter of their shingles, so only
  rows found by these are compared, in full. Regions that share their least component
  are searched together; where such a group is too large for a task regions are taken
  by themselves, and one that is still too large is cut into blocks, block against
  block over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import slices, spans, utf8
from lodestone.llm.common import materialise
from lodestone.llm.components import components
from lodestone.llm.hashing import GOLD, ODD, mix, range_hashes, run_hashes
from lodestone.llm.repeats import batched, word_bounds

TREES, BASE = 24, 3
#: Trees whose whole order is sorted, and the hashes of a row that sort it.
ORDERS, DEPTH = 8, 6
HASHES = TREES * BASE + ORDERS * (DEPTH - BASE)
#: Classes and shingles of a group that one task compares, about; larger groups are cut into blocks.
ROWS, UNITS = 10_000, 2_000_000
#: Shingles of candidates that are compared with a row at once, about.
STEP = 500_000
NULL_ID = 2**63 - 1
_RANDOM = np.random.default_rng(11)
FACTORS = _RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
#: Bytes of a row's key in a sorted order: the tree, then DEPTH hashes; the first PREFIX hold the tree and BASE hashes.
WIDTH, PREFIX = 1 + 4 * DEPTH, 1 + 4 * BASE


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text and sorted in each, and the bounds of the texts' sets."""
    data, bounds = utf8(batch)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    starts, ends = word_bounds(data, bounds)
    words = range_hashes(data, starts, ends)
    firsts = np.searchsorted(starts, bounds)
    count = np.diff(firsts)
    h, text = run_hashes(words, size), np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(words)) + size <= firsts[1:][text]
    h, text = h[whole], text[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for q in range(size):
            word = words[np.minimum(firsts[:-1][short] + q, len(words) - 1)]
            own = mix((own ^ np.where(q < count[short], word, 0).astype(np.uint64)) * ODD + GOLD)
        h, text = np.concatenate((h, mix(own ^ count[short].astype(np.uint64)))), np.concatenate((text, short))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))[: len(h)]
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hashes (HASHES x texts) of sets that are all non-empty."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(bounds) - 1), dtype=np.uint32)
    for k in range(HASHES):
        out[k] = np.minimum.reduceat(x * FACTORS[k] + SHIFTS[k], bounds[:-1])
    return out


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text, "doc_id").alias("row_hash"), text.alias("text"))


def signed(rows: DataFrame, size: int) -> DataFrame:
    """id, row_hash, n (set size), class and check (digests of the set), keys (of the base regions), orders (keys of the sorted orders); the last four null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            sets, bounds = shingle_sets(batch, size)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            m = len(full)
            sums = [np.add.reduceat(v, bounds[:-1][full]) if m else v[:0] for v in (mix(sets ^ GOLD), mix(sets * GOLD))]
            cls, check = (mix(s + n[full].astype(np.uint64) * GOLD).view(np.int64) for s in sums)
            sig = signatures(sets, np.append(bounds[:-1][full], len(sets))) if m else np.empty((HASHES, 0), dtype=np.uint32)
            keys = np.empty((m, TREES), dtype=np.uint64)
            orders = np.empty((m, ORDERS, WIDTH), dtype=np.uint8)
            for t in range(TREES):
                h = np.full(m, t, dtype=np.uint64) * GOLD
                for k in range(BASE):
                    h = mix((h + sig[t * BASE + k]) * GOLD)
                keys[:, t] = h
            for t in range(ORDERS):
                deeper = TREES * BASE + t * (DEPTH - BASE)
                own = np.concatenate((sig[t * BASE : (t + 1) * BASE], sig[deeper : deeper + DEPTH - BASE]))
                orders[:, t, 0] = t
                orders[:, t, 1:] = np.ascontiguousarray(own.T).astype(">u4").view(np.uint8).reshape(m, 4 * DEPTH)
            where = np.full(len(n), -1)
            where[full] = np.arange(m)
            at = pa.array(where, mask=where < 0)
            sorted_by = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), m * ORDERS, [None, pa.py_buffer(orders.tobytes())]).cast(pa.binary())
            lists = [pa.FixedSizeListArray.from_arrays(v, k).cast(pa.list_(v.type)) for v, k in ((pa.array(keys.ravel().view(np.int64)), TREES), (sorted_by, ORDERS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row_hash"), pa.array(n.astype(np.int64)), *(c.take(at) for c in (pa.array(cls), pa.array(check), *lists))],
                names=["id", "row_hash", "n", "class", "check", "keys", "orders"],
            )

    return rows.mapInArrow(run, "id bigint, row_hash bigint, n bigint, class bigint, check bigint, keys array<bigint>, orders array<binary>")


def neighbours(orders: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of classes that follow each other in a sorted order and share BASE hashes. ``orders``: order, class.

    The class sorts rows of equal hashes, so ranges can part them. Rows at the edge of a
    range miss one neighbour; what that loses, the regions find.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_class = np.full((1, PREFIX), 255, dtype=np.uint8), np.zeros(1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = batch.column("order").cast(pa.large_binary())
            at = np.frombuffer(order.buffers()[1], dtype=np.int64)[order.offset]
            key = np.frombuffer(order.buffers()[2], dtype=np.uint8)[at : at + batch.num_rows * WIDTH].reshape(-1, WIDTH)[:, :PREFIX]
            key = np.concatenate((last_key, key))
            cls = np.concatenate((last_class, batch.column("class").to_numpy()))
            near = np.flatnonzero((key[1:] == key[:-1]).all(axis=1))
            a, b = cls[near], cls[near + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])
            last_key, last_class = key[-1:].copy(), cls[-1:].copy()

    return orders.repartitionByRange("order", "class").sortWithinPartitions("order", "class").mapInArrow(run, "x bigint, y bigint").filter("x != y").distinct()


def with_sets(rows: DataFrame, uses: DataFrame, reps: DataFrame, size: int, schema: str) -> DataFrame:
    """``uses`` (class and the columns of ``schema`` but its last, own) with each class's full set, made once from its representative's text."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.strip().split(" ")[1]] for c in schema.split(",")]
    by_row = uses.join(reps, "class").groupBy("id", "row_hash").agg(F.collect_list(F.struct(*names[:-1])).alias("uses"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in slices(batches, 1 << 20):
                h, bounds = shingle_sets(batch, size)
                for a, b, wanted in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column("uses").to_pylist()):
                    own = h[a:b].tobytes()
                    for u in wanted:
                        yield *(u[c] for c in names[:-1]), own

        return batched(each(), names, types, 512)

    return rows.join(by_row.hint("shuffle_hash"), ["id", "row_hash"]).select("text", "uses").mapInArrow(run, schema)


def confirm(pairs: DataFrame, rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets A, B have 100 |A and B| >= percent |A or B|. No class is in more than 2 ORDERS pairs.

    Each set goes to where its pairs are compared: x's own with a null partner, y's with each x.
    """
    own = pairs.select(F.col("x").alias("class"), "x").distinct().withColumn("y", F.lit(None).cast("bigint"))
    shipped = with_sets(rows, pairs.select(F.col("y").alias("class"), "x", "y").unionByName(own), reps, size, "x bigint, y bigint, own binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked() -> Iterator[tuple]:
            key = base = None
            for batch in batches:
                for x, y, own in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "own"))):
                    values = np.frombuffer(own, dtype=np.uint64)
                    if y is None:
                        key, base = x, values
                        continue
                    assert key == x
                    both = np.concatenate((base, values))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        yield x, y

        return batched(linked(), ["x", "y"], [pa.int64(), pa.int64()])

    return shipped.repartition("x").sortWithinPartitions("x", F.asc_nulls_first("y")).mapInArrow(compare, "x bigint, y bigint")


def too_large(rows: str = "rows", units: str = "units"):
    return (F.col(rows) > ROWS) | (F.col(units) > UNITS)


def weighed(members: DataFrame, key: str) -> DataFrame:
    """key, rows and units (shingles) of groups."""
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("units"))


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """Members (label, class, component, n) of groups too large for a task, as members (label, part, class, component) of tasks.

    Blocks hold about half of what a task takes, of one band of sizes, either of the
    group's commonest component or of the others. Each block of others has a task with
    each block whose sizes can be linked with its own (parts 1 and 2), and one by itself
    (part 0), so any two rows of different components and fitting sizes meet in exactly one task.
    """
    # Linked sizes differ by a factor of 100 / percent at most, so bands of that width by one; the last factor covers rounding.
    width = max(1e-3, math.log(100 / percent)) * (1 + 1e-9)
    banded = members.select("label", "class", "component", "n", F.floor(F.log("n") / width).alias("band"))
    # These two tables have a few rows for each group that is too large for a task.
    common = materialise(banded.groupBy("label", "component").count().groupBy("label").agg(F.max_by("component", F.struct("count", "component")).alias("common")), "common")
    sided = banded.join(common, "label").withColumn("other", F.col("component") != F.col("common")).drop("common")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / max(1, ROWS // 2)), F.ceil(F.sum("n") / max(1, UNITS // 2)))
    cuts = materialise(sided.groupBy("label", "band", "other").agg(size.cast("bigint").alias("cuts")), "cuts")
    dealt = sided.join(cuts, ["label", "band", "other"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("cuts"))).drop("cuts")
    units = cuts.select("label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)).alias("block"), "band", "other")
    unit = F.struct("other", "band", "block")
    a, b = units.filter("other").select("label", unit.alias("a")), units.select("label", unit.alias("b"))
    # Blocks of others sort behind the rest, so b < a leaves out only the second task of two blocks of others.
    tasks = a.join(b, "label").filter("abs(a.band - b.band) <= 1 AND (NOT b.other OR a <= b)").withColumn("task", F.xxhash64("label", "a", "b"))
    both = F.array(F.struct(F.lit(1).alias("part"), F.col("a").alias("unit")), F.struct(F.lit(2).alias("part"), F.col("b").alias("unit")))
    itself = F.array(F.struct(F.lit(0).alias("part"), F.col("a").alias("unit")))
    sides = tasks.select("label", "task", F.explode(F.when(F.expr("a = b"), itself).otherwise(both)).alias("s")).select("label", "task", "s.part", "s.unit.*")
    return dealt.join(sides, ["label", "band", "other", "block"]).select(F.col("task").alias("label"), "part", "class", "component")


class Group:
    """Classes of one group: components and sets; links are found between components, but not between two rows of part 1 or 2."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]], percent: int):
        """rows: class, component, part, set."""
        self.cls, self.percent = [r[0] for r in rows], percent
        self.root = np.unique([r[1] for r in rows], return_inverse=True)[1]
        self.part = np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        self.n = np.array([len(v) for v in sets], dtype=np.int64)
        self.first = np.cumsum(self.n) - self.n
        row = np.repeat(np.arange(len(rows)), self.n)
        _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles by rising frequency; each row's in that order, so its rarest come first.
        rarity = np.empty(len(count), dtype=np.int64)
        rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
        own = rarity[shingle]
        self.shingle = own[np.lexsort((own, row))]
        # Two linked sets share one of the first n - ceil(percent n / 100) + 1 shingles of both.
        self.prefix = self.n + (-percent * self.n) // 100 + 1
        at = spans(self.first, self.prefix)
        by = np.argsort(self.shingle[at], kind="stable")
        self.posted = np.repeat(np.arange(len(rows)), self.prefix)[by]
        listed = self.shingle[at][by]
        self.begin = np.searchsorted(listed, np.arange(len(count)))
        self.length = np.bincount(listed, minlength=len(count))
        self.mark = np.zeros(len(count), dtype=bool)

    def candidates(self, k: int) -> np.ndarray:
        """Rows that share a rare shingle with row k, those with most first."""
        rare = self.shingle[self.first[k] : self.first[k] + self.prefix[k]]
        shared = np.bincount(self.posted[spans(self.begin[rare], self.length[rare])], minlength=len(self.n))
        found = np.flatnonzero(shared)
        return found[np.argsort(-shared[found], kind="stable")]

    def linked(self, k: int, some: np.ndarray) -> np.ndarray:
        """Which rows of ``some`` are linked with row k (marked), by their full sets."""
        size = self.n[some]
        hits = self.mark[self.shingle[spans(self.first[some], size)]]
        shared = np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)
        return 100 * shared >= self.percent * (size + self.n[k] - shared)

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that connect components: each pair of rows of different ones is ruled out, compared, or connected already."""
        rare = np.flatnonzero(self.root != np.bincount(self.root).argmax())
        rank = np.full(len(self.n), -1)
        rank[rare] = np.arange(len(rare))
        for k in rare.tolist():
            some = self.candidates(k)
            fits = (100 * np.minimum(self.n[some], self.n[k]) >= self.percent * np.maximum(self.n[some], self.n[k])) & (rank[some] < rank[k])
            some = some[fits & ((self.part[some] == 0) | (self.part[some] != self.part[k]))]
            own = self.shingle[self.first[k] : self.first[k] + self.n[k]]
            self.mark[own] = True
            take = 8
            while len(some := some[self.root[some] != self.root[k]]):
                now, some = some[:take], some[take:]
                for j in now[self.linked(k, now)].tolist():
                    if self.root[j] != self.root[k]:
                        yield min(self.cls[j], self.cls[k]), max(self.cls[j], self.cls[k])
                        self.root[self.root == self.root[j]] = self.root[k]
                take = int(max(8, min(8 * take, STEP // max(1, self.n[k]))))
            self.mark[own] = False


def across(members: DataFrame, rows: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (x, y) that connect components inside groups. members: label, part, class, component; texts come by the representatives."""
    names = ["label", "class", "component", "part", "own"]
    shipped = with_sets(rows, members, reps, size, "label bigint, class bigint, component bigint, part int, own binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple]:
            label, group = None, []
            for batch in batches:
                for k, *row in zip(*(batch.column(c).to_pylist() for c in names)):
                    if k != label:
                        if len(group) > 1:
                            yield from Group(group, percent).links()
                        label, group = k, []
                    group.append(tuple(row))
            if len(group) > 1:
                yield from Group(group, percent).links()

        return batched(links(), ["x", "y"], [pa.int64(), pa.int64()])

    return shipped.repartition("label").sortWithinPartitions("label").mapInArrow(search, "x bigint, y bigint").distinct()


def opened(known: DataFrame, percent: int) -> DataFrame:
    """label, part, class, component of the groups to search. known: key (of a region), class, n, component."""
    several = known.groupBy("key").agg(F.min("component").alias("label"), F.max("component").alias("high")).filter("label != high")
    several = materialise(several.select("key", "label"), "mixed")
    regions = materialise(known.join(several, "key").distinct(), "regions")
    together = materialise(regions.select("label", "class", "component", "n").distinct(), "together")
    sizes = materialise(weighed(together, "label").filter(too_large()).select("label"), "crowds")
    out = together.join(sizes, "label", "left_anti").select("label", F.lit(0).alias("part"), "class", "component")
    if sizes.limit(1).count():
        alone = materialise(regions.join(sizes, "label", "left_semi").select(F.col("key").alias("label"), "class", "component", "n"), "alone")
        large = materialise(weighed(alone, "label").filter(too_large()).select("label"), "crowds")
        fit = alone.join(large, "label", "left_anti").select("label", F.lit(0).alias("part"), "class", "component")
        out = out.unionByName(fit).unionByName(blocks(alone.join(large, "label", "left_semi"), percent))
    return materialise(out, "members")


def labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, row_hash, n (set size), component_id and stays (whether the row is the one of its component that stays) of each row; null ids are NULL_ID."""
    rows = keyed(docs)
    sig = materialise(signed(rows, size), "signatures")
    classes = materialise(sig.filter("n > 0").groupBy("class", "check", "n").agg(F.min(F.struct("id", "row_hash")).alias("rep")), "classes")
    reps = classes.select("class", "rep.id", "rep.row_hash")
    of_reps = sig.select("id", "row_hash", "class", "n", "keys", "orders").join(reps, ["class", "id", "row_hash"])

    pairs = materialise(neighbours(of_reps.select(F.explode("orders").alias("order"), "class")), "pairs")
    roots = components(materialise(confirm(pairs, rows, reps, size, percent), "links"))

    in_tree = of_reps.select("class", "n", F.explode("keys").alias("key"))
    of = roots.withColumnRenamed("node", "class")
    known = materialise(in_tree.join(of, "class", "left").select("key", "class", "n", F.coalesce("root", "class").alias("component")), "known")
    more = materialise(across(opened(known, percent), rows, reps, size, percent), "links")
    roots = components(roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more))

    of = roots.withColumnRenamed("node", "class")
    of_class = materialise(classes.join(of, "class", "left").select("class", "check", "rep", F.coalesce("root", "class").alias("component")), "of-class")
    least = materialise(of_class.groupBy("component").agg(F.min("rep").alias("least")), "least")
    labels = materialise(of_class.join(least, "component").select("class", "check", "least"), "labels")
    own = sig.select("id", "row_hash", "n", F.coalesce("class", F.lit(0)).alias("c"), F.coalesce("check", F.lit(0)).alias("k"))
    joined = own.join(labels, (F.col("c") == F.col("class")) & (F.col("k") == F.col("check")) & (F.col("n") > 0), "left")
    stays = (F.col("least.id") == F.col("id")) & (F.col("least.row_hash") == F.col("row_hash"))
    return joined.select("id", "row_hash", "n", F.coalesce("least.id", "id").alias("component_id"), F.coalesce(stays, F.lit(True)).alias("stays"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Sets hold the distinct runs of ``size`` words (ASCII letters lower-cased), or the whole
    sequence of a shorter text; null and blank texts have empty sets and are linked with
    nothing. Rows with equal sets, repeated rows too, are linked. component_id is the
    least doc_id of the linked rows; null ids never are it unless all are null.
    kept marks the rows with that id. Empty tables give no rows; other columns are ignored.
    """
    back = lambda c: F.when(c != NULL_ID, c)
    return labelled(docs, size, percent).select(
        back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.col("component_id")).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each group of near-duplicates has one: that with the least doc_id (then row hash).

    Cases as in near_duplicates; rows with empty sets all stay, a null id stays only where
    the whole group has null ids, and of rows that share an id only the one that stays does. Rows equal in id and text
    stay or go together (exact dedup reduces them to one before).
    """
    stay = labelled(docs, size, percent).filter("stays").select(F.col("id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({"__of": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), "__row": F.xxhash64(text, "doc_id")})
    return own.join(materialise(stay, "stay"), (F.col("__of") == F.col("__id")) & (F.col("__row") == F.col("__hash")), "left_semi").drop("__of", "__row")
