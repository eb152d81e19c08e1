"""Exact search for windows of ``length`` units (bytes or words) that start more than once in a corpus.

Shared by the two substring operators; each brings its own solver for groups of suffixes.

1. Every window has an anchor: the unit ``gram`` of least hash inside it (leftmost on
   ties). Equal windows have equal anchors at equal distance, so windows can only be
   equal inside one anchor key, the prefix of the suffix that starts at the anchor. A
   text has far fewer anchors than windows; for each, a row holds the key, the run of
   windows that it serves, and a digest of their content.
2. Counting rows a key (aggregated before the shuffle) drops anchors that occur once.
   Rows of one key whose runs are wholly equal are one leaf with several owners: all
   their windows repeat, and one of them stands for them below.
3. Keys with more than ``HOT`` different runs don't fit one group: their prefixes grow,
   first to half a window and a gram (a window that has less than that after its anchor
   has as much before it, and is keyed by that side), and where that isn't enough to the
   window's whole length, where a prefix that two windows share needs no further look.
4. What is left meets by its prefix: contents of one key's different runs go to the
   solver, many small groups to a block of bounded size.
5. Each document's spans are applied to its text.

Nothing but the final lists of a document's own spans is ever gathered in one row.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import slices, spans, utf8
from lodestone.llm.common import materialise
from lodestone.llm.hashing import GOLD, ODD, digest, eights, mix, range_hashes, run_hashes

#: Different runs of one key that are compared in one task at most.
HOT = 512
#: Bytes of content in a solver's block, about.
BLOCK_BYTES = 4 << 20
#: Windows whose anchors are found at once; positions inside a stretch fit the low bits of the hashes.
STRETCH = 1 << 21
#: Rows of one Arrow batch that carries contents or digests.
ROWS = 4096
LOW = np.uint64((1 << 24) - 1)
REF = ["id", "row_hash"]


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of texts laid end to end."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before, after = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    return np.flatnonzero(solid & (before | edge[:-1])), np.flatnonzero(solid & (after | edge[1:])) + 1


def single_spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space in place of the white space after a word, and none before the first; equal word runs have equal bytes then."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    keep[inner] = solid[inner]
    moved = np.concatenate(([0], np.cumsum(keep)))
    return np.where(solid, data, 32).astype(np.uint8)[keep], moved[bounds]


@dataclass
class Unit:
    """What a window is made of."""

    words: bool
    length: int
    gram: int

    @property
    def half(self) -> int:
        """Units of the longer prefixes: on one side of the anchor or the other, every window has as many."""
        return (self.length + 1 + self.gram) // 2

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Bytes of all texts end to end (words with single spaces), each text's first unit (and the total), byte starts and ends of words."""
        data, bounds = utf8(batch)
        if not self.words:
            none = np.empty(0, dtype=np.int64)
            return data, bounds, (none, none)
        data, bounds = single_spaced(data, bounds) if len(data) else (data, bounds)
        starts, ends = word_bounds(data, bounds)
        return data, np.searchsorted(starts, bounds), (starts, ends)

    def grams(self, data: np.ndarray, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if self.words:
            return run_hashes(range_hashes(data, *places), self.gram)
        n = len(data)
        eight = eights(np.concatenate((data, np.zeros(self.gram, dtype=np.uint8))))
        h = np.zeros(n, dtype=np.uint64)
        for q in range(0, self.gram, 8):
            h = mix((h ^ eight[q : q + n]) * ODD + GOLD)
        return h

    def content(self, raw: bytes, places: tuple[np.ndarray, np.ndarray], first: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        """The bytes of non-empty unit ranges [first, end)."""
        a, b = (places[0][first], places[1][end - 1]) if self.words else (first, end)
        return (raw[x:y] for x, y in zip(a.tolist(), b.tolist()))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of blocks."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.full(-len(x) % width, 2**64 - 1, dtype=np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(unit: Unit, grams: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Anchor rows of texts laid end to end: text, key, p, a, b (anchor, first and last window, as units of all texts).

    Windows are looked at ``STRETCH`` at a time; where a stretch ends within a run, the run is cut (then its digest can't
    settle it, and it is compared in full).
    """
    parts = [{k: np.empty(0, dtype=np.int64) for k in ("text", "key", "p", "a", "b")}]
    text_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for at in range(0, len(grams) - unit.length + 1, STRETCH):
        n = min(STRETCH, len(grams) - unit.length + 1 - at)
        some = grams[at : at + n + unit.length - unit.gram]
        least = sliding_min((some & ~LOW) | np.arange(len(some), dtype=np.uint64), unit.length - unit.gram + 1)
        start = np.flatnonzero(np.arange(at, at + n) + unit.length <= firsts[1:][text_of[at : at + n]])
        if not len(start):
            continue
        p, text = (least[start] & LOW).astype(np.int64) + at, text_of[at + start]
        start += at
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (text[1:] != text[:-1]))))
        a, b, p, text = start[new], start[np.append(new[1:], len(start)) - 1], p[new], text[new]
        parts.append({"text": text, "key": grams[p].view(np.int64), "p": p, "a": a, "b": b})
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def run_digests(own: Iterator[bytes], distance: np.ndarray) -> np.ndarray:
    """Digest of each run's content and of the anchor's distance from its start."""
    seg = np.fromiter(map(digest, own), dtype=np.int64, count=len(distance))
    return mix(seg.view(np.uint64) ^ mix(distance.astype(np.uint64) * GOLD)).view(np.int64)


def batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    out: list[tuple] = []

    def cut() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield cut()
            out = []
    yield cut()


def lcp(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # the first difference lies in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def reach(contexts: list[bytes], width: int) -> list[int]:
    """For each context the longest prefix (in units) that it shares with another: its neighbours' in sorted order."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    out, last = [0] * len(contexts), 0
    for i, j in zip(order, order[1:]):
        own = lcp(contexts[i], contexts[j]) // width
        out[i], last = max(last, own), own
    out[order[-1]] = last
    return out


Solver = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


class Blocks:
    """Collects whole groups and finds, for their unsettled rows, the windows that occur in another row."""

    def __init__(self, unit: Unit, solve: Solver):
        self.unit, self.solve, self.rows, self.size = unit, solve, [], 0

    def add(self, group: list[tuple]) -> None:
        """group: rows (ref, mine, a, windows, distance of the anchor, content) of one key."""
        self.rows.append(group)
        self.size += sum(len(r[5]) for r in group)

    def _units(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.concatenate(([0], np.cumsum([len(c) for c in contents]))).astype(np.int64)
        data = np.frombuffer(b"".join(contents), dtype=np.uint8)
        if not self.unit.words:
            return data, bounds
        starts, ends = word_bounds(data, bounds)
        return range_hashes(data, starts, ends), np.searchsorted(starts, bounds)

    def flush(self) -> Iterator[tuple]:
        """(ref, first unit, end) of repeated spans."""
        groups, self.rows, self.size = self.rows, [], 0
        if not groups:
            return
        every = [r for g in groups for r in g]
        values, bounds = self._units([r[5] for r in every])
        width, length = values.itemsize, self.unit.length
        raw = values.tobytes()
        k, asked, owners = 0, [], []
        for n, group in enumerate(groups):
            right, left = [], []
            for i, r in enumerate(group, k):
                at = int(bounds[i]) + r[4]
                right.append(raw[at * width : int(bounds[i + 1]) * width])
                left.append(values[int(bounds[i]) : at][::-1].tobytes())
            r_reach, l_reach = reach(right, width), reach(left, width)
            for i, (r, rr, lr) in enumerate(zip(group, r_reach, l_reach), k):
                first, last = max(0, r[4] - lr), min(r[3] - 1, r[4] + rr - length)
                if first > last:
                    continue
                asked.append((int(bounds[i]) + first, last - first + 1, n))
                owners.append((r, first))
            k += len(group)
        if not asked:
            return
        base, count, group_of = (np.array(c, dtype=np.int64) for c in zip(*asked))
        repeated = self.solve(values, spans(base, count), np.repeat(group_of, count), length)
        ends = np.cumsum(count)
        for (r, first), e, n in zip(owners, ends.tolist(), count.tolist()):
            if r[1] and (hit := np.flatnonzero(repeated[e - n : e])).size:
                cut = np.flatnonzero(np.diff(hit) > 1)
                for s, t in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()):
                    yield r[0], r[2] + first + s, r[2] + first + t + length


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Union of ranges, ordered; ranges that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """id, row_hash, text and the columns ``carry`` (as one struct) of ``docs``.

    id and row_hash tell rows apart, null and repeated ids too; rows of equal id and text share them and their result.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(text, "doc_id").alias("row_hash"),
        text.alias("text"),
        F.struct(*(F.col(c) for c in carry)).alias("row"),
    )


def repeated_spans(rows: DataFrame, unit: Unit, solve: Solver) -> DataFrame:
    """id, row_hash, starts, ends: spans (in units, may overlap) covered by windows that start more than once.

    ``rows``: id, row_hash, text. Rows without such windows are missing.
    """
    length, half, gram = unit.length, unit.half, unit.gram
    text = rows.select(*REF, "text")
    run_names, run_types = [*REF, "key", "seg", "p", "a", "b", "mine"], [*[pa.int64()] * 4, *[pa.int32()] * 3, pa.bool_()]
    run_schema = "id bigint, row_hash bigint, key bigint, seg bigint, p int, a int, b int, mine boolean"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            data, firsts, places = unit.read(batch)
            got = anchors(unit, unit.grams(data, places), firsts)
            seg = run_digests(unit.content(data.tobytes(), places, got["a"], got["b"] + length), got["p"] - got["a"])
            row, zero = pa.array(got["text"]), firsts[:-1][got["text"]]
            columns = [batch.column("id").take(row), batch.column("row_hash").take(row), pa.array(got["key"]), pa.array(seg)]
            columns += [pa.array((got[c] - zero).astype(np.int32)) for c in "pab"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(zero), dtype=bool))], names=run_names)

    def listed(found: DataFrame) -> DataFrame:
        """id, row_hash, runs: of keys that occur more than once. kind: 0 settled, 1 unsettled, 2 settled but shown to unsettled ones; + 4 for hot keys."""
        several = materialise(found.groupBy("key").count().filter("count > 1").select("key"), "keys")
        live = materialise(found.join(several, "key", "left_semi"), "live")
        by_run = materialise(live.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("alike"), F.min(F.struct(*REF, "a")).alias("one")), "runs")
        by_key = materialise(by_run.groupBy("key").agg(F.count(F.lit(1)).alias("runs")), "by-key")
        per_run = materialise(by_run.join(by_key, "key"), "runs")
        stands = F.struct(*REF, "a") == F.col("one")
        kind = F.when(F.col("alike") == 1, 1).when(stands & (F.col("runs") > 1), 2).otherwise(0) + F.when(F.col("runs") > HOT, 4).otherwise(0)
        run = F.struct("key", "p", "a", "b", kind.alias("kind"), "mine")
        # A set, so that repeated rows (equal id and text) share one list of the length of one text.
        return materialise(live.join(per_run, ["key", "seg"]).select(*REF, run.alias("run")).groupBy(*REF).agg(F.collect_set("run").alias("runs")), "anchors")

    def chosen(lists: DataFrame, wanted: Callable) -> DataFrame:
        """The texts that have wanted runs, with these; every row (id, row_hash) once."""
        todo = lists.select(*REF, F.filter("runs", wanted).alias("runs")).filter(F.size("runs") > 0)
        return text.join(todo.hint("shuffle_hash"), REF)

    def each_run(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
        """The block's bytes, word places, and for each run: id, row_hash, the run, its text's first unit."""
        for batch in slices(batches, size):
            data, firsts, places = unit.read(batch)
            raw = data.tobytes()
            for i, h, runs, zero in zip(*(batch.column(c).to_pylist() for c in (*REF, "runs")), firsts.tolist()):
                for r in runs:
                    yield raw, places, i, h, r, zero

    def piece(raw: bytes, places: tuple, first: int, end: int) -> bytes:
        return raw[places[0][first] : places[1][end - 1]] if unit.words else raw[first:end]

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            for raw, places, i, h, r, zero in each_run(batches, 1 << 20):
                own = piece(raw, places, zero + r["a"], zero + r["b"] + length)
                yield i, h, r["key"], r["mine"] and r["kind"] == 1, (r["a"] << 32) | (r["p"] - r["a"]), r["b"] - r["a"] + 1, own

        return batched(cut(), [*REF, "key", "mine", "at", "windows", "content"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans_of() -> Iterator[tuple]:
            blocks, key, group, seen = Blocks(unit, solve), None, [], set()
            for batch in batches:
                for i, h, k, mine, at, windows, content in zip(*(batch.column(c).to_pylist() for c in (*REF, "key", "mine", "at", "windows", "content"))):
                    if k != key:
                        if len(group) > 1:
                            blocks.add(group)
                        key, group, seen = k, [], set()
                        if blocks.size > BLOCK_BYTES:
                            yield from blocks.flush()
                    if (i, h, at) not in seen:  # repeated rows come several times
                        seen.add((i, h, at))
                        group.append(((i, h), mine, at >> 32, windows, at & 0xFFFFFFFF, content))
            if len(group) > 1:
                blocks.add(group)
            yield from blocks.flush()

        return batched(((*ref, s, e) for ref, s, e in spans_of()), [*REF, "s", "e"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    def lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs keyed by ``half`` units: from the anchor on, or up to its end for windows that have fewer after it."""

        def grown() -> Iterator[tuple]:
            for raw, places, i, h, r, zero in each_run(batches, 1 << 20):
                p, cut = zero + r["p"], zero + r["p"] - (length - half)
                mine = r["mine"] and r["kind"] == 5
                sides = (max(zero + r["a"], cut), zero + r["b"], p, p + half, b">"), (zero + r["a"], min(zero + r["b"], cut - 1), cut - 1, p + gram, b"<")
                for a, b, first, end, side in sides:
                    if a <= b:
                        seg = digest(struct.pack("<q", p - a) + piece(raw, places, a, b + length))
                        yield i, h, digest(side + piece(raw, places, first, end)), seg, r["p"], a - zero, b - zero, mine

        return batched(grown(), run_names, run_types)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows keyed by their whole length (128 bits)."""

        def windows() -> Iterator[tuple]:
            for raw, places, i, h, r, zero in each_run(batches, 1 << 20):
                for w in range(r["a"], r["b"] + 1):
                    own = piece(raw, places, zero + w, zero + w + length)
                    yield i, h, w, r["mine"] and r["kind"] == 5, *struct.unpack("<qq", hashlib.blake2b(own, digest_size=16).digest())

        return batched(windows(), [*REF, "s", "mine", "h1", "h2"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()])

    parts, hot = [], None
    for level in ("gram", "half"):
        source, cut = (text, find) if hot is None else (hot, lengthened)
        lists = listed(materialise(source.mapInArrow(cut, run_schema), f"found-{level}"))
        done = F.filter("runs", lambda r: r["mine"] & ((r["kind"] % 4) != 1))
        parts.append(lists.select(*REF, done.alias("runs")).select(*REF, F.transform("runs", lambda r: r["a"]).alias("starts"), F.transform("runs", lambda r: r["b"] + length).alias("ends")))
        shipped = chosen(lists, lambda r: (r["kind"] == 1) | (r["kind"] == 2)).mapInArrow(
            contents, "id bigint, row_hash bigint, key bigint, mine boolean, at bigint, windows int, content binary"
        )
        compared = shipped.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "id bigint, row_hash bigint, s int, e int")
        parts.append(compared.groupBy(*REF).agg(F.collect_list("s").alias("starts"), F.collect_list("e").alias("ends")))
        hot = chosen(lists, lambda r: (r["kind"] == 5) | (r["kind"] == 6))
        if not lists.filter(F.exists("runs", lambda r: (r["kind"] == 5) | (r["kind"] == 6))).limit(1).count():
            break
    else:
        windows = hot.mapInArrow(whole, "id bigint, row_hash bigint, s int, mine boolean, h1 bigint, h2 bigint")
        twice = materialise(windows.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"), "windows")
        repeated = windows.filter("mine").join(twice, ["h1", "h2"]).groupBy(*REF).agg(F.collect_set("s").alias("starts"))
        parts.append(repeated.select(*REF, "starts", F.transform("starts", lambda s: s + length).alias("ends")))

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*REF).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def remove_repeats(docs: DataFrame, unit: Unit, solve: Solver, carry: list[str]) -> DataFrame:
    """row (a struct of the columns ``carry``), n_units, n_removed, n_spans, kept_sha256 and text (what is left; bytes that are no whole character read U+FFFD)."""
    rows = keyed(docs, carry)
    found = repeated_spans(rows, unit, solve)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, firsts, (starts, ends) = unit.read(batch)
            raw = data.tobytes()
            out: tuple[list, ...] = ([], [], [], [])
            for first, end, s, e in zip(firsts[:-1].tolist(), firsts[1:].tolist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
                n, removed = end - first, merged(s or [], e or [])
                gaps = [(first + x, first + y) for x, y in zip([0] + [y for _, y in removed], [x for x, _ in removed] + [n]) if x < y]
                kept = b" ".join(raw[starts[x] : ends[y - 1]] for x, y in gaps) if unit.words else b"".join(raw[x:y] for x, y in gaps)
                for column, value in zip(out, (n, sum(y - x for x, y in removed), len(removed), kept)):
                    column.append(value)
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in out[3]], pa.string())
            left = pa.array([k.decode("utf-8", "replace") for k in out[3]], pa.string())
            columns = [pa.array(c, pa.int64()) for c in out[:3]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, sha, left], names=["row", "n_units", "n_removed", "n_spans", "kept_sha256", "text"])

    joined = rows.join(found.hint("shuffle_hash"), REF, "left")
    schema = joined.select("row").schema
    for name, kind in (("n_units", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("text", "string")):
        schema = schema.add(name, kind)
    return joined.select("row", "text", "starts", "ends").mapInArrow(apply, schema)
