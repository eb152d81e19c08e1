"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A short word is held as a contiguous array of parts (one a byte at first) beside the
ranks of its adjacent pairs. Repeatedly: find the smallest rank, delete the boundary
between its two parts, refresh the two neighbouring ranks; stop when no pair has a
rank. Words are merged in blocks, one word a row, so each step is a few numpy calls
over all words of a block. Words seen before come from a bounded two-generation cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.hashing import GOLD, SHORT, mix, packed

#: Fixed value: the pattern that cuts texts into words before merging (that of the vocabulary files).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Longer words are merged one by one in a heap-free list, so that a block stays small.
LONG = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, pair ranks and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, path: str):
        data = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        raw = lambda token: bytes(of_letter[c] for c in token)
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int32)
        keys, ranks, merged = [], [], []
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] << 32 | vocab[b])
            ranks.append(rank)
            merged.append(vocab[a + b])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks, self.merged = np.array(ranks, dtype=np.int32)[order], np.array(merged, dtype=np.int32)[order]
        # Direct-mapped table over the pairs; slots that several pairs share send the lookup to the sorted keys.
        self.bits = 20
        slot = self._slot(self.keys)
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(self.keys), dtype=np.int32)
        shared = np.bincount(slot, minlength=1 << self.bits) > 1
        self.table[shared] = -2
        self.by_rank = self.merged[np.argsort(self.ranks)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids; NONE where they don't merge (id -1: no part)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = self.table[self._slot(key)]
        if (odd := at == -2).any():
            at[odd] = np.minimum(np.searchsorted(self.keys, key[odd]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_block(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``parts``: a word a column, its byte tokens downwards, -1 below its end. Returns merged parts and their number a word."""
        width, n = parts.shape
        ranks = np.full((width, n), NONE, dtype=np.int32)
        for c in range(width - 1):
            if (two := parts[c + 1] >= 0).any():
                ranks[c, two] = self.rank(parts[c, two], parts[c + 1, two])
        done = np.empty_like(parts)
        live = np.arange(n)
        while len(live):
            best = ranks.min(axis=0)
            going = best != NONE
            if not going.all():
                done[:, live[~going]] = parts[:, ~going]
                live, best = live[going], best[going]
                parts, ranks = parts[:, going], ranks[:, going]
                if not len(live):
                    break
            j = np.zeros(len(live), dtype=np.int64)
            for c in range(width - 2, 0, -1):
                j[ranks[c] == best] = c
            j[ranks[0] == best] = 0
            # The boundary below part j goes: what follows moves one place up.
            for c in range(width - 1):
                after = j < c
                np.copyto(parts[c], parts[c + 1], where=after)
                np.copyto(ranks[c], ranks[c + 1], where=after)
            parts[-1], ranks[-1] = -1, NONE
            at = np.arange(len(live))
            new = self.by_rank[best]
            parts[j, at] = new
            below = parts[np.minimum(j + 1, width - 1), at]
            ranks[j, at] = np.where(below >= 0, self.rank(new, below), NONE)
            has = np.flatnonzero(j)
            ranks[j[has] - 1, has] = self.rank(parts[j[has] - 1, has], new[has])
        return done, (done >= 0).sum(axis=0)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merging for one long word, on arrays of its own; boundaries of one rank go together, left to right."""
        parts = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        while len(parts) > 1:
            ranks = self.rank(parts[:-1], parts[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # overlapping pairs (aaa): every other one of a run
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1)))
                first = at[np.concatenate(([True], np.diff(run) != 0))][run - 1]
                at = at[(at - first) % 2 == 0]
            parts[at] = self.by_rank[best]
            parts = np.delete(parts, at + 1)
        return parts


def classes() -> np.ndarray:
    """Kind of each code point as the pattern sees it: 0 other, 1 letter, 2 number, 3 white space, 4 the space itself."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            kind[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
    kind[0xD800:0xE000] = 0
    kind[32] = 4
    return kind


_KIND: list[np.ndarray] = []
CONTRACTIONS = tuple(b"'" + x for x in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"))


def word_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Byte offsets where the pattern begins a word, in texts laid end to end (each begins at one of ``doc_starts``)."""
    if not _KIND:
        _KIND.append(classes())
    n = len(data)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[lead].astype(np.int32)
    if (wide := b0 >= 0xC0).any():
        at = lead[wide]
        c1, c2, c3 = (data[np.minimum(at + k, n - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3))
        h = b0[wide]
        b0[wide] = np.where(h < 0xE0, (h & 0x1F) << 6 | c1, np.where(h < 0xF0, (h & 0xF) << 12 | c1 << 6 | c2, ((h & 7) << 18 | c1 << 12 | c2 << 6 | c3) & 0x1FFFFF))
    kind = _KIND[0][b0]
    blank = kind >= 3
    group = np.minimum(kind, 3)
    first = np.zeros(len(lead) + 1, dtype=bool)
    first[np.searchsorted(lead, doc_starts)] = True
    first = first[:-1]
    before = np.concatenate(([9], kind[:-1]))
    before[first] = 9
    begins = np.concatenate(([True], group[1:] != group[:-1])) & (before != 4) | first
    # Inside a run of white space only its last character begins a word, and only if more text follows.
    last_blank = np.zeros(len(lead), dtype=bool)
    last_blank[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    begins |= last_blank
    # A space before the run's end took "before == 4" above for blank followers as well: they begin none.
    begins &= ~(blank & (before >= 3) & (before != 9) & ~last_blank & ~first)
    starts_b = np.zeros(n + 1, dtype=bool)
    starts_b[lead[begins]] = True
    marks = lead[(b0 == 39) & begins]
    for a in marks.tolist():
        tail = data[a : a + 3].tobytes()
        for c in CONTRACTIONS:
            if tail.startswith(c):
                end = min(a + len(c), n)
                k = np.searchsorted(doc_starts, a, side="right")
                if k < len(doc_starts) and doc_starts[k] < end:
                    break
                starts_b[a + 1 : end] = False
                starts_b[end] = True
                break
    return np.flatnonzero(starts_b[:n])


def spans(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [offset, offset + length) one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Encoder:
    """Exact encoder over whole texts with a bounded cache of words.

    Texts of a block are cut into words at once and equal words are merged once; words of
    recent blocks come from the cache. Words of up to SHORT bytes are told apart by their
    bytes in two numbers; the sort goes by a hash of them, and words whose hash belongs
    to another word are treated like longer ones, which a dictionary of bytes holds.
    """

    def __init__(self, vocabulary: Vocabulary, cached: int = 300_000):
        self.vocabulary, self.cached = vocabulary, cached
        self.special = {s.encode(): i for s, i in vocabulary.special.items()}
        self.keys = self.low = self.high = np.empty(0, dtype=np.uint64)
        self.at = self.size = np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.int32)
        self.others: dict[bytes, np.ndarray] = {}

    def _merge(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        pieces, counts, order = [], [], []
        for low, high in ((1, 6), (7, 9), (10, 13), (14, 20), (21, LONG)):
            chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
            for k in range(0, len(chosen), 16384):
                some = chosen[k : k + 16384]
                size = lengths[some]
                width = int(size.max()) + 1
                depth = np.arange(width)[:, None]
                inside = depth < size
                parts = np.where(inside, self.vocabulary.byte_ids[data[np.minimum(starts[some] + depth, len(data) - 1)]], -1).astype(np.int32)
                merged, count = self.vocabulary.merge_block(parts)
                pieces.append(merged.T[np.arange(width) < count[:, None]])
                counts.append(count)
                order.append(some)
        for w in np.flatnonzero(lengths > LONG).tolist():
            got = self.vocabulary.merge_long(data[starts[w] : starts[w] + lengths[w]].tobytes())
            pieces.append(got)
            counts.append(np.array([len(got)]))
            order.append(np.array([w]))
        count, where = np.concatenate(counts), np.concatenate(order)
        offset = np.cumsum(count) - count
        n, at = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
        n[where], at[where] = count, offset
        return np.concatenate(pieces)[spans(at, n)], n

    def _by_bytes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different words one after another; for each word where its ids begin and how many it has."""
        if len(self.others) > self.cached // 8:
            self.others.clear()
        raw, ends = data.tobytes(), starts + lengths
        names = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        place = {w: k for k, w in enumerate(names)}  # different words, and where one of each stands
        fresh = np.array([k for w, k in place.items() if w not in self.others], dtype=np.int64)
        if len(fresh):
            ids, n = self._merge(data, starts[fresh], lengths[fresh])
            for k, own in zip(fresh.tolist(), np.split(ids, np.cumsum(n)[:-1])):
                self.others[names[k]] = own
        own = [self.others[w] for w in place]
        size = np.array([len(x) for x in own], dtype=np.int64)
        rank = dict(zip(place, range(len(own))))
        of = np.array([rank[w] for w in names], dtype=np.int64)
        return np.concatenate(own), (np.cumsum(size) - size)[of], size[of]

    def _block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and where each text's ids end."""
        texts = np.flatnonzero(np.diff(bounds))
        starts = word_starts(data, bounds[:-1][texts])
        lengths = np.diff(np.append(starts, len(data)))
        short = np.flatnonzero(lengths <= SHORT)
        low, high = packed(data, starts[short], lengths[short])
        key = mix(low ^ mix(high * GOLD))
        order = np.argsort(key)
        word, low, high, key = short[order], low[order], high[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        group, one = np.cumsum(new) - 1, np.flatnonzero(new)
        odd = (low != low[one][group]) | (high != high[one][group])
        known = np.zeros(len(one), dtype=bool)
        size, at = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, key[one]), len(self.keys) - 1)
            known = self.keys[slot] == key[one]
            clash = known & ((self.low[slot] != low[one]) | (self.high[slot] != high[one]))
            odd |= clash[group]
            size[known], at[known] = self.size[slot[known]], self.at[slot[known]]
        pool = self.pool
        if not known.all():
            fresh = word[one[~known]]
            ids, n = self._merge(data, starts[fresh], lengths[fresh])
            size[~known], at[~known] = n, len(pool) + np.cumsum(n) - n
            pool = np.concatenate((pool, ids))
        n, begin = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
        n[word], begin[word] = size[group], at[group]
        every, rest = pool, np.concatenate((np.flatnonzero(lengths > SHORT), word[odd]))
        if len(rest):
            ids, first, count = self._by_bytes(data, starts[rest], lengths[rest])
            n[rest], begin[rest] = count, len(pool) + first
            every = np.concatenate((pool, ids))
        put = one[~known]
        if len(self.keys) + len(put) > self.cached:  # the words of this block that the cache lacked alone stay
            kept = pool[spans(at[~known], size[~known])]
            self.keys, self.low, self.high, self.size, self.pool = key[put], low[put], high[put], size[~known], kept
            self.at = np.cumsum(self.size) - self.size
        else:
            by = np.argsort(np.concatenate((self.keys, key[put])))
            joined = lambda old, more: np.concatenate((old, more))[by]
            self.low, self.high, self.keys = joined(self.low, low[put]), joined(self.high, high[put]), joined(self.keys, key[put])
            self.size, self.at, self.pool = joined(self.size, size[~known]), joined(self.at, at[~known]), pool
        ids = every[spans(begin, n)]
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = upto[np.searchsorted(starts, bounds)]
        return ids, ends[1:]

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like _block; texts with strings of special tokens are cut there first."""
        raw = data.tobytes()
        hits = sorted((m.start(), s) for s in self.special for m in regex.finditer(regex.escape(s), raw))
        if not len(data):
            return np.empty(0, dtype=np.int32), np.zeros(len(bounds) - 1, dtype=np.int64)
        if not hits:
            return self._block(data, bounds)
        # Each text's pieces and special strings become texts of their own, joined again below.
        cuts, marks, last = set(bounds.tolist()), {}, -1
        for a, s in hits:
            k = np.searchsorted(bounds, a, side="right") - 1
            if a >= last and a + len(s) <= bounds[k + 1]:
                cuts |= {a, a + len(s)}
                marks[a], last = self.special[s], a + len(s)
        fine = np.array(sorted(cuts), dtype=np.int64)
        ids, ends = self._block(data, fine)
        begin = np.concatenate(([0], ends[:-1]))
        out, upto = [], [0]
        for k, a in enumerate(fine[:-1].tolist()):
            got = np.array([marks[a]], dtype=np.int32) if a in marks else ids[begin[k] : ends[k]]
            out.append(got)
            upto.append(upto[-1] + len(got))
        at = np.searchsorted(fine, bounds[1:])
        return np.concatenate(out), np.array(upto, dtype=np.int64)[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        ids, ends = self.encode_block(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
        out = ids.astype("<u4").tobytes()
        return [out[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Decoder:
    """Token ids back to text; bytes that aren't UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = [vocabulary.tokens.get(i, b"") for i in range(max(vocabulary.tokens) + 1)]
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def raw(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spans(self.at[ids], self.size[ids])]

    def decode(self, ids: bytes) -> str:
        return self.raw(np.frombuffer(ids, dtype="<u4").astype(np.int64)).tobytes().decode("utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once a worker process; the file is on every node (its path is a parameter of the operators)."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes laid end to end and their bounds; null counts as empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds much more text than ``most_bytes`` (one text may)."""
    for batch in batches:
        n = max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)) + 1))
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit token ids) of each whole text, exactly as the file's library encodes it.

    Null and empty texts give no ids; strings of special tokens give their ids.
    Rows are independent: repeated ids and rows are encoded each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in slices(batches):
            ids, ends = encoder.encode_block(*utf8(batch))
            bounds = np.concatenate(([0], 4 * ends)).astype(np.int64)
            out = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids binary")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def valid(raw: bytes) -> bytes:
    """The UTF-8 of what ``raw`` decodes to."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded again in one pass.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and null
    or repeated ids are encoded each by itself; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder, decoder = Encoder(vocab), Decoder(vocab)
        for batch in slices(batches):
            ids, ends = encoder.encode_block(*utf8(batch))
            begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
            packed, raw = ids.astype("<u4").tobytes(), decoder.raw(ids).tobytes()
            byte = np.concatenate(([0], np.cumsum(decoder.size[ids])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ends - begin, type=pa.int64()),
                    pa.array([sha(packed[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]),
                    pa.array([sha(valid(raw[a:b])) for a, b in zip(byte[begin].tolist(), byte[ends].tolist())]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
