"""Substring deduplication by bytes, with suffix arrays of shards.

A shard holds the contents of whole prefix groups (see ``repeats``). Its suffix array is
built by Larsson and Sadakane's refinement in numpy: suffixes sorted by their first bytes
are refined by the ranks of the suffixes h bytes on, h doubling, and only groups that are
still unsorted are sorted again. Kasai's scan along the text gives the common prefixes of
neighbours. Equal strings of different shards are impossible by the partition, but for
prefixes that more runs share than a shard takes; these windows are merged across shards
by a digest of their whole length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm.repeats import Unit, remove_repeats

FIRST = 8


def refine(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``values``, sorted by the first ``length`` bytes at least, and each suffix's rank (equal where the order isn't decided)."""
    n = len(values)
    raw = np.concatenate((values, np.zeros(FIRST, dtype=np.uint8))).tobytes()
    head = np.ndarray(shape=(n,), dtype=">u8", buffer=raw, strides=(1,)).astype(np.uint64)
    order = np.argsort(head)
    sorted_head = head[order]
    new = np.concatenate(([True], sorted_head[1:] != sorted_head[:-1]))
    # A group's rank is the place of its last member, as in Larsson and Sadakane's numbering.
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    rank = np.empty(n, dtype=np.int64)
    rank[order] = last[np.cumsum(new) - 1]
    h = FIRST
    while h < length:
        step = min(h, length - h)
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        place = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the array of unsorted groups
        if not len(place):
            break
        suffix = order[place]
        ahead = suffix + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[place] = suffix
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[place] = fresh
        # Ranks: the place of the last member of the refined group.
        ends = np.append(np.flatnonzero(fresh)[1:], len(place)) - 1
        rank[suffix] = place[ends][np.cumsum(fresh) - 1]
        h += step
    return order, rank


def kasai(values: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``cap``.

    Kasai's bound (a prefix loses one byte at most from one suffix to the next in the
    text) is followed along many stretches of the text at once. Suffixes of equal rank
    share ``cap`` bytes; as their order is arbitrary the bound doesn't hold after them.
    """
    n = len(values)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    stretch = 512
    starts = np.arange(0, n, stretch)
    have = np.zeros(len(starts), dtype=np.int64)
    words = np.ndarray(shape=(n,), dtype=np.uint64, buffer=np.concatenate((values, np.zeros(8, dtype=np.uint8))).tobytes(), strides=(1,))
    for k in range(stretch):
        i = starts + k
        ok = (i < n) & (before[np.minimum(i, n - 1)] >= 0)
        have = np.where(ok & (have < cap), np.maximum(have - 1, 0), 0)
        tied = ok & (rank[np.minimum(i, n - 1)] == rank[before[np.minimum(i, n - 1)]])
        have[tied] = cap
        live = np.flatnonzero(ok & ~tied)
        while len(live):
            x, y = i[live] + have[live], before[i[live]] + have[live]
            room = (np.maximum(x, y) < n) & (have[live] < cap)
            live, x, y = live[room], x[room], y[room]
            eight = (np.maximum(x, y) + 8 <= n) & (words[x] == words[y])
            one = ~eight & (values[x] == values[y])
            have[live] += np.where(eight, 8, one.astype(np.int64))
            live = live[eight | one]
        inside = i < n
        out[i[inside]] = np.minimum(have[inside], cap)
    return out


def repeated_suffixes(values: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (from ``starts`` on), whether another one of ``starts`` has the same ``length`` bytes."""
    # Only the stretches that hold asked suffixes are sorted, laid end to end.
    covered = np.bincount(starts, minlength=len(values) + 1) - np.bincount(starts + length, minlength=len(values) + 1)
    inside = np.cumsum(covered[:-1]) > 0
    moved = np.cumsum(inside) - 1
    text, at = values[inside], moved[starts]
    order, rank = refine(text, length)
    asked = np.zeros(len(text), dtype=bool)
    asked[at] = True
    common = kasai(text, order, rank, length)
    # Runs of the array whose neighbours share the whole length; a run with two asked suffixes or more is a repeat.
    run = np.cumsum(np.concatenate(([True], common[order[1:]] < length))) - 1
    many = np.bincount(run, weights=asked[order]) > 1
    out = np.zeros(len(text), dtype=bool)
    out[order] = many[run]
    return out[at]


def remove_repeated_bytes(docs: DataFrame, window: int = 400, gram: int = 32, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns ``carry``), n_bytes, n_removed, n_spans, kept_sha256 and text of each row of ``docs`` (doc_id, text).

    Every byte of the UTF-8 text covered by a ``window``-byte string that also starts
    anywhere else goes; strings are judged on the input and never cross documents. Null,
    empty and shorter texts lose nothing; rows with equal text repeat each other; null
    and repeated ids are fine; an empty table gives no rows; other columns are ignored.
    ``text`` is what is left; where a cut parts a character, its bytes read U+FFFD there
    (the digest is of the bytes themselves).
    """
    unit = Unit(words=False, length=window, gram=gram)
    return remove_repeats(docs, unit, repeated_suffixes, list(carry)).withColumnRenamed("n_units", "n_bytes")
