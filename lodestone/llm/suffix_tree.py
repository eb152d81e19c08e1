"""Substring deduplication by words, with prefix-partitioned truncated suffix trees.

Suffixes of a text are the word sequences from each of its words on. They are
partitioned by prefixes of variable length (see ``repeats``): the anchor's words first,
half a window where more suffixes share these than fit a group, the whole window where
even that is shared by too many. In each group a tree of the suffixes that may repeat
is grown breadth-first, one word a level. A node is the set of suffixes that share its
prefix; nodes with a single suffix are leaves and go at once. The nodes that are still
internal at the window's depth are the repeats. Suffixes with wholly equal text are one
leaf with several owners, and a prefix of the window's whole length that is shared is a
deep internal node by itself; neither needs a tree to be found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm.repeats import Unit, remove_repeats


def deep_nodes(values: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix (from ``starts`` on), whether its node at ``depth`` words is internal: shared with another suffix."""
    out = np.zeros(len(starts), dtype=bool)
    word = np.unique(values, return_inverse=True)[1].astype(np.int64)
    live, node = np.arange(len(starts)), np.unique(group, return_inverse=True)[1].astype(np.int64)
    for level in range(depth):
        key = node * (int(word.max(initial=0)) + 1) + word[starts[live] + level]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        child = np.empty(len(key), dtype=np.int64)
        child[order] = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1
        live, node = live[inner], child[inner]
        if not len(live):
            return out
    out[live] = True
    return out


def remove_repeated_words(docs: DataFrame, window: int = 35, gram: int = 6, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns ``carry``), n_words, n_removed, kept_sha256 and text (the words left) of each row of ``docs`` (doc_id, text).

    Every word covered by a run of ``window`` words that also starts anywhere else goes;
    runs are judged on the input. Null, blank and shorter texts lose nothing and are
    rewritten with single spaces; rows with equal text repeat each other, so both lose their
    words; null and repeated ids are fine; an empty table gives no rows; other columns are ignored.
    """
    unit = Unit(words=True, length=window, gram=gram)
    return remove_repeats(docs, unit, deep_nodes, list(carry)).withColumnRenamed("n_units", "n_words").drop("n_spans")
