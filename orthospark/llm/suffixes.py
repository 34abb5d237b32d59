"""Suffix arrays over words, for a chunk of texts at a time."""

from __future__ import annotations

import numpy as np


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])


def _tied(head: np.ndarray) -> np.ndarray:
    return ~(head & np.concatenate([head[1:], [True]]))


def suffix_array(symbols: np.ndarray, doc: np.ndarray, by_doc: bool, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(order, levels, last) of at least one word: suffixes in order of their symbols, to `depth` words or until none tie.

    A suffix ends with its text.  by_doc puts the text before the symbols, so suffixes of different texts never tie.
    levels[k] ranks all suffixes by 2**k words; a rank is the place of its first suffix (from 1; entry n is 0, for beyond
    the end).  A doubling step sorts only suffixes that still tie.  last[i]: where the text of word i ends.
    """
    n = len(symbols)
    order = np.argsort(symbols)
    last = np.searchsorted(doc, doc, "right")
    if by_doc:
        word = np.empty(n, dtype=np.int64)
        word[order] = np.cumsum(_heads(symbols[order]))
        symbols = doc * np.int64(n + 1) + word
        order = np.argsort(symbols)
    head = _heads(symbols[order])
    rank = np.empty(n + 1, dtype=np.int32)
    rank[n] = 0
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(1, n + 1), 0))
    place = np.flatnonzero(_tied(head))  # places of the array that still tie
    levels, step = [rank], 1
    while len(place) and step < (depth or n + 1):
        before = levels[-1]
        rows = order[place]
        after = np.where(rows + step < last[rows], before[np.minimum(rows + step, n)], 0)
        key = before[rows].astype(np.int64) * np.int64(n + 1) + after
        sort = np.argsort(key)
        rows, key = rows[sort], key[sort]
        order[place] = rows
        head = _heads(key)
        rank = before.copy()
        rank[rows] = np.maximum.accumulate(np.where(head, place + 1, 0))
        levels.append(rank)
        place = place[_tied(head)]
        step *= 2
    return order, levels, last


def prefix_ranges(symbols: np.ndarray, last: np.ndarray, order: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query (a row of symbols, `lengths` of which count): the range of `order` whose suffixes begin with it.

    Two binary searches for all queries at once; a suffix that ends inside a query is below it.
    """

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(order), dtype=np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            suffix, below, same = order[middle], np.zeros(len(live), dtype=bool), np.ones(len(live), dtype=bool)
            for k in range(queries.shape[1]):
                at = np.flatnonzero(same & (k < lengths[live]))
                if not len(at):
                    break
                i = suffix[at] + k
                ended = i >= last[suffix[at]]
                s, q = symbols[np.minimum(i, len(symbols) - 1)], queries[live[at], k]
                below[at] = ended | (s < q)
                same[at] = ~ended & (s == q)
            go = below | same if upper else below
            low[live[go]] = middle[go] + 1
            high[live[~go]] = middle[~go]

    return bound(False), bound(True)
