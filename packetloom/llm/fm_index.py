"""A bidirectional FM-index over word ids, and its extension one word at a time for all n-grams of a level.

A text is an array of symbols; 0 separates pieces and is part of no n-gram. The index keeps two
Burrows-Wheeler transforms, of the text and of the text read backwards. An n-gram is a pair of synchronised
intervals of equal size: `low` among the suffixes of the text, `back` among those of the reversed text. One
step of backward search, done for every interval of a level at once, finds all extensions to the left; the same
step in the reversed text finds those to the right. Suffixes are ordered by their first `depth` symbols only,
which is all that intervals of n-grams up to that length can tell apart.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def _prefix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text ordered by the next `depth` symbols, then by place (prefix doubling)."""
    rank, span = text.astype(np.int64), 1
    while True:
        count = int(rank.max()) + 2
        key, have = rank, span
        room = (1 << 62) // max(count, 2)
        while have < depth and int(key.max(initial=0)) < room:
            step = min(span, depth - have)
            shift = min(have + step - span, len(text))
            later = np.zeros(len(text), np.int64)
            later[:len(text) - shift] = rank[shift:] + 1
            key, have = key * count + later, have + step
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        ranked = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
        span = have


def _transform(text: np.ndarray, depth: int) -> np.ndarray:
    return text[_prefix_order(text, depth) - 1]


class Grams(NamedTuple):
    """All n-grams of a level: their intervals, ordered by `low`, and a global id for each."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    def only(self, held: np.ndarray) -> Grams:
        return Grams(*[x[held] for x in self])


class Extensions(NamedTuple):
    """The n-grams one word longer than a level's: intervals, and which of the level stand at both ends."""

    low: np.ndarray
    back: np.ndarray
    size: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray


class FMIndex:
    """The transforms of a text of symbols and of its reverse; the text starts and ends with 0."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.forward, self.backward = forward, backward
        self.rows = [np.argsort(x, kind="stable") for x in (forward, backward)]

    @classmethod
    def of(cls, text: np.ndarray, depth: int) -> FMIndex:
        return cls(_transform(text, depth), _transform(text[::-1], depth))

    def words(self, ids: np.ndarray) -> Grams:
        """The level of single words: symbol k + 1 has the global id `ids[k]`."""
        size = np.bincount(self.forward, minlength=len(ids) + 1)
        low = np.cumsum(size) - size
        return Grams(low[1:], low[1:], size[1:], ids)

    def _step(self, way: int, low: np.ndarray, other: np.ndarray, size: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One word in front of every interval: new intervals here and in the other text, sizes, parents.

        Rows ordered by the symbol before them are the rows of the longer strings, so each new interval is a
        run of rows with one symbol and one parent. In the other text the new intervals divide the parent's
        in the order of their symbols.
        """
        symbols = (self.forward, self.backward)[way]
        parent = np.full(len(symbols), -1, np.int64)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        parent[np.repeat(low, size) + within] = np.repeat(np.arange(len(low)), size)

        parent, symbol = parent[self.rows[way]], symbols[self.rows[way]]
        edge = np.flatnonzero(np.concatenate(
            [[True], (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])]))
        count = np.diff(np.append(edge, len(symbol)))
        of, first = parent[edge], symbol[edge]
        edge, count, of, first = (x[of >= 0] for x in (edge, count, of, first))
        by_parent = np.argsort(of, kind="stable")
        before = np.cumsum(count[by_parent]) - count[by_parent]
        start = np.searchsorted(of[by_parent], of[by_parent])
        there = np.empty(len(of), np.int64)
        there[by_parent] = other[of[by_parent]] + before - before[start] if len(of) else 0
        word = first > 0
        return edge[word], there[word], count[word], of[word]

    def extend(self, level: Grams) -> Extensions:
        """All n-grams one word longer whose parts without the first and without the last word are in `level`."""
        low, back, size, suffix = self._step(0, level.low, level.back, level.size)
        back_2, low_2, _, prefix = self._step(1, level.back, level.low, level.size)
        _, left, right = np.intersect1d(low, low_2, assume_unique=True, return_indices=True)
        return Extensions(low[left], back[left], size[left], prefix[right], suffix[left])
