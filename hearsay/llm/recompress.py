"""Locally consistent parsing of word sequences by recompression.

A round first turns each run of one symbol into a symbol of its own, then joins
pairs of neighbours: a hash gives every symbol a bit, and a symbol of bit 0 takes
in a following one of bit 1. A symbol's name is a hash of what it was made from,
so equal word sequences get equal names in every task without a naming table.
Only symbols of at most ``LONGEST`` words take part, which bounds what a symbol
depends on.

For every symbol ``low`` and ``high`` bound the words that its making looked at.
Equal word sequences that hold those words hold that same symbol at the same
place, whatever surrounds them. Texts are parsed together, a stop between each
two; a stop takes no part, and what looked at one has its bounds there, outside
the text.

``anchors`` picks for every window of a text the symbols that all windows of the
same words pick: of those that depend on the window alone, the two whose names
hash least and most.
"""

from __future__ import annotations

import numpy as np

from hearsay.llm.wordhash import combine, mix

ROUNDS = 5
RUN_ROUNDS = (0, 3)
LONGEST = 12


def parse(hashes: np.ndarray, stops: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST,
          run_rounds: tuple[int, ...] = RUN_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(names, low, high)`` of the symbols after the last round; ``high`` is exclusive, both rise.

    ``stops`` marks the places that hold no word; the first and last must be stops.
    """
    names, low, high = hashes.copy(), np.arange(len(hashes)), np.arange(1, len(hashes) + 1)
    length = np.where(stops, longest + 1, 1)
    for t in range(rounds):
        if t in run_rounds:
            takes = length <= longest
            same = np.zeros(len(names), bool)
            same[1:] = (names[1:] == names[:-1]) & takes[1:] & takes[:-1]
            first = np.flatnonzero(~same)
            last = np.append(first[1:], len(names)) - 1
            part = takes[first]
            count = last - first + 1
            low, high = (np.where(part, low[np.maximum(first - 1, 0)], low[first]),
                         np.where(part, high[np.minimum(last + 1, len(names) - 1)], high[last]))
            length = np.add.reduceat(length, first)
            names = np.where(count > 1, mix(names[first] + count.astype(np.uint64), 1000 + t), names[first])
        takes = length <= longest
        bit = (mix(names, 2000 + t) >> np.uint64(33)) & np.uint64(1) == 1
        left = np.zeros(len(names), bool)
        left[:-1] = takes[:-1] & takes[1:] & ~bit[:-1] & bit[1:]
        right = np.zeros(len(names), bool)
        right[1:] = left[:-1]
        alone = takes & ~left & ~right
        low[1:], high[:-1] = (np.where((alone & bit)[1:], low[:-1], low[1:]),
                              np.where((alone & ~bit)[:-1], high[1:], high[:-1]))
        at = np.flatnonzero(left)
        names[at] = combine(names[at], names[at + 1], 3000 + t)
        high[at] = high[at + 1]
        length[at] += length[at + 1]
        names, low, high, length = names[~right], low[~right], high[~right], length[~right]
    return names, low, high


def anchors(hashes: np.ndarray, stops: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For the windows of ``size`` words at ``starts``, a name for their two anchors, 0 where they have none."""
    names, low, high = parse(hashes, stops)
    ranks = np.append(mix(names, 4000), np.uint64(0))
    a = np.searchsorted(low, starts)
    b = np.searchsorted(high, starts + size, "right")
    found = a < b
    at = np.stack([a[found], b[found]], axis=1).ravel()
    out = np.zeros(len(starts), np.uint64)
    if len(at):
        out[found] = combine(np.minimum.reduceat(ranks, at)[::2], np.maximum.reduceat(ranks, at)[::2]) | np.uint64(1)
    return out
