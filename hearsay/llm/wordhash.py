"""Hashes of words and word windows for many texts at once, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D in the UTF-8
text. A word's hash is a polynomial over its bytes modulo 2**64, mixed with its
length; nothing loops over words or bytes in Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 15             # bytes of text that are hashed at once: their arrays stay in a core's cache
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * BASE + mix(b, 1), seed)


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, np.uint64)]), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """``BASE ** i`` modulo 2**64 for i below n."""
    return _powers(max(1024, 1 << (n - 1).bit_length()))[:n] if n else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _there_and_back() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE``, and of its inverse modulo 2**64, for the places of a block."""
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    return _powers(BLOCK), np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK - 1, inverse, np.uint64)]), dtype=np.uint64)


def _polynomials(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The polynomial of each word: a difference of running sums over its block, moved back to the block's start."""
    out, first = np.empty(len(starts), np.uint64), 0
    there, back = _there_and_back()
    while first < len(starts):
        begin = int(starts[first])
        last = int(np.searchsorted(stops, begin + BLOCK, side="right"))
        if last > first:
            sums = np.zeros(int(stops[last - 1]) - begin + 1, np.uint64)
            np.add(data[begin:begin + len(sums) - 1], np.uint64(1), out=sums[1:])
            sums[1:] *= there[:len(sums) - 1]
            np.cumsum(sums, out=sums)
            at = starts[first:last] - begin
            out[first:last] = (sums[stops[first:last] - begin] - sums[at]) * back[at]
        else:       # a word longer than a block
            last = first + 1
            long = data[begin:int(stops[first])].astype(np.uint64) + np.uint64(1)
            out[first] = (long * powers(len(long))).sum(dtype=np.uint64)
        first = last
    return out


def words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: hashes of all words of all texts, and where each text's words end.

    ``lower`` maps A-Z to a-z first.
    """
    coded = [t.encode() for t in texts]
    joined = b" ".join([*coded, b""])
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)     # of bytes, lower() maps only A-Z
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    limits = np.cumsum([len(c) + 1 for c in coded])
    ends = np.searchsorted(starts, limits)
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    return mix(_polynomials(data, starts, stops) + (stops - starts).astype(np.uint64) * BASE), ends


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words of one text; those of fewer words are none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out = combine(out, hashes[i:i + n], i)
    return out
