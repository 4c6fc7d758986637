"""Vectorised hashes of words and word shingles over many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHINGLE = np.uint64(0x94D049BB133111EB)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every byte: its value with A-Z lower-cased, and whether it is one of the six blanks."""
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return fold, blank


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    first = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))
    return first(_BASE), first(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    up, down = _powers(1 << max(20, n.bit_length()))
    return up[:n], down[:n]


def word_hashes(texts: list[str | None], *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased, unless told otherwise) in order, and the number of words of each text."""
    fold, blank = _tables()
    if not lower:
        fold = np.arange(256, dtype=np.uint64)
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    solid = ~blank[raw]
    edge = np.diff(solid.view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((fold[raw] + np.uint64(1)) * up, out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(d) + 1 for d in data])
    counts = np.diff(np.searchsorted(start, ends, "left"), prepend=0) if len(data) else np.zeros(0, int)
    return hashes, counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words of one word array."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h = h * _SHINGLE + words[j : j + n]
    return mix(h)


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words of one array, by running sums: the cost does not grow with the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted; a text of fewer words has its whole sequence as one."""
    every = shingle_hashes(words, width)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(every[at : at + n - width + 1]))
        elif n:
            out.append(shingle_hashes(words[at : at + n], int(n)) ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
