"""Hashes of words and word shingles, whole batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUFFER = 1 << 20  # bytes of text that are worked on at once; a longer text is a buffer of its own
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, BUFFER + 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have if len(have) <= 4 * BUFFER else _powers.get(base, have[: BUFFER + 4096].copy())
    return have[:size]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each byte range of ``data``; equal bytes give equal hashes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def buffers(texts: list[bytes], most: int = BUFFER) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together fit a buffer."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and where each text's words begin (with
    the end of the last). Words are runs of ASCII digits and letters, lower-cased, and of all
    non-ASCII characters."""
    joined = b"\n".join(texts).lower()
    data = np.frombuffer(joined, dtype=np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(~inside[1:] & inside[:-1])
    return range_hashes(data, starts, ends), np.searchsorted(starts, edges)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``size`` words; a text with fewer words
    has one shingle of all of them, one without words none."""
    for a, b in buffers(texts):
        hashes, edges = word_hashes(texts[a:b])
        padded = np.r_[hashes, np.zeros(size, dtype=np.uint64)]
        runs = np.zeros(len(hashes), dtype=np.uint64)
        for i in range(size):
            runs = mixed(runs * np.uint64(3) + padded[i : i + len(hashes)]) if i else padded[: len(hashes)].copy()
        for start, end in zip(edges, edges[1:]):
            count = end - start
            if count >= size:
                yield np.unique(runs[start : end - size + 1])
            elif count:
                short = np.array([count], dtype=np.uint64)
                for i in range(start, end):
                    short = mixed(short * np.uint64(3) + hashes[i : i + 1])
                yield short
            else:
                yield np.zeros(0, dtype=np.uint64)
