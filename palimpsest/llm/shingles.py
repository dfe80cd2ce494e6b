"""Word shingles as 64-bit hashes, computed over whole batches of text with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers (fixed values); powers of BASE make prefix sums of a text into word hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LEFT, RIGHT, ALONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE)]))
        _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]))
    return _POWERS[:n], _INVERSES[:n]


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes times powers of BASE; spans' hashes are differences of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of [start, end) of the text behind prefix; equal bytes give equal hashes."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a lower-cased text begin, and their hashes."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, spans(sums(data), start, end)


def shingle_sets(texts: list[bytes], words: int = 2, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of so many words, as sorted 64-bit hashes.

    A-Z are lower-cased first. A text with fewer words has its whole sequence as one shingle;
    one without words has none.
    """
    begin = 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) < chunk):
            size += len(texts[stop]) + 1
            stop += 1
        part = texts[begin:stop]
        offsets = np.cumsum([0, *(len(t) + 1 for t in part)])
        start, w = word_hashes(b" ".join(part).lower())
        at = np.searchsorted(start, offsets)
        for a, b in zip(at[:-1], at[1:], strict=True):
            own = w[a:b]
            if not len(own):
                yield own
                continue
            n = min(words, len(own))
            x = np.full(len(own) - n + 1, ALONE if n < words else np.uint64(0))
            for k in range(n):
                x = mix(x * LEFT + own[k : len(own) - n + 1 + k] * RIGHT)
            yield np.unique(x)
        begin = stop
