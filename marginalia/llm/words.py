"""Words of texts as hashes, computed with whole arrays instead of word by word.

A word is a run of ASCII letters, digits and underscores, lower-cased, and of bytes from
0x80 up, which stand for all other characters and are taken as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 20
"""Bytes that are handled together; longer texts are cut between two words."""

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A full-width bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(_POWERS, _BASE, np.uint64))


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words of a text."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _LOWER[data], edges[::2], edges[1::2]


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    values = (data.astype(np.uint64) + np.uint64(1)) * _powers()[place % _POWERS]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64))


def pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between two words (or after a very long word)."""
    start = 0
    while len(raw) - start > CHUNK:
        window = np.frombuffer(raw, np.uint8, CHUNK, start)
        gaps = np.flatnonzero(~_IS_WORD[window])
        end = start + (int(gaps[-1]) + 1 if len(gaps) else CHUNK)
        while not len(gaps) and end < len(raw) and _IS_WORD[raw[end]]:
            end += 1
        yield raw[start:end]
        start = end
    yield raw[start:]


def word_hashes(text: str) -> np.ndarray:
    """The hashes of a text's words in order."""
    parts = [hashed(*spans(p)) for p in pieces(text.encode("utf-8", "surrogatepass"))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def batched_words(texts: list[str]) -> Iterator[np.ndarray]:
    """``word_hashes`` of each text; short texts share one pass over the arrays."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if group:
            joined = b"\n".join(group)
            data, starts, ends = spans(joined)
            hashes = hashed(data, starts, ends)
            bounds = np.cumsum([len(g) + 1 for g in group])
            yield from np.split(hashes, np.searchsorted(starts, bounds)[:-1])

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK:
            yield from flush()
            group, size = [], 0
            yield word_hashes(text)
            continue
        if size + len(raw) > CHUNK:
            yield from flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    yield from flush()


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct runs of ``width`` words as sorted hashes; a shorter text is one run."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + words[k : k + n]
    return np.unique(mix(out + np.uint64(width)))
