"""Hashes of the words of a column of texts and of their windows, for many texts at once.

They are those of the built-in functions ``xxhash64`` (XXH64 of the bytes, seed 42) and ``hash``
(32 bits of Murmur3), which take several times as long on an array of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes, so that the arrays made of them stay small.
PART = 1 << 20
SEED = 42
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def hashed_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of the texts, and where those of each text begin and end.

    White space of ASCII alone parts words; a word has the hash that ``xxhash64`` gives it.  Each
    item stands for the next texts of the column, n of them as n + 1 places.
    """
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
        size = int(ends[last] - ends[at])
        data = np.zeros(size + 8, dtype=np.uint8)  # a block of eight begins at every place
        if size:
            data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[at]))
        own = ends[at : last + 1] - ends[at]
        starts, sizes = _words(data[:size], own)
        yield xxh64(data, starts, sizes), np.searchsorted(starts, own)
        at = last


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin, and their sizes; a word ends where its text does."""
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of the bytes from ``starts`` on; ``data`` has eight bytes behind the last."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    h = np.full(len(starts), np.uint64(SEED) + P5)
    some = np.flatnonzero(sizes >= 32)
    if len(some):
        h[some] = _stripes(eight, starts[some], sizes[some] // 32)
    h += sizes.astype(np.uint64)
    at, left = starts + (sizes & ~31), sizes & 31
    some = np.flatnonzero(left >= 8)
    while len(some):
        h[some] = _turned(h[some] ^ _round(eight[at[some]], 0), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
        some = some[left[some] >= 8]
    some = np.flatnonzero(left >= 4)
    h[some] = _turned(h[some] ^ (four[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
    at += left & 4
    left &= 3
    for k in range(3):
        some = np.flatnonzero(left > k)
        h[some] = _turned(h[some] ^ (data[at[some] + k].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def _stripes(eight: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the first ``n`` pieces of 32 bytes give, four lanes a word."""
    lanes = np.full((len(starts), 4), np.uint64(SEED))
    lanes += np.array([int(P1) + int(P2) & (1 << 64) - 1, P2, 0, -int(P1) & (1 << 64) - 1], np.uint64)
    some, places = np.arange(len(starts)), starts[:, None] + np.arange(0, 32, 8)
    for k in range(int(n.max())):
        some = some[n[some] > k]
        lanes[some] = _round(eight[places[some] + 32 * k], lanes[some])
    h = sum(_turned(lanes[:, i], x) for i, x in enumerate((1, 7, 12, 18)))
    for i in range(4):
        h = (h ^ _round(lanes[:, i], 0)) * P1 + P4
    return h


def _round(block: np.ndarray, lane) -> np.ndarray:
    return _turned(block * P2 + np.uint64(lane), 31) * P1


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def murmur3(numbers: np.ndarray, size: int) -> np.ndarray:
    """What ``hash`` gives for the ``size`` numbers (64 bits) from every place on."""
    n = len(numbers) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.int32)
    halves = [
        _turned32(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        for x in (numbers, numbers >> np.uint64(32))
    ]
    h = np.full(n, SEED, dtype=np.uint32)
    for k in range(size):
        for half in halves:
            h = _turned32(h ^ half[k : k + n], 13) * np.uint32(5)
            h += np.uint32(0xE6546B64)
        h ^= np.uint32(8)  # bytes of a number
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def _turned32(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))
