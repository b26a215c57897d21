"""Words of a column of texts as arrays of 64-bit hashes, a whole batch at a time.

A word is a longest run of characters other than space and tab to carriage return. These are
ASCII, so words are found in the UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
APART = np.zeros(256, bool)
APART[:128] = [not chr(c).isalnum() for c in range(128)]

# Odd constants of the mixing functions.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)
LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S30)) * M2
    x = (x ^ (x >> S27)) * M3
    return x ^ (x >> S31)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the place at which each row starts, with the end as the last."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(
    data: np.ndarray, borders: np.ndarray, apart: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``apart``, cut at the borders."""
    inside = ~apart[data]
    inner = borders[(borders > 0) & (borders < len(data))]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes, eight bytes at a step."""
    left = ends - starts
    out = mix(left.astype(np.uint64) * M1)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    live, at = np.arange(len(starts)), starts
    while len(live):
        size = np.minimum(left, 8)
        block = np.ascontiguousarray(eight[at]).view(np.uint64).ravel() & LOW[size]
        out[live] = mix((out[live] ^ block) * M1)
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return out


@dataclass
class Words:
    """Words of consecutive rows: row ``r`` has those from ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, plain: bool = False) -> Words:
    """Words of each row; a null has none.

    ``plain`` folds ASCII capitals, and takes ASCII punctuation for space.
    """
    data, borders = buffers(texts)
    if plain:
        capital = (data >= 65) & (data <= 90)
        data = data + (capital * np.uint8(32))
    starts, ends = spans(data, borders, APART if plain else SPACE)
    first = np.searchsorted(starts, borders)
    return Words(data, starts, ends, first, hashes(data, starts, ends))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of a row, and the first of each row (with the end).

    A row with fewer words has one run of all of them if it has a word.
    """
    h, counts = words.hashes, words.counts
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        whole = mix((whole ^ h[k : k + len(whole)]) * M1 + np.uint64(k))
    n = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    sizes = n.copy()
    sizes[short] = 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(first[-1], np.uint64)
    source = np.repeat(words.first[:-1] - first[:-1], sizes) + np.arange(first[-1])
    is_short = np.repeat(np.isin(np.arange(len(counts)), short), sizes)
    out[~is_short] = whole[source[~is_short]]
    for row in short:
        value = counts[row : row + 1].astype(np.uint64)
        for at in range(words.first[row], words.first[row + 1]):
            value = mix((value ^ h[at : at + 1]) * M3)
        out[first[row]] = value[0]
    return out, first


def row_keys(words: Words) -> list[bytes]:
    """A 16-byte key of each row's sequence of words."""
    import xxhash

    data, first = words.hashes, words.first
    return [xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(first, first[1:])]
