"""Shingle sets and fast similarity sketches of many texts at once, in flat arrays.

A word hash is a sum of random numbers for its bytes times powers for their places; a shingle hash mixes
the hashes of its words.  All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Coordinates of a sketch, a power of two.
BINS = 128
EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 11)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_PLACES = mix(np.arange(SHINGLE, dtype=np.uint64), 12) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A to Z as lower case) and the number of words of each text."""
    flat = np.frombuffer(b"\n".join(texts), np.uint8)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    inside = (flat != 32) & ((flat < 9) | (flat > 13))
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    words = np.diff(np.searchsorted(starts, np.r_[0, ends]))
    if not len(starts):
        return np.zeros(0, np.uint64), words
    place = np.arange(len(flat), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.r_[starts, len(flat)])) if starts[0] == 0 else np.r_[np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.r_[starts, len(flat)]))]
    last = len(flat) - 1 - int(np.argmax(inside[::-1]))
    longest = int(np.max(place[: last + 1][inside[: last + 1]])) + 1
    powers = np.multiply.accumulate(np.full(longest, _ODD))
    values = np.zeros(len(flat), np.uint64)
    values[inside] = _BYTES[flat[inside]] * powers[place[inside]]
    return mix(np.add.reduceat(values, starts)), words


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each text, and their number for each text."""
    words, counts = word_hashes(texts)
    before = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(int(sizes.sum())) - first[owner] + before[owner]
    hashes = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = counts[owner] > k
        hashes[there] += words[at[there] + k] * _PLACES[k]
    hashes = mix(hashes + counts[owner].clip(max=SHINGLE).astype(np.uint64))
    for a, n in zip(first.tolist(), sizes.tolist(), strict=True):
        hashes[a : a + n].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def sketches(hashes: np.ndarray, sizes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, a row of ``bins`` numbers for each set that is not empty.

    Round r throws every element into a hashed bin, where it counts r and a fraction; from round ``bins``
    on, round bins + b throws every element into bin b, so that each coordinate of each set is filled
    in the end.  A set takes part until its coordinates are filled; the smallest number wins.
    """
    out = np.full((len(sizes), bins), EMPTY)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    open_ = sizes > 0
    for r in range(2 * bins):
        if not open_.all():
            go = open_[owner]
            hashes, owner = hashes[go], owner[go]
        if not len(hashes):
            break
        x = mix(hashes, r + 1)
        to = (x & np.uint64(bins - 1)).astype(np.int64) if r < bins else r - bins
        value = (np.uint64(r) << np.uint64(48)) | (x >> np.uint64(16))
        np.minimum.at(out.reshape(-1), owner * bins + to, value)
        open_ = open_ & (out == EMPTY).any(axis=1)
    return out


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each group of ``rows`` neighbouring coordinates; equal only within the same group."""
    n = sketch.shape[1] // rows
    parts = mix(sketch).reshape(len(sketch), n, rows)
    total = np.zeros((len(sketch), n), np.uint64)
    for k in range(rows):
        total = mix(total + parts[:, :, k])
    return mix(total + np.arange(n, dtype=np.uint64))


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a 64-bit number."""
    two = (mix(sketch) & np.uint64(3)).reshape(len(sketch), -1, 32)
    return np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))
