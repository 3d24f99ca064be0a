"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from engram.llm.common import flat_bytes

ODD, INVERSE = 6364136223846793005, pow(6364136223846793005, -1, 2**64)
#: Longest run of bytes that is hashed with one table of powers.
POWERS = 1 << 18


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte in lower case, powers of the base and of its inverse, and which bytes are white space."""
    values = np.random.default_rng(20).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    up, down = np.full(POWERS + 1, ODD, np.uint64), np.full(POWERS + 1, INVERSE, np.uint64)
    up[0] = down[0] = 1
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, np.cumprod(up), np.cumprod(down), space


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of the texts and where each text's words start."""
    values, up, down, space = tables()
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # runs of words that the tables of powers cover
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + POWERS, "right")))
        size = int(ends[to - 1] - base)
        if size > POWERS:  # one word longer than the tables
            hashes[at] = np.frombuffer(_long_hash(data[base:base + size]), np.uint64)[0]
        else:
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(values[data[base:base + size]] * up[:size], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            hashes[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mixed(hashes), np.searchsorted(starts, offsets)


def _long_hash(word: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_64_digest(bytes(word).lower())


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Per text its distinct shingles in rising order; a text with fewer words is one shingle, without words none."""
    hashes, first = word_hashes(*flat_bytes(column))
    whole = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        for i in range(words):
            whole[:n] = whole[:n] * np.uint64(ODD) + hashes[i:n + i]
        whole = mixed(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        else:
            short = np.zeros(min(1, b - a), np.uint64)
            for h in hashes[a:b]:
                short = short * np.uint64(ODD) + h
            out.append(mixed(short + np.uint64(b - a)))
    return out
