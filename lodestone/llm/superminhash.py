"""SuperMinHash signatures of many sets at once.

Each element draws a random permutation of the signature's places step by step; at step j it offers the value j + r to
the place that comes j-th. A place keeps the least value offered. Because the places of one element are all different,
the components of a signature are negatively correlated and the similarity estimate varies less than with independent
hash functions. Once every place of a set holds a value of an earlier step, later steps can't change it, so the set is
left out from then on: about m ln(m) draws a set instead of m times its size.

All sets go through a step together, which is the same computation as element by element.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, which spreads every bit of ``x`` over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each list, and the list each belongs to; a list under ``n`` words has none."""
    lengths = np.diff(offsets)
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        w = mixed(words.astype(np.int64).view(np.uint64) + np.uint64(salt))
        size = len(w) - n + 1
        h = w[:size].copy()
        for k in range(1, n):
            h = (h * _GOLDEN) ^ ((h >> _U32) + w[k : k + size])
        h = mixed(h)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:size]
    inside = np.arange(size) + n <= offsets[owner + 1]
    return h[inside], owner[inside]


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, m: int, block: int = 256) -> np.ndarray:
    """(sets, m) signature values; ``owner`` ascends. The row of an empty set is all ones."""
    out = np.full((sets, m), np.iinfo(np.uint64).max, np.uint64)
    cuts = np.searchsorted(owner, np.arange(0, sets + block, block))
    for i, first in enumerate(range(0, sets, block)):
        part = slice(cuts[i], cuts[i + 1])
        _fill(out[first : first + block], elements[part], owner[part] - first, m)
    return out


def _fill(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, m: int) -> None:
    empty = np.iinfo(np.uint64).max
    flat = out.reshape(-1)
    n = len(elements)
    places = np.tile(np.arange(m, dtype=np.uint16), n)
    base = np.arange(n) * m
    row = owner * m
    seed = elements.copy()
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(base):
                return
            seed = seed + _GOLDEN
            draw = mixed(seed)
            at = base + j
            swap = at + (((draw >> _U32) * np.uint64(m - j)) >> _U32).astype(np.int64)
            place = places[swap]
            places[swap] = places[at]
            target = row + place
            free = np.flatnonzero(flat[target] == empty)
            np.minimum.at(flat, target[free], (np.uint64(j) << _U32) | (draw[free] & _LOW))
            open_rows = (out == empty).any(axis=1)
            going = open_rows[owner]
            if np.count_nonzero(going) < 0.8 * len(going):
                base, row, seed, owner = base[going], row[going], seed[going], owner[going]


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) hash of each run of ``rows`` places."""
    sets, m = signature.shape
    bands = m // rows
    parts = signature[:, : bands * rows].reshape(sets, bands, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (sets, bands)).copy()
        for k in range(rows):
            h = mixed(h + parts[:, :, k]) * _GOLDEN
    return mixed(h)


def bit_sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 places: equal places agree, others by half."""
    bits = (mixed(signature[:, :64]) & np.uint64(1)).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
