"""Hashes of words and of word shingles for a block of texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, FOLD, LENGTH = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.append(U(1), np.full(max(n, 1024), BASE)))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column without nulls and where each text begins and the last ends."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word; words end at ASCII white space and at the end of their text."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, solid[:-1])
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.append(solid[1:], False)
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if not len(start):
        return np.empty(0, np.uint64), start, end
    with np.errstate(over="ignore"):
        size = end - start
        value = BYTE[LOWER[data]] if lower else BYTE[data]
        place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate(([0], start, [len(data)]))))
        value = value * powers(int(place.max()) + 1)[place]
        value[~solid] = 0
        return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * LENGTH), start, end


def folded(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n neighbours."""
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(hashes) - n + 1), U(salt + n))
        for i in range(n):
            out = out * FOLD + hashes[i : len(hashes) - n + 1 + i]
        return mix(out)


def document_bounds(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each text's words begin among all words, and where the last ends."""
    return np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z lower-cased; with fewer words, of the whole sequence."""
    data, offsets = text_bytes(column)
    hashes, start, _ = words(data, offsets, lower=True)
    bounds = document_bounds(start, offsets).tolist()
    runs = folded(hashes, n)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(folded(hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
