"""Words of whole Arrow batches as numpy arrays.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``. Everything here
works on the UTF-8 bytes of an Arrow string array at once; a null text counts
as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Odd factors of two hashes of a word that are independent of each other.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPAN = 1 << 20
#: Longer words are hashed one at a time, so that a power table of _SPAN bytes is enough.
_LONG = 256
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit hashes (a finalizer of shifts and odd factors)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (with the end of the last)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def bounds(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, and document (position in the batch) of each word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~space[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = at[:-1]
    before[starts[starts < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[at[1:] - 1] = False
    first = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    return first, end, np.searchsorted(at[1:], first, side="right")


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 0, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike wherever they stand."""
    if base not in _powers:
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(_SPAN + _LONG + 1, base, np.uint64), np.full(_SPAN + _LONG + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[base]
    out = np.empty(len(first), np.uint64)
    size = end - first
    i = 0
    while i < len(first):
        low = first[i]
        j = int(np.searchsorted(first, low + _SPAN, side="left"))
        high = min(len(data), low + _SPAN + _LONG)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * down[: high - low], out=sums[1:])
        s, e = first[i:j] - low, np.minimum(end[i:j] - low, high - low)
        out[i:j] = (sums[e] - sums[s]) * up[e - 1]
        i = j
    out = mix(out + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    for k in np.flatnonzero(size > _LONG):
        out[k] = xxhash.xxh64_intdigest(data[first[k] : end[k]].tobytes(), seed ^ base)
    return out


def windows(hashes: np.ndarray, length: int, base: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """Hashes of every run of ``length`` neighbours, by doubling: shifted sums of runs of powers of two."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    power, run, out, have = base, hashes, None, 0
    bit = 1
    with np.errstate(over="ignore"):
        while True:
            if length & bit:
                # run covers `bit` hashes; it goes before the `have` that are done
                n = len(hashes) - have - bit + 1
                out = run[:n].copy() if out is None else run[:n] * np.uint64(pow(base, have, 1 << 64)) + out[bit : bit + n]
                have += bit
            bit *= 2
            if bit > length:
                return out
            half = bit // 2
            n = len(run) - half
            run = run[:n] * np.uint64(power) + run[half : half + n]
            power = power * power % (1 << 64)


def spread(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring positions ``at``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
