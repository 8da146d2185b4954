"""Vectorised word hashing over Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``.  Texts are handled as UTF-8 bytes in chunks of about ``CHUNK`` bytes (one text
at least), so the memory of a task is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and the base of the polynomial with its inverse modulo 2**64.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C13 | 3
BASE_INV = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = BYTE_VALUE.copy()
_LOWER[65:91] = BYTE_VALUE[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for reuse while n is of the usual size."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, CHUNK + 4096), base, np.uint64)
            have[0] = 1
            np.cumprod(have, out=have)
        if len(have) <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start of each row's text in the bytes and the end of all) of a string column; null: empty."""
    if pa.types.is_string_view(column.type) or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def hashed_words(raw: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, byte after the last of each word; first word of each row and the number of all words)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(starts), np.int64)
    gap = _SPACE[raw]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    edges = starts[(starts > 0) & (starts < n)]
    begins[edges] = ~gap[edges]
    ends[edges - 1] = ~gap[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        run = (_LOWER if lower else BYTE_VALUE)[raw]
        run *= powers(BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(run, out=total[1:])
        h = (total[last] - total[first]) * powers(BASE_INV, n)[first]
        h += (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), first, last, np.searchsorted(first, starts).astype(np.int64)


def runs_hashed(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of words[i:i+width] for each i; shorter runs at the end are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        out = words[:n] * odd[0]
        for j in range(1, width):
            out += words[j : j + n] * odd[j]
    return mix(out)
