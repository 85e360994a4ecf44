"""Vectorised text kernels that the operators of this subpackage share.

A batch of texts is handled as one UTF-8 byte buffer with one offset per text; words, their 64-bit hashes and
windows of hashes come from whole-array numpy operations. Buffers are cut at text boundaries into pieces of about
``PIECE`` bytes, so memory stays bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U64 = np.uint64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply); a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(_SPACES)] = False
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
_BYTE = _splitmix(256, 17)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(2 * PIECE, n)
        out = np.empty(size, dtype=U64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * PIECE:
            _powers[base] = out
        return out
    return have


#: Another base and its inverse, for a second hash that is independent of the first.
OTHER = 0xA24BAED4963EE407
OTHER_INV = pow(OTHER, -1, 1 << 64)


def prefix_hash(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] = sum of code(byte k) * base**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1, base)[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = _BASE_INV) -> np.ndarray:
    """Position-independent 64-bit hash of each byte span."""
    inv = powers(len(prefix), inverse)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if n and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of ``table`` bytes inside a text, and the number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


_MIXERS = _splitmix(64, 99) | U64(1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every ``size`` consecutive hashes (the caller masks windows that leave a text)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = hashes[:n] * _MIXERS[0]
    for k in range(1, size):
        out = out + hashes[k : k + n] * _MIXERS[k]
    return mix(out + U64(size))


def positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] numbers for each i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts - starts, counts)
