"""Word shingles as 64-bit hashes, computed for a batch of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from .common import packed

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORDS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (the well-known 64-bit one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(raw: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial hash; see ``span_hashes``."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(len(raw) + 1)[0][:len(raw)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    inverse = powers(len(prefix))[1]
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * _WORDS[0])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word: the bytes of a word of up to 16 go through the finaliser as two
    numbers, longer words through keyed BLAKE2b; no polynomial, so no words collide by design."""
    size = ends - starts
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))

    def part(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.clip(n, 0, 8)
        keep = np.where(n == 8, ~np.uint64(0), (np.uint64(1) << (8 * n).astype(np.uint64)) - np.uint64(1))
        return eight[np.minimum(at, len(raw))] & keep
    out = mix(part(starts + 8, size - 8) ^ _WORDS[8] + size.astype(np.uint64))
    out = mix((out ^ part(starts, size)) + _WORDS[9])
    for k in np.flatnonzero(size > 16).tolist():
        digest = hashlib.blake2b(raw[starts[k]:ends[k]].tobytes(), digest_size=8, key=b"words")
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of every text; a shorter text is one shingle, one without words none."""
    raw, bounds = packed(column)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * len(column)
    raw = _LOWER[raw]
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    words = word_hashes(raw, starts, ends)
    firsts = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k:k + len(rolled)] * _WORDS[k + 1]
    rolled = mix(rolled + np.uint64(size))
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        elif b > a:
            total = np.sum(words[a:b] * _WORDS[1:b - a + 1], dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
