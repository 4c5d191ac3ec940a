"""Splitting texts into the pieces that byte-level BPE merges within, as array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import packed

SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, other."""
    import regex
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            a, b = ord(every[run.start()]), ord(every[run.end() - 1])
            table[a:b + 1] = kind
    return table


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts in order, and the index of each text's first piece (and the end).

    Same pieces as ``regex.findall(public_tokenizers.PATTERN, text)``: a run of one class with
    one blank before it, contractions, and white space without the character that belongs to
    what follows.
    """
    raw, bounds = packed(column)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    if len(code) == len(raw):
        at, firsts = np.arange(n + 1), bounds
    else:
        width = 1 + (code >= 0x80) + (code >= 0x800).astype(np.int64) + (code >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))
        firsts = np.searchsorted(at, bounds)
    kind = classes()[code]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last white space before something else of the same text
    tail = np.zeros(n, bool)
    tail[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    start[:n] |= tail
    start[1:n + 1][tail & (code == 0x20)] = False
    mark = np.flatnonzero(start[:n] & (code == 0x27))
    if len(mark):
        ahead = np.concatenate((code, np.zeros(3, np.uint32)))
        stop = np.concatenate((first, np.ones(3, bool)))
        one, two = ahead[mark + 1], ahead[mark + 2]
        near = ~stop[mark + 1]
        short = near & np.isin(one, [ord(x) for x in "stmd"])
        pair = one.astype(np.uint64) << np.uint64(32) | two
        known = [np.uint64(ord(a) << 32 | ord(b)) for a, b in ("re", "ve", "ll")]
        long = near & ~stop[mark + 2] & np.isin(pair, known)
        for hit, size in ((mark[short], 2), (mark[long], 3)):
            start[hit + 1] = False
            start[hit + size] = True
    begins = np.flatnonzero(start[:n])
    offsets = np.append(at[begins], len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(begins), [
        None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(begins, firsts)


class PieceEncoder:
    """Ids of texts through the distinct pieces of a batch.

    ``encode`` turns a list of pieces into one little-endian array of 32-bit ids each. Results
    are kept for up to ``keep`` pieces; beyond that the memory is emptied and filled anew.
    """

    def __init__(self, encode, keep: int = 400_000):
        self.encode, self.keep, self.known = encode, keep, {}

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the bounds of each text."""
        pieces, firsts = split(column)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self.encode([distinct[i] for i in missing])
            if len(self.known) + len(missing) > self.keep:
                self.known.clear()
            for i, x in zip(missing, new):
                found[i] = self.known[distinct[i]] = x
        each = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        which = coded.indices.to_numpy()
        sizes = each[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        starts = np.cumsum(each) - each
        places = np.repeat(starts[which] - ends[:-1], sizes) + np.arange(ends[-1])
        return flat[places], ends[firsts]
