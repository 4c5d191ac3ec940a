"""Byte-level BPE encoding and decoding.

Within a piece, a segment tree over its byte positions holds ``rank, position`` of the pair that
starts there; its root is the leftmost pair of least rank. A merge changes three leaves (the
merged pair, the pair before, the pair swallowed), each a logarithmic point update, and links
live neighbours. Short pieces of a batch go through their trees side by side as arrays; long
ones through a tree of their own, so a text of one huge piece costs n log n.

Null and empty texts give no ids. Repeated rows are encoded each. The work is narrow: no
shuffle, and memory is that of one batch of ``BATCH`` bytes (or of one longer text).
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import chunks, ragged, texts
from .pretokens import PieceEncoder

BATCH = 2 << 20
#: Pieces up to this many bytes are merged side by side.
SHORT = 64
NONE = np.int64(1) << np.int64(62)


class Ranks:
    """A rank file: the bytes of every token and the rank of every mergeable pair of tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        pairs = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.arrow = pa.array(self.token, pa.binary())

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece by its own segment tree."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    none = int(NONE)
    ids = [int(ranks.byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    pairs = ranks.pairs

    def leaf(i: int) -> int:
        j = after[i]
        r = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
        return none if r is None else r * width + i

    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        ids[i], after[i] = rank, after[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_many(pieces: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    """Ids of pieces of at most ``width`` bytes (a power of two), all trees side by side."""
    m = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.zeros((m, width + 1), np.int64)
    ids.ravel()[ragged(np.arange(m) * (width + 1), sizes)] = ranks.byte[flat]
    place = np.arange(width + 1)
    after = np.broadcast_to(place + 1, (m, width + 1)).copy()
    before = np.broadcast_to(place - 1, (m, width + 1)).copy()
    tree = np.full((m, 2 * width), NONE, np.int64)
    starts = ranks.of_pairs(ids[:, :width - 1].ravel(), ids[:, 1:width].ravel()).reshape(m, -1)
    starts = np.where(place[:width - 1] + 1 < sizes[:, None], starts, NONE)
    tree[:, width:2 * width - 1] = np.where(starts < NONE, starts * width + place[:width - 1], NONE)
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    row = np.arange(m)
    while len(row := row[tree[row, 1] < NONE]):
        rank, i = np.divmod(tree[row, 1], width)
        j = after[row, i]
        k = after[row, j]
        ids[row, i], after[row, i] = rank, k
        before[row, k] = i
        h = before[row, i]
        # places past the piece's end and before its start get no pair
        behind, ahead = k < sizes[row], h >= 0
        new_i, new_h = np.full(len(row), NONE), np.full(len(row), NONE)
        value = ranks.of_pairs(rank[behind], ids[row[behind], k[behind]])
        new_i[behind] = np.where(value < NONE, value * width + i[behind], NONE)
        value = ranks.of_pairs(ids[row[ahead], h[ahead]], rank[ahead])
        new_h[ahead] = np.where(value < NONE, value * width + h[ahead], NONE)
        rows = np.concatenate((row, row, row[ahead]))
        leaves = width + np.concatenate((j, i, h[ahead]))
        tree[rows, leaves] = np.concatenate((np.full(len(row), NONE), new_i, new_h[ahead]))
        for _ in range(width.bit_length() - 1):
            leaves = leaves >> 1
            tree[rows, leaves] = np.minimum(tree[rows, 2 * leaves], tree[rows, 2 * leaves + 1])
    live = np.zeros((m, width + 1), bool)
    row, i = np.arange(m), np.zeros(m, np.int64)
    while len(row):
        live[row, i] = True
        i = after[row, i]
        row, i = row[on := i < sizes[row]], i[on]
    counts = live.sum(1)
    out = ids[live].astype("<u4").tobytes()
    ends = np.cumsum(counts) * 4
    return [out[b - 4 * c:b] for b, c in zip(ends.tolist(), counts.tolist())]


class Encoder:
    """Encoding and decoding by one rank file."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.pieces = PieceEncoder(self.merge)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            whole = self.ranks.rank.get(piece)
            if whole is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[at] = np.array(merge_one(piece, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(at)
        for width, places in by_width.items():
            for k in range(0, len(places), 8192):
                some = places[k:k + 8192]
                for at, ids in zip(some, merge_many([pieces[i] for i in some], width, self.ranks)):
                    out[at] = ids
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each."""
        return self.pieces.ids(column)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """Bytes of every text from its ids."""
        return slices(self.ranks.arrow, ids, bounds)


def slices(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    """For every text, the table's entries at its ids, one after the other."""
    taken = table.take(pa.array(ids.astype(np.int32)))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    data = memoryview(taken.buffers()[2]) if len(ids) else memoryview(b"")
    at = ends[bounds].tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids (array of int) of every whole text; null text: no ids."""
    def run(batches):
        own = encoder(path)
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                ids, bounds = own.encode(b.column(1).slice(i, j - i))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                                 pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists],
                                                 ["doc_id", "ids"])
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids: no bytes."""
    def run(batches):
        own = encoder(path)
        for b in batches:
            lists = [np.asarray(x or [], np.int64) for x in b.column(1).to_pylist()]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            out = own.decode(np.concatenate([np.zeros(0, np.int64), *lists]), bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([bytes(x) for x in out], pa.binary())], ["doc_id", "bytes"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
                       T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Count and digest of every document's ids, and the digest of what they decode to.

    Encoding and decoding happen in one pass over a batch, so ids do not travel."""
    def run(batches):
        own = encoder(path)
        decimals = pa.array([b"%d " % i for i in range(len(own.ranks.token))], pa.binary())
        sha = hashlib.sha256
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                ids, bounds = own.encode(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array(np.diff(bounds)),
                    pa.array([sha(x[:-1]).hexdigest() for x in slices(decimals, ids, bounds)], pa.string()),
                    pa.array([sha(x).hexdigest() for x in own.decode(ids, bounds)], pa.string())],
                    DIGEST.names)
    return texts(docs).mapInArrow(run, DIGEST)
