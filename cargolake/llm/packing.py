"""Best-fit packing of tokenised documents into sequences of a fixed length.

Every document becomes its ids and an end mark; only longer ones are cut, their first piece
taking the remainder. All pieces are packed by one best-fit in decreasing length, at any size of
the table: what best-fit does depends only on how many pieces there are of each length, and
sequences with equal room are alike. So the driver packs a histogram (at most as many rows as a
sequence has places): a segment tree over the remaining capacities counts open sequences and
finds the tightest in logarithmic time, and as many pieces of one length as go the same way go
together. The outcome is a list of runs; it grows with the number of lengths, not of pieces.
Pieces then get a rank within their length from bucket counts, without a task that sees all
pieces of a length, and the run of its rank gives each its sequence and offset.

Ids are those of the ``tokenizers`` library without special tokens added: the name of a special
token within a text is that token, unless ``plain`` takes it for ordinary text. Null and empty
texts are one end mark. Pieces of equal length go by a hash, identifier and place; rows that
repeat are packed each. No row is left out. Columns other than ``doc_id`` and ``text`` are not
looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import chunks, parts, stored, texts
from .pretokens import PieceEncoder

BATCH = 2 << 20
#: Of files that hold ids; half of their bytes are zero.
CODEC = "zstd"
#: Pieces of one length and bucket; their rank is counted in one task.
BUCKET = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Tokens:
    """Ids of texts by a ``tokenizers`` file, through the distinct pieces of a batch."""

    def __init__(self, path: str, plain: bool = False):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole, own = Tokenizer.from_file(path), Tokenizer.from_file(path)
        own.encode_special_tokens = True
        self.special = [] if plain else [t.content for t in self.whole.get_added_tokens_decoder().values()]

        def encode(pieces: list[bytes]) -> list[bytes]:
            found = own.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        self.pieces = PieceEncoder(encode)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the bounds of each text."""
        ids, bounds = self.pieces.ids(column)
        hit = np.zeros(len(column), bool)
        for name in self.special:
            hit |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
        if not hit.any():
            return ids, bounds
        # the few texts that name a special token go to the library whole
        sizes = np.diff(bounds)
        other = {k: np.array(self.whole.encode(column[k].as_py(), add_special_tokens=False).ids, ids.dtype)
                 for k in np.flatnonzero(hit).tolist()}
        parts = [other.get(k, ids[bounds[k]:bounds[k] + sizes[k]]) for k in range(len(column))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


@lru_cache(maxsize=2)
def tokenizer(path: str, plain: bool = False) -> Tokens:
    """One for each worker process."""
    return Tokens(path, plain)


def cut(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of one document; the first may be shorter."""
    n, first = len(ids), len(ids) % size or size
    first = min(first, n)
    return [(0, first), *((a, size) for a in range(first, n, size))]


def tokenised(docs: DataFrame, path: str, size: int = 2048, end: int = 0, plain: bool = False) -> DataFrame:
    """Pieces of every document: place in it and little-endian 32-bit ids."""
    def run(batches):
        own = tokenizer(path, plain)
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                ids, bounds = own.ids(b.column(1).slice(i, j - i))
                rows = []
                for doc, a, z in zip(b.column(0).slice(i, j - i).to_pylist(), bounds, bounds[1:]):
                    mine = np.append(ids[a:z], end).astype("<u4")
                    rows += [(doc, k, s, n, mine[s:s + n].tobytes())
                             for k, (s, n) in enumerate(cut(mine, size))]
                doc, piece, start, length, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])
        pa.default_memory_pool().release_unused()  # the worker lives on through later steps
    return texts(docs).mapInArrow(run, PIECES)


class Capacities:
    """Segment tree over remaining capacities 0..size, counting open sequences of each."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        k = self.width + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity of an open sequence that is at least ``need``; -1 if none."""
        count, k = self.count, self.width + need
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return -1


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Sequence and offset of every piece; lengths in decreasing order."""
    tree, open_at, used, out = Capacities(size), {}, 0, []
    for n in lengths:
        room = tree.tightest(n)
        if room < 0:
            at, room, used = used, size, used + 1
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
        out.append((at, size - room))
        open_at.setdefault(room - n, []).append(at)
        tree.add(room - n, 1)
    return out


def packed_runs(histogram: dict[int, int], size: int) -> np.ndarray:
    """Best-fit of so many pieces of each length, as runs (length, first rank, ranks, first
    sequence, pieces in each, offset): the same as ``best_fit`` one piece after the other.

    A run is a number of sequences of equal room that take ``room // length`` pieces each, as the
    tightest sequence stays the tightest until it is too full; the last one may take fewer.
    """
    tree, open_at, used, out = Capacities(size), {}, 0, []
    for n in sorted(histogram, reverse=True):
        left, rank = histogram[n], 0
        while left:
            room = tree.tightest(n)
            if room < 0:  # none fits: as many new ones as the rest will open
                room, more = size, -(-left // (size // n))
                open_at.setdefault(size, []).append((used, used + more))
                tree.add(size, more)
                used += more
            low, high = open_at[room].pop()
            each = room // n
            bins = min(high - low, left // each)
            taken = bins * each
            if not bins:
                bins, taken = 1, left
                each = left
            out.append((n, rank, taken, low, each, size - room))
            tree.add(room, -bins)
            if low + bins < high:
                open_at[room].append((low + bins, high))
            tree.add(room - each * n, bins)
            open_at.setdefault(room - each * n, []).append((low, low + bins))
            rank, left = rank + taken, left - taken
    return np.array(out, np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``_rank``, from 0 within each length: what the buckets before have and the place in
    its own, so no task sees all pieces of a length."""
    buckets = parts(pieces.count(), BUCKET)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)))
    counts = stored(dealt.groupBy("length", "_bucket").count(), "bucket_counts")
    before = F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")
    bases = counts.select(F.col("length").alias("_length"), F.col("_bucket").alias("_of"), before.alias("_base"))
    place = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*pieces.columns))
    same = (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_of"))
    return (dealt.join(bases.hint("merge"), same).withColumn("_rank", F.col("_base") + place - 1)
            .select(*pieces.columns, "_rank"))


def placed(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id (gapless from 0) and offset to stored pieces (doc_id, piece, length and others)."""
    # at most one row for each length comes to the driver
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = packed_runs(histogram, size)
    columns = pieces.columns
    starts = runs[:, 0] << 48 | runs[:, 1]
    order = np.argsort(starts)
    starts, runs = starts[order], runs[order]

    def assign(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("_rank").to_numpy()
            run = runs[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            at, inside = np.divmod(rank - run[:, 1], run[:, 4])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(run[:, 3] + at), pa.array(run[:, 5] + inside * length)],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked(pieces).mapInArrow(assign, schema)


def pack(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Every piece with its ids, its sequence and its offset there."""
    return placed(stored(tokenised(docs, path, size), "pieces", CODEC), size)


def pack_digests(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """As ``pack`` with a checksum for the ids, which then need not be shuffled."""
    return placed(stored(digested(tokenised(docs, path, size)), "pieces"), size)


def digested(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence (one sequence is at most ``size`` ids)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(inside, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
