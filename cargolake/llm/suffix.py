"""Removal of repeated substrings by sampled suffix arrays in logarithmic index families.

Every string of ``MATCH`` bytes contains the least-hashed of its ``GRAM``-byte substrings, an
anchor, at a place that depends on its content alone; so the suffixes that start at anchors are
enough to find all repeats (about one byte in fourteen starts one). What lies around an anchor
as far as a match through it can reach is its context; texts are thus parsed into overlapping
symbols, and suffixes are ordered by the fingerprints of their symbols, of which one is longer
than a match.

Documents are dealt into blocks, the batches. Each block sorts its suffix keys: its suffix
array. The arrays are dealt by key into parts; a part keeps an index family, adding each array
as a new level and merging levels of like size, so a key takes part in logarithmically many
merges, and scans each array against the levels. What it finds goes back to the block as bits.
Four such steps narrow the work: anchors that another document has; contexts, where equal ones
settle all matches around the anchor at once; anchors that have several contexts; and, of the
first document of each such context only, the single strings of ``MATCH`` bytes.

A key is sent at most once a block, so one that a third of all documents has costs no task more
than one entry a block. Every step is written to the shared folder. Keys have 64 bits; contexts
count only under an anchor that is shared, so two hashes have to collide for a false match.

A null identifier ranks after all others; rows of one identifier do not remove from each other.
Null, empty and short texts are left as they are. Very long texts are read in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import packed, partitions, parts, ragged, stored, text_bytes, texts
from .shingles import mix, prefix_hashes, span_hashes

MATCH, GRAM = 50, 24
REACH = MATCH - GRAM  # how far before its anchor a match can start
BLOCK_BYTES, PART_BYTES = 4 << 20, 16 << 20
PIECE = 1 << 16  # its arrays of numbers stay in the cache, and memory is used again instead of mapped anew
MARGIN = 4 * MATCH
LAST = (1 << 63) - 1
NOWHERE = ~np.uint64(0)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i .. i + width) for every i that has so many elements."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray, bounds: np.ndarray):
    """Places of anchors, their hashes and the hashes of their contexts."""
    n = len(raw)
    if n < MATCH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    prefix = prefix_hashes(raw)
    at = np.arange(n - GRAM + 1)
    gram = span_hashes(prefix, at, at + GRAM)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(n)  # bytes to the text's end
    least = _sliding(gram, REACH + 1, np.minimum)  # one for each start of a match
    least = np.where(left[:len(least)] >= MATCH, least, 0)
    # an anchor is least in some match around it: none of those has a greater least
    around = np.concatenate((np.zeros(REACH, np.uint64), least, np.zeros(len(gram) - len(least), np.uint64)))
    most = _sliding(around, REACH + 1, np.maximum)[:len(gram)]
    place = np.flatnonzero(most == gram)
    text = np.searchsorted(bounds, place, side="right") - 1
    start = np.maximum(place - REACH, bounds[text])
    end = np.minimum(place + MATCH, bounds[text + 1])
    shape = ((place - start) * 64 + (end - place)).astype(np.uint64)
    return place, gram[place], mix(span_hashes(prefix, start, end) ^ mix(shape))


class Block:
    """The documents of one block, ascending, as one array of bytes."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks().sort_by("doc_id")
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        self.raw, self.bounds = packed(text)
        self.ids = table.column("doc_id").to_numpy()

    def pieces(self):
        """Runs of whole texts, or of cut pieces of a long one: (bytes, bounds, offset, core)."""
        held = []

        def joined():
            a, z = self.bounds[held[0]], self.bounds[held[-1] + 1]
            return self.raw[a:z], self.bounds[held[0]:held[-1] + 2] - a, a, (0, z - a)
        total = 0
        for d, size in enumerate(np.diff(self.bounds).tolist()):
            if held and total + size > PIECE:
                yield joined()
                held, total = [], 0
            if size <= PIECE:
                held.append(d)
                total += size
                continue
            for core in range(0, size, PIECE):
                end = min(size, core + PIECE)
                a, z = max(0, core - MARGIN), min(size, end + MARGIN)
                at = int(self.bounds[d]) + a
                yield self.raw[at:at + z - a], np.array([0, z - a]), at, (core - a, end - a)
        if held:
            yield joined()

    def anchors(self):
        """Place, document, anchor hash and context hash of every anchor of the block."""
        found = []
        for raw, bounds, offset, (a, z) in self.pieces():
            place, gram, context = anchors(raw, bounds)
            core = (place >= a) & (place < z)
            found.append((place[core] + offset, gram[core], context[core]))
        place, gram, context = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip(
            (np.int64, np.uint64, np.uint64), zip(*found) if found else ((), (), ())))
        self.place, self.gram, self.context = place, gram, context
        self.doc = np.searchsorted(self.bounds, place, side="right") - 1

    def matches(self, place: np.ndarray):
        """Starts, documents and hashes of all strings of ``MATCH`` bytes around the anchors."""
        start = np.unique((place[:, None] - np.arange(REACH + 1)).ravel())
        start = start[start >= 0]
        doc = np.searchsorted(self.bounds, start, side="right") - 1
        ok = start + MATCH <= self.bounds[doc + 1]
        start, doc = start[ok], doc[ok]
        out = np.zeros(len(start), np.uint64)
        for a in range(0, len(self.raw), PIECE):
            i, j = np.searchsorted(start, [a, a + PIECE])
            if i < j:
                prefix = prefix_hashes(self.raw[a:a + PIECE + MATCH])
                out[i:j] = span_hashes(prefix, start[i:j] - a, start[i:j] - a + MATCH)
        return start, doc, out


def _unique(keys: np.ndarray, ids: np.ndarray):
    """Sorted distinct keys, each entry's index there, and the least and greatest id of each."""
    distinct, index = np.unique(keys, return_inverse=True)
    low, high = np.full(len(distinct), LAST), np.full(len(distinct), -LAST - 1)
    np.minimum.at(low, index, ids)
    np.maximum.at(high, index, ids)
    return distinct, index, low, high


class Family:
    """Levels of sorted keys with a value each; levels of like size merge."""

    def __init__(self, combine):
        self.combine, self.levels = combine, []

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(keys):
            keys, values = self._merged(*self.levels.pop(), keys, values)
        self.levels.append((keys, values))

    def _merged(self, a, x, b, y):
        keys = np.concatenate((a, b))
        order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
        keys, values = keys[order], np.concatenate((x, y))[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], self.combine.reduceat(values, first)

    def scan(self, keys: np.ndarray, start) -> np.ndarray:
        """The combined value of every key over all levels."""
        out = np.full(len(keys), start)
        for level, values in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hit = level[at] == keys
            out[hit] = self.combine(out[hit], values[at[hit]])
        return out


SENT = "part long, block long, keys binary, owners binary"
BITS = "step int, part long, block long, bits binary"


def _split(keys: np.ndarray, n_parts: int):
    """Part of every key, and for each part the indices of its keys, ascending."""
    part = (keys % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    here, first = np.unique(part[order], return_index=True)
    return zip(here.tolist(), np.split(order, first[1:]))


def _answers(step: int, owners: bool):
    """Scan the arrays of a part against their index family: one bit for each key sent.

    With owners: a smaller document elsewhere has the key. Without: another block has it."""
    def run(batches):
        family, arrays = Family(np.minimum if owners else np.add), []
        for b in batches:
            for part, block, keys, own in zip(*(c.to_pylist() for c in b.columns)):
                keys = np.frombuffer(keys, np.uint64)
                value = np.frombuffer(own, np.int64) if owners else np.ones(len(keys), np.int64)
                arrays.append((part, block, keys, value))
                family.add(keys, value)
        rows = []
        for part, block, keys, value in arrays:
            found = family.scan(keys, LAST if owners else 0)
            rows.append((step, part, block, np.packbits(found < value if owners else found > 1).tobytes()))
        for k in range(0, len(rows), 4096):
            columns = zip(*rows[k:k + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["step", "part", "block", "bits"])
    return run


class Run:
    """What a block knows after the steps so far."""

    def __init__(self, left: pa.Table, right: pa.Table, n_parts: int):
        self.block, self.n_parts = Block(left), n_parts
        self.bits = {(s, p): b for s, p, b in zip(*(right.column(c).to_pylist() for c in ("step", "part", "bits")))} \
            if right.num_rows else {}
        self.block.anchors()
        b = self.block
        ids = b.ids[b.doc]
        # 1: anchors that another document has
        self.sent = {1: _unique(b.gram, ids)}
        if not right.num_rows:
            return
        keys, index, low, high = self.sent[1]
        shared = (self.flags(1) | (low < high))[index]
        self.place, self.doc, gram, context = (x[shared] for x in (b.place, b.doc, b.gram, b.context))
        ids = ids[shared]
        # 2: contexts, with the least document that has each
        self.sent[2] = _unique(context, ids)
        if not self.has(2):
            return
        keys, index, low, _ = self.sent[2]
        self.gone = self.flags(2)[index] | (ids > low[index])
        first = ~self.gone
        # 3: anchors that have several contexts, counting each with its first document
        gram, context, ids = gram[first], context[first], ids[first]
        index1 = np.unique(gram, return_inverse=True)
        low = np.full(len(index1[0]), NOWHERE)
        high = np.zeros(len(index1[0]), np.uint64)
        np.minimum.at(low, index1[1], context)
        np.maximum.at(high, index1[1], context)
        self.sent[3] = (*index1, low, high)
        if not self.has(3):
            return
        mixed = (self.flags(3) | (low < high))[index1[1]]
        # 4: the single strings around those anchors
        self.start, doc, keys = b.matches(self.place[first][mixed])
        self.sent[4] = _unique(keys, b.ids[doc])
        if not self.has(4):
            return
        _, index, low, _ = self.sent[4]
        self.start = self.start[self.flags(4)[index] | (b.ids[doc] > low[index])]

    def has(self, step: int) -> bool:
        return any(s == step for s, _ in self.bits) or not len(self.sent[step][0])

    def flags(self, step: int) -> np.ndarray:
        keys = self.sent[step][0]
        out = np.zeros(len(keys), bool)
        for part, where in _split(keys, self.n_parts):
            bits = np.frombuffer(self.bits[step, part], np.uint8)
            out[where] = np.unpackbits(bits, count=len(where)).astype(bool)
        return out

    def removed(self) -> np.ndarray:
        """Which bytes of the block go."""
        b = self.block
        edge = np.zeros(len(b.raw) + 1, np.int64)
        if hasattr(self, "gone"):
            place, doc = self.place[self.gone], self.doc[self.gone]
            np.add.at(edge, np.maximum(place - REACH, b.bounds[doc]), 1)
            np.add.at(edge, np.minimum(place + MATCH, b.bounds[doc + 1]), -1)
        if hasattr(self, "start"):
            np.add.at(edge, self.start, 1)
            np.add.at(edge, self.start + MATCH, -1)
        return np.cumsum(edge)[:-1] > 0


def _sends(step: int, n_parts: int):
    def send(run: Run, block: int) -> pa.Table:
        keys, _, low, _ = run.sent.get(step, (np.zeros(0, np.uint64), None, np.zeros(0, np.int64), None))
        rows = [(part, block, keys[w].tobytes(), low[w].tobytes() if step in (2, 4) else b"")
                for part, w in _split(keys, n_parts)]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (
            pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "keys", "owners"])
    return send


def _steps(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their block, the bits of all four steps, and the number of parts."""
    total = text_bytes(rows)
    n_blocks, n_parts = parts(total, BLOCK_BYTES), partitions(total, PART_BYTES)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"),
                        F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", "row")
    empty = pa.table({c: pa.array([], t) for c, t in (("step", pa.int32()), ("part", pa.int64()), ("bits", pa.binary()))})
    bits = None
    for step in range(1, 5):
        send = _sends(step, n_parts)
        if bits is None:
            def first(table: pa.Table) -> pa.Table:
                return send(Run(table, empty, n_parts), table.column("block")[0].as_py())
            sent = dealt.groupBy("block").applyInArrow(first, SENT)
        else:
            def later(key, left: pa.Table, right: pa.Table) -> pa.Table:
                return send(Run(left, right, n_parts), key[0].as_py())
            sent = dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(later, SENT)
        answers = sent.repartition(n_parts, "part").mapInArrow(_answers(step, step in (2, 4)), BITS)
        found = stored(answers, f"bits{step}")
        bits = found if bits is None else bits.union(found)
    return dealt, bits, n_parts


def removals(docs: DataFrame, kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes) and kept_sha256 of every row;
    with ``kept`` also the bytes that are left."""
    rows = texts(docs).withColumn("row", F.col("doc_id").isNull())
    dealt, bits, n_parts = _steps(rows)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        run = Run(left, right, n_parts)
        b, gone = run.block, run.removed()
        order = left.combine_chunks().sort_by("doc_id")
        out = []
        for (a, z), doc, null in zip(zip(b.bounds.tolist(), b.bounds[1:].tolist()), b.ids.tolist(),
                                     order.column("row").to_pylist()):
            flags = np.concatenate(([False], gone[a:z], [False])).astype(np.int8)
            turn = np.diff(flags)
            spans = list(zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()))
            left_over = b.raw[a:z][~gone[a:z]].tobytes()
            out.append((None if null else doc, z - a, int(gone[a:z].sum()), [{"start": s, "end": e} for s, e in spans],
                        hashlib.sha256(left_over).hexdigest(), left_over if kept else None))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, (
            pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()))],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])
    schema = ("doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, "
              "kept_sha256 string, kept binary")
    return dealt.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(finish, schema)
