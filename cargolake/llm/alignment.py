"""Cross-tokenizer alignment by diagonal run skipping.

Both tokenizers cut the same bytes, a blank and the text; byte offsets at which tokens of both
end cut these into groups. ``runs`` walks two lists of token ends: as long as the ends at the
current index shift agree, doubling stretches are compared at once and the last one is halved
down to the first difference, so one-to-one stretches are jumped over; an irregular group is
resolved by moving the side that is behind, and leaves a new shift.

Corpus-wide counts of linked id pairs never gather documents: a block of documents (at most
``BLOCK`` bytes of text, or one longer text) counts its own pairs first and sends each of them
once; pairs are summed, and the sums go back to the blocks that asked for them.

A null or empty text, and one whose token bytes differ from blank and text on either side, has
no tokens: zeros and an empty digest. Rows that repeat, also with equal identifiers or none,
count as a document each. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .bpe import slices
from .common import chunks, packed, ragged, stored, texts
from .pretokens import PieceEncoder

#: Bytes of text whose pairs are counted together, and which are tokenised together.
BLOCK, BATCH = 8 << 20, 1 << 20
#: Groups of more links than this are multiplied out by distinct ids.
WIDE = 64
ALIGNED = "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>"
PER_DOC = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "known binary, times binary")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable characters of
    Latin-1 are themselves, all other bytes follow in order from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary in the ``tokenizers`` format."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            special = {t["id"]: t["content"] for t in json.load(f).get("added_tokens", [])}
        letters = byte_letters()
        self.token = [b""] * own.get_vocab_size()
        for name, i in own.get_vocab().items():
            self.token[i] = (special[i].encode() if i in special
                             else bytes(letters[c] for c in name))

        def encode(pieces: list[bytes]) -> list[bytes]:
            found = own.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() for x in found]
        self.pieces = PieceEncoder(encode)

    def ids(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.ids(pa.array(lines, pa.large_string()))


class Pieces:
    """Ids and token bytes of a ``sentencepiece`` vocabulary, which puts the blank itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token = []
        for i in range(self.own.get_piece_size()):
            name = self.own.id_to_piece(i)
            self.token.append(bytes([int(name[3:5], 16)]) if self.own.is_byte(i)
                              else name.replace("▁", " ").encode())

    def ids(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x, np.uint32) for x in self.own.encode(lines, num_threads=1)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *found]), bounds


def runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Groups of two lists of ascending ends with one last value, as (i, j, n): for k < n a group
    ends with the tokens ``i + k`` and ``j + k``, and those after the first are one to one."""
    i = j = 0
    n, out = len(a), []
    while i < n:
        if a[i] != b[j]:  # an irregular group: the side behind moves on, and the shift with it
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
        # along the diagonal from here: stretches double while they agree
        size, step = 1, 1
        while a[i + size:i + size + step] == b[j + size:j + size + step] and i + size < n:
            size += step
            step *= 2
        size = min(size, n - i)
        low, high = 0, min(step, n - i - size)
        while low < high:  # the first difference within the last stretch
            k = (low + high + 1) // 2
            if a[i + size:i + size + k] == b[j + size:j + size + k]:
                low = k
            else:
                high = k - 1
        size += low
        out.append((i, j, size))
        i, j = i + size, j + size
    return out


class Aligned:
    """Tokens and groups of a list of texts; texts without tokens have none of either."""

    def __init__(self, column: pa.Array, left: ByteLevel, right: Pieces, a_bytes: pa.Array, b_bytes: pa.Array,
                 a_size: np.ndarray, b_size: np.ndarray):
        lines = column.to_pylist()
        a, a_at = left.ids([" " + x for x in lines])
        b, b_at = right.ids(lines)
        whole = [(" " + x).encode() for x in lines]
        good = np.array([bool(x) and bytes(s) == w == bytes(t) for x, w, s, t in zip(
            lines, whole, slices(a_bytes, a, a_at), slices(b_bytes, b, b_at))], bool)
        self.a, self.a_at = self._only(a, a_at, good)
        self.b, self.b_at = self._only(b, b_at, good)
        ends = [np.cumsum(s[x]) for s, x in ((a_size, self.a), (b_size, self.b))]
        found, counts = [], []
        for p, q, r, s in zip(self.a_at[:-1].tolist(), self.a_at[1:].tolist(),
                              self.b_at[:-1].tolist(), self.b_at[1:].tolist()):
            # ends of all texts run on, on both sides alike, so a text needs no start of its own
            own = runs(ends[0][p:q].tolist(), ends[1][r:s].tolist())
            found += [(i + p, j + r, n) for i, j, n in own]
            counts.append(sum(x[2] for x in own))
        i, j, n = np.array(found, np.int64).reshape(-1, 3).T
        self.a_last, self.b_last = ragged(i, n), ragged(j, n)
        self.groups = np.array(counts, np.int64)
        self.a_n = np.diff(self.a_last, prepend=-1)
        self.b_n = np.diff(self.b_last, prepend=-1)

    @staticmethod
    def _only(ids, at, good):
        sizes = np.where(good, np.diff(at), 0)
        return ids[ragged(at[:-1], sizes)].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))

    def written(self, shown: pa.Array, ids: int) -> list[bytes]:
        """Groups of every text as ``a1,a2|b1;a3|b2``; ``shown`` holds ids before a comma, a bar
        and a semicolon, ``ids`` of each."""
        mixed = np.zeros(len(self.a) + len(self.b), np.int64)
        a_place = np.arange(len(self.a)) + np.repeat(self.b_last + 1 - self.b_n, self.a_n)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_last + 1, self.b_n)
        mixed[a_place], mixed[b_place] = self.a, self.b
        mixed[a_place[self.a_last]] += ids
        mixed[b_place[self.b_last]] += 2 * ids
        return [bytes(x)[:-1] for x in slices(shown, mixed, self.a_at + self.b_at)]

    def links(self, right_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of every linked pair of ids, ascending; pair = a * right_ids + b."""
        doc = np.repeat(np.arange(len(self.groups)), self.groups)
        size = self.a_n * self.b_n
        first_a, first_b = self.a_last + 1 - self.a_n, self.b_last + 1 - self.b_n
        some = np.flatnonzero(size <= WIDE)
        inner = ragged(np.zeros(len(some), np.int64), size[some])
        group = np.repeat(some, size[some])
        at, rest = np.divmod(inner, self.b_n[group])
        docs = [doc[group]]
        pairs = [self.a[first_a[group] + at] * right_ids + self.b[first_b[group] + rest]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(size > WIDE).tolist():
            x, n = np.unique(self.a[first_a[g]:self.a_last[g] + 1], return_counts=True)
            y, m = np.unique(self.b[first_b[g]:self.b_last[g] + 1], return_counts=True)
            docs.append(np.full(len(x) * len(y), doc[g]))
            pairs.append((x[:, None] * right_ids + y).ravel())
            times.append((n[:, None] * m).ravel())
        doc, pair, times = map(np.concatenate, (docs, pairs, times))
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
        starts = np.flatnonzero(new)
        return doc[starts], pair[starts], np.add.reduceat(times, starts) if len(starts) else times


class Aligner:
    """Two tokenizers with the bytes of their tokens."""

    def __init__(self, left: str, right: str):
        self.left, self.right = ByteLevel(left), Pieces(right)
        self.a_bytes, self.b_bytes = (pa.array(x.token, pa.binary()) for x in (self.left, self.right))
        self.a_size, self.b_size = (np.array([len(t) for t in x.token], np.int64) for x in (self.left, self.right))
        self.right_ids = len(self.right.token)
        self.ids = max(len(self.left.token), self.right_ids)
        self.shown = pa.array([b"%d%c" % (i, c) for c in b",|;" for i in range(self.ids)], pa.binary())

    def __call__(self, column: pa.Array) -> Aligned:
        return Aligned(column, self.left, self.right, self.a_bytes, self.b_bytes, self.a_size, self.b_size)


@lru_cache(maxsize=1)
def aligner(left: str, right: str) -> Aligner:
    """One for each worker process."""
    return Aligner(left, right)


def align(docs: DataFrame, left: str, right: str) -> DataFrame:
    """doc_id, both lists of ids, and for every group the number of ids up to its end on each side."""
    def run(batches):
        own = aligner(left, right)
        for batch in batches:
            for i, j in chunks(batch.column(1), BATCH):
                x = own(batch.column(1).slice(i, j - i))
                at = np.concatenate(([0], np.cumsum(x.groups)))

                def lists(values, bounds):
                    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), lists(x.a, x.a_at), lists(x.b, x.b_at),
                    lists(x.a_last + 1 - np.repeat(x.a_at[:-1], x.groups), at),
                    lists(x.b_last + 1 - np.repeat(x.b_at[:-1], x.groups), at)],
                    ["doc_id", "a", "b", "a_ends", "b_ends"])
    return texts(docs).mapInArrow(run, ALIGNED)


def linked(docs: DataFrame, left: str, right: str) -> DataFrame:
    """For every document counts, digest and its pairs, as places in its block's list with how
    often each; and for every block one row with that list, ascending, and in how many of the
    block's documents each pair is."""
    def run(batches):
        own = aligner(left, right)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in chunks(batch.column(1), BLOCK):
                ids = batch.column(0).slice(i, j - i)
                column = batch.column(1).slice(i, j - i)
                counts, digests, found, n = [], [], [], 0
                for p, q in chunks(column, BATCH):
                    x = own(column.slice(p, q - p))
                    doc, pair, times = x.links(own.right_ids)
                    found.append((doc + n, pair, times))
                    links = np.zeros(q - p, np.int64)
                    np.add.at(links, doc, times)
                    counts.append((np.diff(x.a_at), np.diff(x.b_at), x.groups, links))
                    digests += [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(own.shown, own.ids)]
                    n += q - p
                doc, pair, times = (np.concatenate(c) for c in zip(*found))
                block_pairs, place, in_docs = np.unique(pair, return_inverse=True, return_counts=True)
                at = np.searchsorted(doc, np.arange(n + 1)) * 4
                known, often = place.astype("<u4").tobytes(), times.astype("<u4").tobytes()
                empty = pa.nulls(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, number)), ids, *(pa.array(np.concatenate(c)) for c in zip(*counts)),
                    pa.array(digests, pa.string()), *(pa.array([b[s:e] for s, e in zip(at, at[1:])], pa.binary())
                                                      for b in (known, often)),
                    empty.cast(pa.list_(pa.int64())), empty.cast(pa.list_(pa.int64()))], names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), *(pa.nulls(1).cast(t) for t in [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 2),
                    pa.array([block_pairs]), pa.array([in_docs])], names)
                number += 1
    names = ["block", *(c.split()[0] for c in PER_DOC.split(", ")), "pairs", "in_docs"]
    return texts(docs).mapInArrow(run, f"block long, {PER_DOC}, pairs array<long>, in_docs array<long>")


def pair_counts(messages: DataFrame, right_ids: int) -> DataFrame:
    """pair, its number of documents, and whether no pair of the same left id is in more.

    A window holds one left id, so at most as many rows as the right vocabulary has ids."""
    counts = messages.groupBy("pair").agg(F.sum("n").alias("count"))
    top = F.max("count").over(W.partitionBy(F.expr(f"pair div {right_ids}")))
    return counts.withColumn("best", F.col("count") == top)


def digests(docs: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of every document's alignment, and how common its links are in all documents."""
    rows = stored(linked(docs, left, right), "linked")
    right_ids = len(Pieces(right).token)
    messages = (rows.where("pairs is not null")
                .select("block", F.explode(F.arrays_zip("pairs", "in_docs")).alias("x"))
                .select("block", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("n")))
    counts = stored(pair_counts(messages, right_ids), "pair_counts")
    answers = messages.select("block", "pair").join(counts.hint("merge"), "pair").select(
        F.col("block").alias("asked_by"), "pair", "count", "best")
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def summed(own, told):
        told = told.sort_by("pair")
        count = told.column("count").to_numpy()
        best = told.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        known, times = own.column("known").combine_chunks(), own.column("times").combine_chunks()
        place, at = packed(known)
        place = np.frombuffer(place.tobytes(), "<u4").astype(np.int64)
        often = np.frombuffer(packed(times)[0].tobytes(), "<u4").astype(np.int64)
        at = at // 4
        before = [np.concatenate(([0], np.cumsum(often * x[place]))) for x in (best, count)]
        sums = [pa.array(x[at[1:]] - x[at[:-1]]) for x in before]
        return pa.table([*(own.column(c) for c in plain), *sums, own.column("groups_sha256")],
                        [*plain, "n_best", "count_sum", "groups_sha256"])

    per_doc = rows.where("pairs is null").select("block", *plain, "groups_sha256", "known", "times")
    return per_doc.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(
        summed, ", ".join(f"{c} long" for c in [*plain, "n_best", "count_sum"]) + ", groups_sha256 string")
