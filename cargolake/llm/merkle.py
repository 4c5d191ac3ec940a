"""Document fingerprints as Merkle trees over sections, paragraphs and runs of words.

A section is what stands between empty lines, a paragraph a line; a paragraph is cut into runs
of characters, the leaves, short ones first (``LEAVES``, then as long as the last), so that also
a short text has several. A node's hash covers the hashes below it, so equal roots mean
equal texts, and where roots differ the comparison goes down only into branches that differ.
The fingerprint is the root, followed by each section with its paragraphs and their leaves
(weight in characters and hash). Likeness of two fingerprints is the share of characters under
hashes that both have, taken level by level: equal sections count whole, then equal paragraphs
of the rest, then equal leaves of the rest.

The edited text that the registered query asks for needs each document's successor in
descending order of identifier. Rows are dealt into ranges of identifiers and sorted there; the
first document of a range is also sent to the range before it, so each text is shuffled once.
Null identifiers come last; rows of one identifier are ordered by a hash of their text. An
empty or null text has a root and no sections; two such are alike.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import parts, text_bytes, texts

LEAVES = (4, 4, 8, 8, 16, 16, 32, 32, 48)
RANGE_BYTES = 8 << 20
#: Beyond half a terabyte ranges grow instead; they are sorted and streamed, never held.
MOST_RANGES = 65_536
#: Bytes of a hash within the tree and of what is kept of a leaf's; the root has 16.
WIDE, SHORT = 8, 5


def _hash(parts_: list[bytes], level: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts_), digest_size=WIDE, person=level).digest()


def cuts(n: int) -> list[tuple[int, int]]:
    """Bounds of the leaves of a paragraph of n characters."""
    out, a, k = [], 0, 0
    while a < n:
        z = min(n, a + LEAVES[min(k, len(LEAVES) - 1)])
        out.append((a, z))
        a, k = z, k + 1
    return out


class Tree:
    """root: hex; sections: list of (weight, hash, [(weight, hash, [(weight, hash)])])."""

    __slots__ = ("root", "sections")

    def __init__(self, text: str):
        self.sections = []
        paragraphs: list = []
        leaf = xxhash.xxh3_64_digest
        for line in text.split("\n"):
            if not line and paragraphs and paragraphs[-1][0]:
                self._close(paragraphs)
                paragraphs = []
            full = [leaf(line[a:z].encode()) for a, z in cuts(len(line))]
            leaves = [(z - a, h[:SHORT]) for (a, z), h in zip(cuts(len(line)), full)]
            paragraphs.append((len(line), _hash([str(len(line)).encode(), *full], b"paragraph"), leaves))
        if text:
            self._close(paragraphs)
        whole = [str(len(text)).encode(), *(h for _, h, _ in self.sections)]
        self.root = hashlib.blake2b(b"|".join(whole), digest_size=16, person=b"root").hexdigest()

    def _close(self, paragraphs: list) -> None:
        self.sections.append((sum(w for w, _, _ in paragraphs),
                              _hash([h for _, h, _ in paragraphs], b"section"), paragraphs))

    def __str__(self) -> str:
        return self.root + "".join(
            f"/{w}.{h.hex()}" + "".join(f";{pw}.{ph.hex()}" + "".join(f",{lw}.{lh.hex()}" for lw, lh in leaves)
                                         for pw, ph, leaves in paragraphs)
            for w, h, paragraphs in self.sections)

    @classmethod
    def parse(cls, fingerprint: str) -> "Tree":
        own = cls.__new__(cls)
        own.root, *sections = fingerprint.split("/")

        def node(x: str) -> tuple[int, bytes]:
            weight, digest = x.split(".")
            return int(weight), bytes.fromhex(digest)
        own.sections = []
        for section in sections:
            head, *paragraphs = section.split(";")
            own.sections.append((*node(head), [(*node(first), [node(x) for x in leaves]) for first, *leaves in
                                               (p.split(",") for p in paragraphs)]))
        return own


def _rest(a: list, b: list) -> tuple[int, list, list]:
    """Weight of what two lists of nodes share, and the nodes that are left of each."""
    both = Counter(x[1] for x in a) & Counter(x[1] for x in b)
    shared, left = 0, []
    for side in (a, b):
        todo, rest = both.copy(), []
        for x in side:
            if todo[x[1]] > 0:
                todo[x[1]] -= 1
                shared += x[0] if side is a else 0
            else:
                rest.append(x)
        left.append(rest)
    return shared, left[0], left[1]


def likeness(a: Tree, b: Tree) -> float:
    """0 to 1; 1 for equal roots. Goes down only where hashes differ."""
    if a.root == b.root:
        return 1.0
    total = max(sum(s[0] for s in a.sections), sum(s[0] for s in b.sections))
    if not total:
        return 0.0
    shared, left, right = _rest(a.sections, b.sections)
    for _ in range(2):
        more, left, right = _rest([c for x in left for c in x[2]], [c for x in right for c in x[2]])
        shared += more
    return min(shared / total, 1 - 1e-9)


def differences(a: Tree, b: Tree) -> list[int]:
    """Places of the leaves of ``b`` under branches that ``a`` has not: where edits are."""
    old_sections = {s[1] for s in a.sections}
    old_paragraphs = {p[1] for s in a.sections for p in s[2]}
    old_leaves = {x[1] for s in a.sections for p in s[2] for x in p[2]}
    out, at = [], 0
    for _, section, paragraphs in b.sections:
        for _, paragraph, leaves in paragraphs:
            if section not in old_sections and paragraph not in old_paragraphs:
                out += [at + i for i, (_, leaf) in enumerate(leaves) if leaf not in old_leaves]
            at += len(leaves)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                some = b.slice(k, 1024)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([str(Tree(t)) for t in some.column(1).to_pylist()], pa.string())],
                    ["doc_id", "fingerprint"])
    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses to that and to the next document."""
    rows = texts(docs)
    ranges = min(MOST_RANGES, parts(text_bytes(rows), RANGE_BYTES))
    # bounds of the ranges: one number for each partition, not for each row
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set((rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []) if shares else []))
    # range 0 has the greatest identifiers; null is below all. Bounds are searched in two
    # steps: which block of them, then where in the block
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    longs = lambda x: F.lit(x).cast("array<long>") if x else F.array().cast("array<long>")
    at = F.col("doc_id")
    passed = F.size(F.filter(longs([b[-1] for b in blocks]), lambda x: x <= at))
    block = F.get(F.array(*map(longs, [*blocks, []])), passed)
    below = passed * step + F.size(F.filter(block, lambda x: x <= at))
    bucket = F.when(at.isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - F.least(below, F.lit(len(bounds))))
    heads = (rows.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).orderBy("bucket").collect())
    order = [(r["bucket"], r["head"]) for r in heads]
    # each range's first document goes to the range before as well; the very first after the last
    before = [0] * (len(bounds) + 2)
    for k, (own, _) in enumerate(order):
        before[own] = order[k - 1][0]
    rows = rows.withColumn("bucket", bucket)
    first = F.col("doc_id").isin([h for _, h in order if h is not None])
    if any(h is None for _, h in order):
        first = F.col("doc_id").isNull() | F.coalesce(first, F.lit(False))
    target = F.when(first, F.get(F.lit(before), F.col("bucket")))
    copies = F.when(target.isNull(), F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")),
                F.struct(target.cast("int").alias("to"), F.lit(True).alias("guest"))))
    dealt = (rows.withColumn("copy", F.explode(copies))
             .select(F.col("copy.to").alias("to"), F.col("copy.guest").alias("guest"), "doc_id", "text",
                     F.xxhash64("text").alias("tie"))
             .repartitionById(len(bounds) + 2, F.col("to").cast("int"))
             .sortWithinPartitions("to", "guest", F.col("doc_id").desc_nulls_last(), "tie"))

    def run(batches):
        yield from _edited(_stream(batches))
    return dealt.select("to", "guest", "doc_id", "text").mapInArrow(run, EDITED)


def _stream(batches) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 256).columns))


def _edited(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows by range, own ones first and in order, then the guests; only the first guest counts."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held, size = [], 0
    last = None  # (range, doc_id, text, tree) still without its successor
    for to, guest, doc, text in rows:
        if guest and (last is None or last[0] != to):
            continue
        tree = Tree(text)
        if last is not None:
            _, own_id, own, own_tree = last
            new = edited_text(own, text)
            new_tree = Tree(new)
            held.append((own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), str(own_tree), str(new_tree),
                         likeness(own_tree, new_tree), likeness(own_tree, tree)))
            size += len(held[-1][3]) + len(held[-1][4])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
                held, size = [], 0
        last = None if guest else (to, doc, text, tree)
    if held:
        columns = [pa.array(c, t) for c, t in zip(zip(*held), (
            pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names)
