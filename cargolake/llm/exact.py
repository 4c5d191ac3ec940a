"""Exact dedup by owners kept in Patricia tries.

Texts are equal when their normalised bytes are. They are dealt by length and content hash;
each task inserts the full byte strings into a compressed radix trie whose terminal nodes hold
the number of rows and the extreme identifiers. A trie that outgrows its budget gives up its
largest subtree: the terminal entries there go on as partial owners, which a last grouping by
digest merges, so memory is bounded and no entry is lost. Every map task collapses its own
copies in such a trie first, so a text of which there are millions sends a row or so a task.

Null counts as an empty text; a null identifier is below every other. Repeated rows (same
identifier and text) form a group like others and share its owner.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, partitions, stored, text_bytes, texts

#: Bytes of labels and nodes that a task's trie may hold.
BUDGET = 48 << 20
NODE = 300
TASK_BYTES = 16 << 20
#: Bytes of a batch's texts that are Python objects at a time.
SLICE = 2 << 20
ENTRY = "size int, text_hash long, text binary, low long, high long, rows long"
OWNER = "text_sha256 string, low long, high long, rows long"


def normalised(text: Column) -> Column:
    """Lower-case A to Z, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


class Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry=None):
        self.label, self.children, self.entry = label, {}, entry


class Trie:
    """Compressed radix trie over byte strings; entries are ``[low, high, rows]``."""

    def __init__(self, budget: int = BUDGET):
        self.root, self.held, self.budget = Node(b""), 0, budget

    def add(self, key: bytes, low, high, rows: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.label) + NODE
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low_k, high_k = 1, min(len(label), len(key) - at)
            while low_k < high_k:  # longest common prefix by halving
                k = (low_k + high_k + 1) // 2
                if key.startswith(label[:k], at):
                    low_k = k
                else:
                    high_k = k - 1
            upper = Node(label[:low_k])
            node.children[key[at]] = upper
            child.label = label[low_k:]
            upper.children[child.label[0]] = child
            self.held += NODE
            node, at = upper, at + low_k
        if node.entry is None:
            node.entry = [low, high, rows]
        else:
            e = node.entry
            e[0], e[1], e[2] = least(e[0], low), most(e[1], high), e[2] + rows

    def entries(self, node: Node, prefix: bytes):
        """Terminal entries below a node, with their full strings."""
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.entry is not None:
                yield prefix, node.entry
            todo += [(c, prefix + c.label) for c in node.children.values()]

    def weight(self, node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE
            todo += x.children.values()
        return total

    def spill(self):
        """Give up the heaviest subtree below the root while the trie is over its budget."""
        while self.held > self.budget and self.root.children:
            weights = {k: self.weight(c) for k, c in self.root.children.items()}
            key = max(weights, key=weights.get)
            child = self.root.children.pop(key)
            self.held -= weights[key]
            yield from self.entries(child, child.label)

    def drain(self):
        yield from self.entries(self.root, b"")
        self.root, self.held = Node(b""), 0


def least(a, b):
    return None if a is None or b is None else min(a, b)


def most(a, b):
    return b if a is None else a if b is None else max(a, b)


def batches_of(rows, make, size: int = 4 << 20):
    """Record batches of about so many bytes of text."""
    held, total = [], 0
    for text, entry in rows:
        held.append((text, *entry))
        total += len(text) + 64
        if total > size:
            yield make(held)
            held, total = [], 0
    if held:
        yield make(held)


def as_entries(rows) -> pa.RecordBatch:
    import xxhash
    text, low, high, n = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(list(map(len, text)), pa.int32()),
        pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in text], pa.int64()),
        pa.array(text, pa.binary()), *(pa.array(x, pa.int64()) for x in (low, high, n))],
        ["size", "text_hash", "text", "low", "high", "rows"])


def as_owners(rows) -> pa.RecordBatch:
    text, low, high, n = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
        *(pa.array(x, pa.int64()) for x in (low, high, n))], ["text_sha256", "low", "high", "rows"])


def collapse(make, budget: int):
    """A mapInArrow function: (text, low, high, rows) to merged entries."""
    def run(batches):
        trie = Trie(budget)

        def merged():
            for b in batches:
                for i, j in chunks(b.column(0), SLICE):
                    for t, a, z, k in zip(*(c.slice(i, j - i).to_pylist() for c in b.columns)):
                        trie.add(t, a, z, k)
                        if trie.held > trie.budget:
                            yield from trie.spill()
            yield from trie.drain()
        yield from batches_of(merged(), make)
    return run


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row for each distinct text: digest, least and greatest identifier, rows."""
    rows = texts(docs)
    keyed = rows.select(normalised(F.col("text")).cast("binary").alias("text"),
                        F.col("doc_id").alias("low"), F.col("doc_id").alias("high"),
                        F.lit(1).cast("long").alias("rows"))
    local = keyed.mapInArrow(collapse(as_entries, budget), ENTRY)
    dealt = local.repartition(partitions(text_bytes(rows), TASK_BYTES), "size", "text_hash")
    found = dealt.select("text", "low", "high", "rows").mapInArrow(collapse(as_owners, budget), OWNER)
    # a null identifier is below every other, so it makes the least one null
    low = F.when(F.count("low") < F.count(F.lit(1)), None).otherwise(F.min("low"))
    return found.groupBy("text_sha256").agg(low.alias("low"), F.max("high").alias("high"),
                                            F.sum("rows").alias("group_size"))


def groups(docs: DataFrame, keep: str = "high", budget: int = BUDGET) -> DataFrame:
    """Every row with the identifier that stays (``high`` or ``low``), its group's size and digest."""
    table = stored(owners(docs, budget), "owners").select(
        "text_sha256", F.col(keep).alias("keep_id"), "group_size")
    rows = texts(docs).select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    return rows.join(table, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, keep: str = "high", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, all their columns; of repeated rows with the owner's identifier one."""
    kept = stored(groups(docs, keep, budget).where("kept").groupBy("doc_id", "text_sha256").count(), "kept")
    digest = F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    columns = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"),
                       F.col("doc_id").cast("long").alias("_id"), digest.alias("_digest"))
    kept = kept.select(F.col("doc_id").alias("_kept"), "text_sha256", "count").hint("merge")
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("text_sha256"))
    found = rows.join(kept, same).select("_row", "_id", "_digest", "count")
    once, several = found.where("count = 1"), found.where("count > 1")
    one = several.groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return once.select("_row.*").unionByName(one.select("_row.*"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
         AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
