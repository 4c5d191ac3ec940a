"""Benchmark decontamination by a positional inverted index over the training documents.

``build`` writes the index: for every block of documents (at most ``BLOCK`` bytes of text, or
one longer text) a row for each word with all places of it, and one row with the block's
documents. Places of a block run on over its documents with a gap between two, so no phrase
crosses from one to the next. A frequent word is a row in every block, never one long list.

A search reads only the rows of its own words. A phrase starts from the word that is rarest in
the whole corpus, and goes to those blocks alone that have it; there the list of each further
word, the rarer first, shifted by its offset in the phrase, is intersected with the starts that
are left. Phrases of which a word is nowhere in the corpus are not looked for. ``phrases`` gives
exact matches, ``proximity`` places where all words of a phrase stand close together in any
order, ``contamination`` the words of every document that phrases of a benchmark cover.

Words are runs of letters, digits and all characters beyond ASCII, A to Z in lower case. Null
and empty texts have no words. Rows that repeat are documents each. Items of one id are one
item; an item without an id marks words, but is not counted or named. Documents and items may be
empty tables. Columns other than ``doc_id``, ``item_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import chunks, packed, ragged, stored, texts

BLOCK = 8 << 20
WINDOW = 10
#: Starts that are followed up at a time.
STARTS = 2_000_000
INDEX = "block long, term string, n long, places binary, doc_ids array<long>, n_words array<long>"
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SHIFT = np.int64(32)


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in order, and the index of each text's first word (and the end)."""
    raw, bounds = packed(column)
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    # words lie one after the other once all else is taken out
    at = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.append(at[starts], at[-1]).astype(np.int32)
    found = pa.Array.from_buffers(pa.string(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(_FOLDED[raw[inside]])])
    return found, np.searchsorted(starts, bounds)


def build(docs: DataFrame) -> DataFrame:
    """The written index of all documents: see ``INDEX``; the documents' row has no term."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in chunks(batch.column(1), BLOCK):
                found, firsts = words(batch.column(1).slice(i, j - i))
                sizes = np.diff(firsts)
                coded = found.dictionary_encode()
                place = np.arange(len(found)) + np.repeat(np.arange(j - i), sizes)
                order = np.sort(coded.indices.to_numpy().astype(np.int64) << SHIFT | place)
                n = np.bincount(order >> SHIFT, minlength=len(coded.dictionary))
                place = order & ((1 << 32) - 1)
                steps = np.diff(place, prepend=0)
                first = np.cumsum(n) - n
                steps[first] = place[first]
                rows = len(n)
                offsets = np.append(first * 4, len(place) * 4).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), rows, [
                    None, pa.py_buffer(offsets), pa.py_buffer(steps.astype("<u4"))])
                none = pa.nulls(rows).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(rows, number)), coded.dictionary, pa.array(n.astype(np.int64)), lists, none, none], names)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.nulls(1).cast(pa.string()), pa.nulls(1).cast(pa.int64()),
                    pa.nulls(1).cast(pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i)),
                    pa.array([sizes], pa.list_(pa.int64()))], names)
                number += 1
    names = [c.split()[0] for c in INDEX.split(", ")]
    return stored(texts(docs).mapInArrow(run, INDEX), "postings")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms) of all runs of ``size`` words; an item of fewer words is one phrase.

    ``phrase`` is a 128-bit digest of the words, so equal phrases of several items are one."""
    def run(batches):
        for batch in batches:
            for i, j in chunks(batch.column(1), BLOCK // 8):
                found, firsts = words(batch.column(1).slice(i, j - i))
                every = found.to_pylist()
                for item, a, z in zip(batch.column(0).slice(i, j - i).to_pylist(), firsts.tolist(), firsts[1:].tolist()):
                    for k in range(a, max(z - size, a) + 1 if z > a else a, STARTS // 100):
                        ends = range(k, min(max(z - size, a) + 1, k + STARTS // 100))
                        terms = [every[s:min(s + size, z)] for s in ends]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([item] * len(terms), pa.int64()),
                            pa.array([hashlib.blake2b("\0".join(t).encode(), digest_size=16).digest() for t in terms]),
                            pa.array(terms, pa.list_(pa.string()))], ["item_id", "phrase", "terms"])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, phrase binary, terms array<string>")


def _plans(index: DataFrame, wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """phrase, terms, the offsets of its words from the rarest on, and the rarest word."""
    counts = (index.where("term is not null").select("term", "n").join(vocabulary, "term", "left_semi")
              .groupBy("term").agg(F.sum("n").alias("total")))
    each = wanted.select("phrase", "terms", F.posexplode("terms").alias("at", "term"))
    known = (each.join(counts, "term").groupBy("phrase")
             .agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("total", "at"))).alias("o")))
    order = F.transform("o", lambda x: x["at"])
    # a word that the corpus lacks leaves the order short
    return known.where(F.size("o") == F.size("terms")).select(
        "phrase", "terms", order.alias("order"), F.element_at("terms", F.element_at(order, 1) + 1).alias("rarest"))


class Block:
    """Lists of one block's words, and the phrases to look for there."""

    def __init__(self, own: pa.Table, asked: pa.Table):
        is_doc = pc.is_null(own.column("term"))
        docs, lists = own.filter(is_doc), own.filter(pc.invert(is_doc))
        self.sizes = np.array(docs.column("n_words")[0].as_py(), np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        data, at = packed(lists.column("places").combine_chunks())
        steps = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
        self.begin = at // 4
        self.n = np.diff(self.begin)
        run = np.concatenate(([0], np.cumsum(steps)))
        self.place = run[1:] - np.repeat(run[self.begin[:-1]], self.n)
        self.keys = np.repeat(np.arange(len(self.n)), self.n) << SHIFT | self.place
        self.phrase = asked.column("phrase").combine_chunks()
        terms, order = asked.column("terms").combine_chunks(), asked.column("order").combine_chunks()
        self.size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        known = pc.index_in(terms.flatten(), value_set=lists.column("term").combine_chunks())
        self.term = known.fill_null(-1).to_numpy().astype(np.int64)
        self.order = order.flatten().to_numpy().astype(np.int64)
        missing = np.concatenate(([0], np.cumsum(self.term < 0)))
        self.live = np.flatnonzero(missing[self.at[1:]] == missing[self.at[:-1]])

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term << SHIFT | place
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (place >= 0) & (self.keys[i] == key)

    def seeds(self):
        """(phrase, place of its rarest word) for some phrases at a time."""
        rarest = self.term[self.at[self.live] + self.order[self.at[self.live]]]
        total = np.cumsum(self.n[rarest])
        cuts = np.searchsorted(total, np.arange(STARTS, total[-1] + STARTS if len(total) else 0, STARTS))
        for some in np.split(np.arange(len(self.live)), np.unique(cuts)):
            r = rarest[some]
            if len(some):
                yield np.repeat(self.live[some], self.n[r]), self.place[ragged(self.begin[r], self.n[r])]

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence."""
        found = [(np.zeros(0, np.int64),) * 2]
        for phrase, place in self.seeds():
            start = place - self.order[self.at[phrase]]
            for k in range(1, int(self.size[phrase].max(initial=1))):
                more = np.flatnonzero(self.size[phrase] > k)
                offset = self.order[self.at[phrase[more]] + k]
                ok = np.ones(len(phrase), bool)
                ok[more] = self.has(self.term[self.at[phrase[more]] + offset], start[more] + offset)
                phrase, start = phrase[ok], start[ok]
            ok = start >= 0
            found.append((phrase[ok], start[ok]))
        return tuple(map(np.concatenate, zip(*found)))

    def near(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, start, length) wherever from a place of one of its words on all others follow
        within ``width`` words of one document."""
        found = [(np.zeros(0, np.int64),) * 3]
        for phrase, place in self.seeds():
            starts = set()
            for k in range(int(self.size[phrase].max(initial=0))):
                more = self.size[phrase] > k
                w, p = phrase[more], place[more]
                term = self.term[self.at[w] + k] << SHIFT
                low = np.searchsorted(self.keys, term | np.maximum(p - width + 1, 0))
                high = np.searchsorted(self.keys, term | p, "right")
                starts.update(zip(np.repeat(w, high - low).tolist(), self.place[ragged(low, high - low)].tolist()))
            if not starts:
                continue
            w, s = np.array(sorted(starts), np.int64).T
            last = s.copy()
            for k in range(int(self.size[w].max())):
                more = np.flatnonzero(self.size[w] > k)
                term = self.term[self.at[w[more]] + k]
                i = np.minimum(np.searchsorted(self.keys, term << SHIFT | s[more]), len(self.keys) - 1)
                follows = (self.keys[i] >> SHIFT == term) & (self.place[i] >= s[more])
                last[more] = np.maximum(last[more], np.where(follows, self.place[i], s[more] + width))
            ok = (last - s < width) & (self.doc(s) == self.doc(last))
            found.append((w[ok], s[ok], (last - s + 1)[ok]))
        return tuple(map(np.concatenate, zip(*found)))

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def searched(index: DataFrame, wanted: DataFrame, answer: Callable[[int, Block], pa.Table], schema: str) -> DataFrame:
    """``answer`` of every block that has the rarest word of a phrase; wanted: (phrase, terms)."""
    wanted = stored(wanted.groupBy("phrase").agg(F.first("terms").alias("terms")), "phrases")
    vocabulary = stored(wanted.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    plans = stored(_plans(index, wanted, vocabulary), "plans")
    # the few rows of rarest words leave the index before they meet the phrases
    rarest = stored(plans.select("rarest").distinct(), "rarest")
    seeds = (index.where("term is not null").select(F.col("block").alias("asked_of"), F.col("term").alias("rarest"))
             .join(rarest, "rarest", "left_semi"))
    asked = stored(seeds.join(plans.hint("merge"), "rarest").select("asked_of", "phrase", "terms", "order"), "asked")
    # a block's documents and lists; only blocks that are asked send theirs
    lists = index.where("term is not null").join(vocabulary, "term", "left_semi")
    rows = lists.select("block", "term", "places", F.lit(None).cast("array<long>").alias("n_words")).unionByName(
        index.where("term is null").select("block", "term", "places", "n_words"))
    own = rows.join(asked.select(F.col("asked_of").alias("block")).distinct(), "block", "left_semi")

    def run(key, left, right):
        return answer(key[0].as_py(), Block(left, right))
    return own.groupBy("block").cogroup(asked.groupBy("asked_of")).applyInArrow(run, schema)


def _listed(index: DataFrame) -> DataFrame:
    """(block, place, doc_id, n_words) of every document of the index."""
    return (index.where("term is null")
            .select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
            .select("block", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words")))


def phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, phrase, start, length) of every exact match of (phrase, terms), in words."""
    return _matches(index, wanted, lambda b: (*(x := b.exact()), b.size[x[0]]))


def proximity(index: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, phrase, start, length) of every stretch of at most ``width`` words that starts with
    a word of the phrase and holds all of them, in any order; the shortest from each start."""
    return _matches(index, wanted, lambda b: b.near(width))


def _matches(index: DataFrame, wanted: DataFrame, find) -> DataFrame:
    def answer(block: int, b: Block) -> pa.Table:
        phrase, start, length = find(b)
        doc = b.doc(start)
        return pa.table([pa.array(np.full(len(doc), block)), pa.array(doc.astype(np.int32)), b.phrase.take(pa.array(phrase)),
                         pa.array(start - b.first[doc]), pa.array(length)], ["block", "place", "phrase", "start", "length"])
    found = searched(index, wanted, answer, "block long, place int, phrase binary, start long, length long")
    return found.join(_listed(index), ["block", "place"]).select("doc_id", "phrase", "start", "length")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit and the sorted ids of the items whose phrases occur, of every row."""
    index = build(docs)
    asked = stored(windows(items, size), "windows")

    def answer(block: int, b: Block) -> pa.Table:
        phrase, start = b.exact()
        change = np.zeros(b.first[-1] + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + b.size[phrase], -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
        n_hit = covered[b.first[1:]] - covered[b.first[:-1]]
        pairs = np.unique(np.stack((b.doc(start), phrase)), axis=1)
        hit = np.flatnonzero(n_hit)
        bounds = np.append(np.searchsorted(pairs[0], hit), pairs.shape[1]).astype(np.int32)
        return pa.table([
            pa.array(np.full(len(hit), block)), pa.array(hit.astype(np.int32)), pa.array(n_hit[hit]),
            pa.ListArray.from_arrays(pa.array(bounds), b.phrase.take(pa.array(pairs[1])))],
            ["block", "place", "n_hit", "phrases"])
    hits = stored(searched(index, asked.select("phrase", "terms"), answer,
                           "block long, place int, n_hit long, phrases array<binary>"), "hits")
    of_item = asked.where("item_id is not null").select("phrase", "item_id").distinct()
    named = (hits.select("block", "place", F.explode("phrases").alias("phrase")).join(of_item, "phrase")
             .select("block", "place", "item_id").distinct().groupBy("block", "place")
             .agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    found = (_listed(index).join(hits.drop("phrases"), ["block", "place"], "left")
             .join(named, ["block", "place"], "left"))
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
m AS (
  SELECT dw.doc_id, dw.i, bw.n, bw.item_id
  FROM dw CROSS JOIN sizes JOIN bw ON bw.n = sizes.n AND dw.i + sizes.n - 1 <= len(dw.w)
   AND bw.phrase = array_to_string(dw.w[dw.i : dw.i + sizes.n - 1], ' ')),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
