"""MinHash near-dedup with tensored banding.

Two collections of ``SLOTS`` small hashes (each of ``ROWS`` minhashes) give ``SLOTS * SLOTS``
table keys by pairing, so that many tables cost ``2 * SLOTS * ROWS`` minhashes, about the square
root. A pair of similarity s meets in some table with probability
``(1 - (1 - s**ROWS)**SLOTS)**2``: 0.9999 at 0.75, more above. Small hashes that one text alone
has can pair with nothing and go before pairing, which loses no meeting.

Texts of equal shingle sets are one node, so exact copies cost nothing here. Shingles that one
node alone has bound the overlap it can have with any other; pairs beyond that bound are never
made. In each bucket all nodes are held against the one with the least of its own, on full
shingle sets; in a group of copies that is nearest to what they were copied from. What then still stands
apart in a bucket is compared by its differences to that middle, and only where two share a rare
one (see ``apart``). No bucket is capped, none is gathered in one task, and no pairs are made
within what is already linked.

A text without words has an empty set and is linked with nothing. Null identifiers rank after
all others; a group of only such has a null component. Repeated rows are one node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import chunks, stored, texts
from .graph import components
from .shingles import mix, sets

SLOTS, ROWS = 12, 2
BATCH = 1 << 20
LAST = (1 << 63) - 1
SIGNED = "row long, n_shingles long, set_key binary, keys array<long>"


def _family(count: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def signature(shingles: np.ndarray, family: np.ndarray) -> np.ndarray:
    """One minhash for each multiplier; blocks keep memory flat for very long texts."""
    least = np.full(len(family), ~np.uint64(0))
    for k in range(0, len(shingles), 8192):
        some = mix(shingles[None, k:k + 8192] * family[:, None])
        np.minimum(least, some.min(1), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set digest and small hashes of every row that has words."""
    def run(batches):
        family = _family(2 * SLOTS * ROWS)
        salts = np.arange(1, 2 * SLOTS + 1, dtype=np.uint64)
        for b in batches:
            for i, j in chunks(b.column(1), BATCH):
                own = sets(b.column(1).slice(i, j - i))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in own]
                keys = []
                for s in own:
                    small = signature(s, family).reshape(2 * SLOTS, ROWS)
                    keys.append(mix(small[:, 0] * np.uint64(3) + np.sum(small[:, 1:], 1, dtype=np.uint64)
                                    + salts).astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array([len(s) for s in own], pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * 2 * SLOTS,
                                             pa.array(np.concatenate(keys)))],
                    ["row", "n_shingles", "set_key", "keys"])
    return docs.select("row", "text").mapInArrow(run, SIGNED)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row key: equal only for equal identifier and text."""
    return texts(docs).withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(LAST)), "text"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) of every table in which a node may meet another."""
    slots = nodes.select("node", F.posexplode("keys").alias("slot", "value"))
    shared = slots.groupBy("slot", "value").count().where("count > 1").select("slot", "value")
    live = slots.join(shared, ["slot", "value"], "left_semi")
    own = live.groupBy("node").agg(F.collect_list(F.struct("slot", "value")).alias("s"))
    first = F.filter("s", lambda x: x["slot"] < SLOTS)
    second = F.filter("s", lambda x: x["slot"] >= SLOTS)
    keys = F.flatten(F.transform(first, lambda x: F.transform(
        second, lambda y: F.xxhash64(x["slot"], x["value"], y["slot"], y["value"]))))
    pairs = own.select("node", F.explode(keys).alias("key"))
    several = pairs.groupBy("key").count().where("count > 1").select("key")
    return pairs.join(several, "key", "left_semi")


def verified(pairs: DataFrame, node_texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= 75 * union."""
    def run(batches):
        last, left = None, None
        for batch in batches:
            for i, j in chunks(batch.column(3), BATCH):
                a, b = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                keep = np.zeros(j - i, bool)
                for k, (node, right) in enumerate(zip(a.to_pylist(), sets(batch.column(3).slice(i, j - i)))):
                    if node != last:
                        last, left = node, sets(batch.column(2).slice(i + k, 1))[0]
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    keep[k] = 100 * both >= 75 * (len(left) + len(right) - both)
                where = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([a.take(where), b.take(where)], ["a", "b"])
    left = node_texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = node_texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
            .mapInArrow(run, "a long, b long"))


def lonely(node_texts: DataFrame) -> DataFrame:
    """How many shingles of each node no other of these nodes has."""
    def run(batches):
        for batch in batches:
            for i, j in chunks(batch.column(1), BATCH):
                own = sets(batch.column(1).slice(i, j - i))
                nodes = batch.column(0).slice(i, j - i).to_numpy()
                sizes = [len(s) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(nodes, sizes))],
                    ["shingle", "node"])
    each = node_texts.select("node", "text").mapInArrow(run, "shingle long, node long")
    owners = each.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    return owners.where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def _fits(other: str):
    """Whether two nodes can be similar, from their sizes and what each shares with any node.

    Similarity 0.75 needs an overlap of 3/7 of both sizes, and neither size above 4/3 of the other.
    """
    size, common = F.col(f"{other}_size"), F.col(f"{other}_common")
    return ((F.col(f"{other}_node") != F.col("node"))
            & (3 * (size + F.col("size")) <= 7 * F.least(common, "common"))
            & (100 * F.least(size, "size") >= 75 * F.greatest(size, "size")))


def _pairs(joined: DataFrame, other: str) -> DataFrame:
    return joined.select(F.least(f"{other}_node", "node").alias("a"),
                         F.greatest(f"{other}_node", "node").alias("b")).distinct()


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes that connect all that is similar."""
    table = stored(buckets(nodes), "buckets")
    wanted = stored(table.select(F.col("node").alias("row")).distinct(), "wanted")
    # the same plan at every size: texts meet the wanted rows by a merge
    node_texts = stored(rows.join(wanted.hint("merge"), "row", "left_semi").groupBy("row")
                        .agg(F.first("text").alias("text"))
                        .select(F.col("row").alias("node"), "text"), "texts")
    sizes = nodes.select("node", F.col("n_shingles").alias("size"))
    bound = stored(wanted.select(F.col("row").alias("node")).join(sizes, "node")
                   .join(lonely(node_texts), "node", "left")
                   .select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))
                   .where("100 * common >= 75 * size"), "bounds")
    members = stored(table.join(bound, "node"), "members")

    # first the node of each bucket that has least of its own, the middle of a group of copies
    middle = members.groupBy("key").agg(
        F.max(F.struct((F.col("common") / F.col("size")).alias("share"), "node", "size", "common")).alias("m"),
        F.count(F.lit(1)).alias("n")).where("n > 1")
    middle = middle.select("key", *(F.col(f"m.{c}").alias(f"m_{c}") for c in ("node", "size", "common")))
    pairs = stored(_pairs(members.join(middle, "key").where(_fits("m")), "m"), "pairs")
    found = stored(verified(pairs, node_texts), "links")

    # then what still stands apart in a bucket, by the differences to its middle
    part = components(found)
    placed = stored(members.join(part, "node", "left")
                    .select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    mixed = (placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"))
             .where("l <> h").select("key"))
    around = (placed.join(mixed, "key").join(middle.select("key", "m_node"), "key")
              .select(F.col("m_node").alias("a"), F.col("node").alias("b"), "label").distinct())
    return found.union(stored(apart(stored(around, "around"), node_texts), "links"))


def differences(around: DataFrame, node_texts: DataFrame) -> DataFrame:
    """(a, b) with both set sizes, how many shingles of a the set of b lacks, and ``diff``: these
    and those of b that a lacks."""
    def run(batches):
        last, left = None, None
        for batch in batches:
            for i, j in chunks(batch.column(3), BATCH):
                a, b = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                rows = []
                for k, (node, right) in enumerate(zip(a.to_pylist(), sets(batch.column(3).slice(i, j - i)))):
                    if node != last:
                        last, left = node, sets(batch.column(2).slice(i + k, 1))[0]
                    lacks = np.setdiff1d(left, right, assume_unique=True)
                    more = np.setdiff1d(right, left, assume_unique=True)
                    rows.append((len(left), len(right), len(lacks), np.concatenate((lacks, more)).view(np.int64)))
                n, m, r, d = zip(*rows)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in d]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [a, b, *(pa.array(x, pa.int64()) for x in (n, m, r)),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(d)))],
                    ["a", "b", "a_size", "size", "lacks", "diff"])
    left = node_texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = node_texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return (around.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
            .mapInArrow(run, "a long, b long, a_size long, size long, lacks long, diff array<long>"))


def apart(around: DataFrame, node_texts: DataFrame) -> DataFrame:
    """Links between nodes of differing labels that met one middle; around: (a, b, label), a the middle.

    With R the shingles of the middle M that a node lacks and A those it has beside M's, two nodes
    share |M| - |R1| - |R2| + |R1 & R2| + |A1 & A2|, so their likeness follows from the small sets
    D = R + A alone. Of two nodes of differing labels one is not similar to M, and then the other
    shares more than (4 |R| + 3 |A|) / 7 of its own D with it. So it shares one of the rarest of D,
    all but that many less one: only nodes that meet in such an element, with enough of both left
    after it, are compared, exactly. Elements that one node alone has meet nobody.
    """
    each = stored(around.join(differences(around, node_texts), ["a", "b"])
                  .where(F.col("a") != F.col("b")), "differences")
    size, lacks, total = F.col("size"), F.col("lacks"), F.size("diff")
    shares = F.floor((4 * lacks + 3 * (total - lacks)) / 7) + 1
    elements = each.select("a", "b", F.explode("diff").alias("element"))
    counted = elements.groupBy("a", "element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_node = W.partitionBy("a", "b")
    # in order of rarity; left: how many of the node's come after, those of itself alone before all
    own = stored(elements.join(counted, ["a", "element"])
                 .withColumn("left", F.count(F.lit(1)).over(of_node) - F.row_number().over(of_node.orderBy("n", "element")))
                 .select("a", "b", "element", "left"), "elements")
    plain = each.select("a", "b", "label", "a_size", "size", "lacks", shares.alias("shares"))
    placed = stored(own.join(plain, ["a", "b"]), "placed")
    near = (placed.where(F.col("left") + 1 >= F.col("shares"))
            .select(*(F.col(c).alias(f"n_{c}") for c in ("a", "element", "b", "label", "size", "lacks", "left"))))
    far = placed.where(7 * (F.col("a_size") - lacks) < 3 * (size + F.col("a_size")))
    # what they have to share for 7 times the overlap to reach 3 times both sizes; in the first
    # element that two share neither may have too few left
    needs = F.ceil(3 * (size + F.col("n_size")) / 7) - F.col("a_size") + lacks + F.col("n_lacks")
    meet = ((F.col("n_a") == F.col("a")) & (F.col("n_element") == F.col("element")) & (F.col("n_label") != F.col("label"))
            & (100 * F.least("size", "n_size") >= 75 * F.greatest("size", "n_size"))
            & (F.least("left", "n_left") + 1 >= needs))
    pairs = stored(far.join(near, meet).select("a", "b", "n_b", needs.alias("needs")).distinct(), "candidates")
    lists = own.groupBy("a", "b").agg(F.collect_list("element").alias("d"))
    both = (pairs.join(lists, ["a", "b"])
            .join(lists.select("a", F.col("b").alias("n_b"), F.col("d").alias("n_d")), ["a", "n_b"])
            .where(F.size(F.array_intersect("d", "n_d")) >= F.col("needs")))
    return both.select(F.least("b", "n_b").alias("a"), F.greatest("b", "n_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_row (the row key) of every row."""
    rows = numbered(docs)
    signed = stored(signatures(rows), "signatures")
    ids = rows.select("row", "doc_id")
    nodes = stored(signed.where("n_shingles > 0").groupBy("set_key").agg(
        F.min("row").alias("node"), F.first("n_shingles").alias("n_shingles"),
        F.first("keys").alias("keys")), "nodes")
    label = components(links(rows, nodes))
    placed = (nodes.select("set_key", "node").join(label, "node", "left")
              .select("set_key", F.coalesce("label", "node").alias("label")))
    # one row for each row key: repeated rows are alike
    keyed = (signed.groupBy("row").agg(F.first("n_shingles").alias("n_shingles"), F.first("set_key").alias("set_key"))
             .join(placed, "set_key", "left")
             .select("row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).alias("label")))
    joined = stored(ids.join(keyed, "row"), "labelled")
    least = joined.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.join(least, "label", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("row").alias("text_row"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay: those of the least identifier of each group; all their columns."""
    found = stored(near_duplicates(docs).where("kept").select("text_row").distinct(), "kept")
    key = F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.coalesce(docs["text"], F.lit("")))
    columns = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), key.alias("_key"))
    return rows.join(found.hint("merge"), F.col("_key") == F.col("text_row"), "left_semi").select("_row.*")
