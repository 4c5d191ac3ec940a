"""Line dedup with sorted hash ranges and per-document bitmaps.

A line's key is 128 bits of hash of its normalised content. Lines are range-partitioned by key
and sorted by document (greatest first) within: streaming over a key, the first document is the
one that keeps its lines, and the rank of the last says how many documents have the key. What must go comes back as bitmaps for each document,
words without a mark left out; texts are cut with those and never travel through this step.

Keys that a sample shows to be frequent (each at least ``1 / HEAVY`` of the sample, so at most
``HEAVY`` keys) stay out of the ranges: their documents are counted by a grouping that combines
before its shuffle, and the few results go back to the rows by broadcast. The sample decides
only on the way, never on the result.

Null and empty texts are one empty line. Rows of one identifier are one document for counting;
rows that are alike in identifier and text get the same result each. A null identifier is below
all others.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import partitions, stored, texts

MIN_CHARS, MIN_DOCS = 20, 3
HEAVY = 1_000
SAMPLE_ROWS = 200_000
RANGE_ROWS = 100_000
BLANKS = " \t\n\x0b\x0c\r"


def key_text(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row key: equal only for equal identifier and text."""
    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(rows: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, h1, h2, place) of every line whose key has at least so many characters."""
    each = rows.select("row", "doc_id", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = each.select("row", "doc_id", "place", key_text(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("row", "doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"), "place")


def heavy_keys(keys: DataFrame) -> DataFrame:
    """At most ``HEAVY`` keys, each at least that share of a sample."""
    counted = stored(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "sampled")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where((F.col("n") > 1) & (F.col("n") * HEAVY >= total)).select("h1", "h2")


def dropped(rows: DataFrame, least: int = MIN_CHARS, docs: int = MIN_DOCS) -> DataFrame:
    """(row, bitmap): for every row with lines to drop, the marked 64-bit words of its bitmap."""
    # texts are split once; what follows reads keys only
    keys = stored(line_keys(rows, least), "keys")
    total = keys.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    heavy = stored(heavy_keys(keys.sample(share, 7) if share < 1 else keys), "heavy")
    light = keys.join(F.broadcast(heavy), ["h1", "h2"], "left_anti")
    dealt = light.repartitionByRange(partitions(total, RANGE_ROWS), "h1", "h2")
    order = F.col("doc_id").desc_nulls_last()
    rank = F.dense_rank().over(W.partitionBy("h1", "h2").orderBy(order))
    several = F.max("rank").over(W.partitionBy("h1", "h2"))
    streamed = (dealt.withColumn("rank", rank).withColumn("documents", several)
                .where((F.col("documents") >= docs) & (F.col("rank") > 1)).select("row", "place"))
    # frequent keys: combined before the shuffle, results of at most HEAVY rows
    often = keys.join(F.broadcast(heavy), ["h1", "h2"], "left_semi")
    owner = (often.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
             .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= docs))
    hot = (often.join(F.broadcast(owner), ["h1", "h2"])
           .where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("row", "place"))
    marks = streamed.union(hot)
    words = marks.groupBy("row", F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("bits"))
    return words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def dedup(docs: DataFrame, least: int = MIN_CHARS, in_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, of every row."""
    rows = numbered(docs)
    bitmaps = stored(dropped(rows, least, in_docs), "bitmaps")
    # the same plan at every size: texts meet their bitmaps by a merge
    joined = rows.join(bitmaps.hint("merge"), "row", "left").withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("bitmap").isNull(), F.col("lines")).otherwise(F.expr(
        "filter(lines, (line, i) -> coalesce(shiftright(bitmap[bigint(i) div 64], i % 64) & 1L, 0L) = 0L)"))
    return joined.withColumn("kept", kept).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"))


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, o.last IS NOT NULL AND k.doc_id <> o.last AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
