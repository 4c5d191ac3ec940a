"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank
``(rank - 1/2) / rows of the source`` says where in the source it stands. Sorting all rows by
fractional rank interleaves the sources in proportion, and cutting that order into equal runs
gives shards whose sizes differ by at most one row and which all have the mixture of the whole.

Neither order is made in one task: hash and fraction are cut into buckets of about
``BUCKET_ROWS`` rows, buckets are counted, and a row's rank is its place in its bucket plus the
rows of the buckets before. Only those counts (one row for so many input rows) are cumulated.

A null source is a stratum of its own; null identifiers and texts are allowed, and rows that are
alike in every respect take their places in any order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import partitions, stored

BUCKET_ROWS = 1_000
SEED = "interleave-1"


def _ranked(rows: DataFrame, groups: list[str], bucket: Column, order: list) -> DataFrame:
    """Adds ``rank`` from 1 within the groups, in the order of bucket and then ``order``."""
    rows = rows.withColumn("_bucket", bucket)
    keys = [*groups, "_bucket"]
    counts = rows.groupBy(*keys).count()
    before = counts.select(*keys, (F.sum("count").over(
        W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    # within the bucket, ranks by a window that a bucket bounds
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (placed.join(before, keys).withColumn("rank", F.col("_before") + F.col("_place"))
            .drop("_bucket", "_before", "_place"))


def shards(docs: DataFrame, count: int = 24, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, source, shard and slot of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("source").isNull().alias("no_source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")).alias("shuffle"))
    rows = stored(rows, "rows")
    sources = ["source", "no_source"]
    total = rows.count()
    buckets = partitions(total, BUCKET_ROWS)
    # the first 32 bits of the hash, as a fraction of their range
    slice_of = (F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    order = ["shuffle", "doc_id", "text_crc32", "size"]
    ranked = _ranked(rows, sources, slice_of, order)
    sizes = rows.groupBy(*sources).agg(F.count(F.lit(1)).alias("n"))
    # twice the rank less one over twice the rows, in whole numbers, so that ties are exact
    part = ranked.join(sizes, sources).withColumn(
        "fraction", (2 * F.col("rank") - 1) / (2 * F.col("n")).cast("double")).drop("rank")
    part = stored(part, "fractions")
    everywhere = F.least((F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1))
    line = _ranked(part, [], everywhere, ["fraction", *sources, *order])
    # whole-number divisions: shard i takes the places from ceil(i * total / count) on
    whole = max(total, 1)
    at = line.withColumn("at", F.col("rank") - 1)
    cut = at.withColumn("shard", F.expr(f"int((at * {count}) div {whole})"))
    first = F.expr(f"(bigint(shard) * {total} + {count - 1}) div {count}")
    return cut.select("doc_id", "size", "text_crc32", F.when(~F.col("no_source"), F.col("source")).alias("source"),
                       "shard", (F.col("at") - first).cast("long").alias("slot"))

