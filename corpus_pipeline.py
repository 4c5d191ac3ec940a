"""From documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
``run`` writes each result into the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargolake.llm import exact, minhash, packing, quality, secrets
from cargolake.llm.common import documents, small_batches, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    model = quality.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest identifier."""
    return minhash.dedup(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark."""
    small_batches(spark)
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, their ids' checksum and their place in a sequence.

    The pieces themselves, with their ids, are written beside: ``packing.sequences`` reads them."""
    import public_tokenizers
    packed = stored(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")), "packed", packing.CODEC)
    return packing.digested(packed)


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near_copies),
          ("secrets", mask_secrets), ("pack", pack)]

#: A classifier, minhashes and a tokenizer cannot be written in SQL; tests/llm compares the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
