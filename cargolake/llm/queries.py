"""The registered queries: each operator over the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (alignment, bpe, codes, exact, lines, merkle, minhash, packing, postings, quality, secrets, sharding,
               suffix)
from .common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.removals(documents(spark, sf_dir), kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("text_row")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(documents(spark, sf_dir)))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.dedup(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(documents(spark, sf_dir))


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.MIN_SCORE).cast("int").alias("predicted"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return postings.digests(postings.contamination(documents(spark, sf_dir), items))


def op12_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_suffix_dedup, op3_minhash, op4_best_fit, op5_secret_scan, op6_stratified_shards,
           op7_line_dedup, op8_exact_dedup, op9_merkle, op10_crf_quality, op11_decontaminate, op12_cross_align, op13_vector_codes, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": lines.ORACLE_SQL, "op8_exact_dedup": exact.ORACLE_SQL,
            "op11_decontaminate": postings.ORACLE_SQL}
