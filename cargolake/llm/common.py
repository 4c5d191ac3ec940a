"""Helpers shared by the training-data operators.

Every operator takes a frame with an identifier and a text column and ignores all others, so
extra columns, also ones named like a result column, do no harm. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch

#: While a step is written: shuffle files of a finished job are removed at once, so steps do not
#: add up on disk, and batches for Python stay small, however long the texts.
_BATCH, _BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"), _BATCH: ("64m", _BYTES)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Identifier and text (null: empty), and the columns named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a step into the shared scratch folder and read it back: cuts lineage, and a lost
    executor costs only its own tasks. ``codec`` of the files, where the session's will not do."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {key: spark.conf.get(key, usual) for key, (usual, _) in _STEP.items()}
    for key, (_, value) in _STEP.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path, compression=codec)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Batches for Python stay small for the rest of the session, also in frames that are written
    after the function that made them has returned."""
    spark.conf.set(_BATCH, _BYTES)


#: More partitions than this cost a scheduler more than they save; beyond, partitions grow.
MOST_PARTITIONS = 100_000


def parts(rows: int, each: int) -> int:
    """Groups so that each holds about so many rows; grows with the input."""
    return max(1, -(-rows // each))


def partitions(rows: int, each: int) -> int:
    """The same for partitions of a shuffle."""
    return min(MOST_PARTITIONS, parts(rows, each))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def chunks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column whose bytes stay under the limit; a longer text is alone."""
    sizes = lengths(column)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column without nulls as one array, and the bounds of its rows."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + size`` of every run, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
