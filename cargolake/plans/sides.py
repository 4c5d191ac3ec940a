"""Batch plans of the side tables: files in, table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import agbio, argentina, registration
from ..operators.cleaning import exclude_overlap
from ..sources import feeds
from ..sources.writers import write_stage


def _stored(df: DataFrame, path: str) -> DataFrame:
    write_stage(df, path)
    return df.sparkSession.read.parquet(path)


def build_ledger(spark: SparkSession, source: str, target: str, source_file: str | None = None) -> DataFrame:
    """The import ledger of CSV files with any of its known headers."""
    raw = feeds.read_csv(spark, [source])
    name = source_file or source.rstrip("/").rsplit("/", 1)[-1]
    return _stored(argentina.load(raw, F.lit(name)), target)


def build_market(spark: SparkSession, source: str, target: str, source_file: str | None = None) -> DataFrame:
    """Market values of positional CSV files with two title lines."""
    raw = feeds.read_positional(spark, source, agbio.COLUMNS)
    name = source_file or source.rstrip("/").rsplit("/", 1)[-1]
    return _stored(agbio.load(raw, F.lit(name)), target)


def build_registrations(spark: SparkSession, sources: dict[str, str], target: str,
                        names: dict[str, str] | None = None) -> DataFrame:
    """One table of the registries of many countries; ``sources`` has a path for each feed."""
    raw = {feed: feeds.read_csv(spark, [path]) for feed, path in sources.items()}
    return _stored(registration.load(raw, names), target)


def prepare_overlap(spark: SparkSession, source: str, target: str, cutoff: str = "2025-03-01",
                    code: str = "HSN", day: str = "Date") -> tuple[DataFrame, DataFrame]:
    """A feed without the slice that another source covers, and the audit of what went.

    Writes ``kept`` and ``audit`` below the target; the build then reads ``kept``.
    """
    kept, audit = exclude_overlap(feeds.read_csv(spark, [source]), cutoff=cutoff, code=code, day=day)
    return _stored(kept, f"{target}/kept"), _stored(audit, f"{target}/audit")
