"""The batch build: a folder of feeds to the shipments table and its by-products."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cleaning import (STAMPED_COLUMNS, add_search_columns, dedupe_across_files,
                                  distinct_rows, typed)
from ..operators.headers import HeaderRules, mapping_report
from ..operators.mapping import map_feed
from ..operators.rollups import Rollups, key_rollup, party_rollup, sketches
from ..sources import feeds, writers


def build_shipments(spark: SparkSession, source: str, target: str,
                    ports: DataFrame | None = None, rules: HeaderRules | None = None,
                    limit: int | None = None, sample_rows: int = 1000,
                    search_columns: bool = True, multi_line: bool = False,
                    stamped: tuple[str, ...] = STAMPED_COLUMNS,
                    by_country: bool = True, rollups: bool = True, seconds: dict[str, float] | None = None) -> DataFrame:
    """Read, map, clean, de-duplicate and write every feed below ``source``.

    Below ``target`` it writes ``shards`` (cleaned rows), ``shipments`` (the table), ``rollup_keys``,
    ``rollup_parties`` and ``sketches`` (see ``operators/rollups.py``; not with ``rollups=False``),
    ``directions`` (rows of each; ``writers.read_direction`` reads one), ``ports`` (as given), ``sample``,
    ``mapping_report``, ``summary`` and ``totals``. Each stage reads what the one before has written, so a lost executor costs its own stage's tasks and no
    stage is computed twice. Without ``ports`` (port and country; ``feeds.read_ports`` reads
    a JSON object of them) feeds that state a port only get no destination country; the
    table is a parameter, as it is data of the user. ``seconds`` receives what each stage took.
    Returns the summary.
    """
    began = time.perf_counter()

    def stage(name: str) -> None:
        nonlocal began
        if seconds is not None:
            seconds[name] = time.perf_counter() - began
        began = time.perf_counter()

    found = feeds.scan_folder(spark, source)
    # The listing is metadata, one row per file.
    listed = [(r["path"], r["suffix"])
              for r in (feeds.first_files(found, limit) if limit else found).collect()]
    groups, failed = feeds.group_by_layout(spark, listed)
    if not groups:
        raise RuntimeError(f"no readable feed below {source}")

    if ports is not None:
        # Stored, they have a known size: a frame that is still to be worked out would have all feeds
        # shuffled by their few ports before Spark sees that it can be broadcast.
        writers.write_stage(ports.select("port", "country"), f"{target}/ports")
        ports = spark.read.parquet(f"{target}/ports")
    stage("list")
    mapped, reports = [], []
    for layout, paths in groups.items():
        raw, names = feeds.read_group(spark, layout, paths, multi_line)
        mapped.append(map_feed(raw, F.col("_file"), rules, ports, names))
        reports.append(mapping_report(_names(spark, paths), F.col("file"), names, rules))

    # The feeds are read once: the shards carry how often each row occurred.
    rows = distinct_rows(typed(reduce(DataFrame.unionByName, mapped)), stamped)
    writers.write_stage(rows, f"{target}/shards")
    stage("shards")
    shards = spark.read.parquet(f"{target}/shards")
    cleaned = shards.filter("_told").drop("_copies", "_told")

    writers.write_shards(dedupe_across_files(cleaned), f"{target}/shipments", by_country,
                         add_search_columns if search_columns else None)
    stage("table")
    shipments = writers.read_table(spark, f"{target}/shipments")

    if rollups:
        write_rollups(shipments, target)
        stage("rollups")
    keys = spark.read.parquet(f"{target}/rollup_keys") if rollups else None
    directions = (keys.groupBy("Trade Type").agg(F.sum("shipments").alias("rows")) if rollups
                  else writers.direction_counts(shipments))
    directions.write.mode("overwrite").parquet(f"{target}/directions")
    writers.write_sample(shipments.drop("_search", "_pd_search"), f"{target}/sample", sample_rows)
    reduce(DataFrame.unionByName, reports).write.mode("overwrite").parquet(
        f"{target}/mapping_report")
    seen = shards.groupBy(F.col("Source File").alias("file")).agg(F.sum("_copies").alias("rows_in"))
    counts = _names(spark, [p for paths in groups.values() for p in paths]).distinct().join(
        seen, "file", "left")
    writers.run_summary(counts, cleaned, failed).write.mode("overwrite").parquet(
        f"{target}/summary")
    summary = spark.read.parquet(f"{target}/summary")
    writers.run_totals(summary).write.mode("overwrite").parquet(f"{target}/totals")
    stage("reports")
    return summary


def write_rollups(shipments: DataFrame, target: str) -> None:
    """The roll-ups of a table beside it."""
    for name, make in (("rollup_keys", key_rollup), ("rollup_parties", party_rollup), ("sketches", sketches)):
        writers.write_stage(make(shipments), f"{target}/{name}")


def read_rollups(spark: SparkSession, target: str) -> Rollups:
    """A built table with its roll-ups, to answer questions from."""
    return Rollups(writers.read_table(spark, f"{target}/shipments"),
                   *(spark.read.parquet(f"{target}/{n}") for n in ("rollup_keys", "rollup_parties", "sketches")))


def _names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """File names of listed paths as a frame."""
    return spark.createDataFrame([(feeds.base_name(feeds.plain_path(p)),) for p in paths],
                                 "file string")
