"""Tables, shards and CSV downloads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.argentina import export_rows
from ..operators.filters import ShipmentFilter
from ..operators.paging import first_rows
from ..schema import SHIPMENT_COLUMNS, col
from ..session import compiled, step
from .feeds import base_name

PARTITION = "Reporting Country"
BOM = "\ufeff"
VERSION = "version_"


def write_stage(df: DataFrame, path: str) -> None:
    """Rows between two stages as zstd Parquet, as the last shuffle left them."""
    with step(df.sparkSession), compiled(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def staged(df: DataFrame, path: str) -> DataFrame:
    """The frame written as a stage and read back, so that the shuffle files behind it are gone."""
    write_stage(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shards(df: DataFrame, path: str, by_country: bool = True,
                 derive: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Shipments as zstd Parquet, laid out for search.

    With ``by_country`` there is one folder per reporting country. Rebalancing lets adaptive
    execution split a country that holds a large part of the rows and join the small ones.
    Otherwise, for tables too small for folders, files hold ranges of date and code; a hash
    of the row splits a range that one date and code would fill. Either way the rows of a
    file are in order of date and code, so scans skip files and row groups by statistics.
    ``derive`` adds columns that follow from the others in a row: after the shuffle, so that it
    does not carry them.
    """
    if by_country:
        placed = df.hint("rebalance", col(PARTITION))
    else:
        placed = df.repartitionByRange("Date", "HSN", F.xxhash64(*map(col, df.columns)))
    ordered = placed.sortWithinPartitions(*([PARTITION] if by_country else []), "Date", "HSN")
    writer = (derive(ordered) if derive else ordered).write.mode("overwrite").option("compression", "zstd")
    with step(df.sparkSession), compiled(df.sparkSession):
        (writer.partitionBy(PARTITION) if by_country else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written shipments table with its columns back in order."""
    df = spark.read.parquet(path)
    # A partition column comes back as text only if its values do not look like numbers.
    df = df.withColumn(PARTITION, col(PARTITION).cast("string"))
    extra = [c for c in df.columns if c not in SHIPMENT_COLUMNS]
    return df.select(*map(col, SHIPMENT_COLUMNS), *map(col, extra))


def write_csv(df: DataFrame, path: str, single_file: bool = False, compression: str = "none") -> None:
    """CSV with a header; NULL is an empty cell."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", "true").option("nullValue", "")
     .option("compression", compression).option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .csv(path))


def write_sample(df: DataFrame, path: str, rows: int = 1000) -> None:
    """The first rows by date as CSV."""
    write_csv(first_rows(df, "Date", cap=rows), path, single_file=True)  # ``rows`` is small


def write_by_direction(df: DataFrame, path: str) -> None:
    """Parquet split by trade type, for those who want files of their own."""
    (df.hint("rebalance", col("Trade Type")).write.mode("overwrite").option("compression", "zstd")
     .partitionBy("Trade Type").parquet(path))


def read_direction(spark: SparkSession, path: str, trade_type: str) -> DataFrame:
    """One direction of a written shipments table, without a second copy of it.

    The condition reaches the scan; row groups of one direction alone are skipped by statistics."""
    return read_table(spark, path).filter(F.col("Trade Type") == trade_type)


def direction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("Trade Type").agg(F.count("*").alias("rows"))


def replace_table(df: DataFrame, name: str, path: str | None = None) -> str:
    """Full replacement of a catalogue table; returns where the new rows lie.

    Every version is a folder of its own below ``path`` (by default one beside the warehouse's
    tables). The rows are written there first and counted again; only then does the catalogue's
    location move, so readers see the old rows or the new ones and a write that fails leaves
    the table as it was. The frame may read the table that it replaces. Versions stay until
    ``drop_old_versions``, as running readers may still need the last one.

    Other columns than before cannot be given to a table in place: the new version is then made
    under a passing name and the two are renamed.
    """
    spark = df.sparkSession
    root = path or "/".join((spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), f"{name.split('.')[-1]}_versions"))
    location = f"{root}/{VERSION}{time.time_ns()}_{uuid.uuid4().hex[:8]}"
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("errorifexists").option("compression", "zstd").parquet(location))
    written = spark.read.schema(df.schema).parquet(location).count()
    if written != seen.get["rows"]:
        raise OSError(f"{location} has {written} of {seen.get['rows']} rows; {name} is unchanged")
    if not spark.catalog.tableExists(name):
        _external(spark, name, location, df)
    elif [f.dataType for f in spark.table(name).schema] == [f.dataType for f in df.schema] and spark.table(name).columns == df.columns:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
    else:
        passing = f"{name}_{uuid.uuid4().hex[:8]}"
        _external(spark, passing, location, df)
        spark.sql(f"ALTER TABLE {name} RENAME TO {passing}_old")
        spark.sql(f"ALTER TABLE {passing} RENAME TO {name}")
        spark.sql(f"DROP TABLE {passing}_old")
    spark.catalog.refreshTable(name)
    return location


def _external(spark: SparkSession, name: str, location: str, df: DataFrame) -> None:
    spark.catalog.createTable(name, path=location, source="parquet", schema=df.schema)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Folders of the versions below a table's root, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory())
    return [f"{root}/{n}" for n in names if n.startswith(VERSION)]


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the latest versions below a root that ``replace_table`` made; returns them."""
    old = versions(spark, root)[:-keep or None]
    for location in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(location)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return old


def _with_bom(df: DataFrame) -> DataFrame:
    """Byte order mark before the first header, which spreadsheets need to see UTF-8."""
    first, *rest = df.columns
    return df.select(col(first).alias(BOM + first), *map(col, rest))


def export_shipments(df: DataFrame, f: ShipmentFilter, path: str, cap: int | None = None,
                     single_file: bool = False) -> None:
    """Rows of a filter in its order as a CSV download.

    All rows, or the first ``cap``: compare ``count_rows`` with the cap to know whether it
    cut. A file per task; one file only when asked for, as a single task then writes it.
    """
    write_csv(_with_bom(shipment_export(df, f, cap)), path, single_file)


def shipment_export(df: DataFrame, f: ShipmentFilter, cap: int | None = None) -> DataFrame:
    rows = f.apply(df).select(*map(col, SHIPMENT_COLUMNS))
    return first_rows(rows, f.sort_by or "Date", f.sort_order, cap)


def export_ledger(df: DataFrame, path: str, sort_by: str = "date", sort_order: str = "desc",
                  cap: int | None = None, single_file: bool = False) -> None:
    """The ledger as a CSV download; see ``export_shipments``."""
    write_csv(_with_bom(export_rows(df, sort_by, sort_order, cap)), path, single_file)


def run_summary(raw_counts: DataFrame, cleaned: DataFrame,
                failed: dict[str, str] | None = None) -> DataFrame:
    """Rows in and out of every source file. ``raw_counts`` has ``file`` and ``rows_in``."""
    out = cleaned.groupBy(F.col("Source File").alias("file")).agg(F.count("*").alias("rows_out"))
    read = (raw_counts.join(out, "file", "full")
            .select("file", F.lit(True).alias("success"),
                    F.coalesce("rows_in", F.lit(0)).alias("rows_in"),
                    F.coalesce("rows_out", F.lit(0)).alias("rows_out"),
                    F.lit(None).cast("string").alias("error")))
    if not failed:
        return read
    spark = cleaned.sparkSession
    bad = spark.createDataFrame([(base_name(p), False, 0, 0, e) for p, e in failed.items()],
                                read.schema)
    return read.unionByName(bad)


def run_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("files"), F.count_if("success").alias("successes"),
                       F.count_if(~F.col("success")).alias("failures"),
                       F.coalesce(F.sum("rows_in"), F.lit(0)).alias("rows_in"),
                       F.coalesce(F.sum("rows_out"), F.lit(0)).alias("rows_out"))
