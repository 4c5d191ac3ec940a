"""Typed, trimmed and de-duplicated shipments from canonical text rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.text import blank_to_null, clean_text, squash, strip
from ..functions.values import chapter_of, country, date, hsn, number
from ..schema import (COUNTRY_COLUMNS, DEDUPE_KEY, NUMERIC_COLUMNS, SEARCH_COLUMNS,
                      UPPER_COLUMNS, col)

# Columns the mapping always fills, so they do not show that a row holds data.
STAMPED_COLUMNS = ("Trade Type", "HS Chapter", "Source File")
# The same with the columns that the party and geography rules fill as well.
ALL_STAMPED_COLUMNS = STAMPED_COLUMNS + (
    "Reporting Country", "Origin Country", "Destination Country", "Currency")


def _each(df: DataFrame, names, change) -> DataFrame:
    return df.withColumns({n: change(col(n)) for n in names if n in df.columns})


def trim_and_nullify(df: DataFrame) -> DataFrame:
    """Every text cell trimmed, NULL where it stands for no value.

    One expression for each column, as generated code; one over a list of all cells is interpreted.
    Columns that a feed lacks are literals and cost nothing this way.
    """
    return _each(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)], clean_text)


def normalise_hsn(df: DataFrame) -> DataFrame:
    return _each(df, ["HSN"], hsn)


def fill_chapter(df: DataFrame) -> DataFrame:
    return df.withColumn("HS Chapter", F.coalesce(F.col("HS Chapter"), chapter_of(F.col("HSN"))))


def normalise_countries(df: DataFrame) -> DataFrame:
    return _each(df, COUNTRY_COLUMNS, country)


def upper_codes(df: DataFrame) -> DataFrame:
    return _each(df, UPPER_COLUMNS, F.upper)


def parse_dates(df: DataFrame) -> DataFrame:
    return _each(df, ["Date"], date)


def parse_numbers(df: DataFrame) -> DataFrame:
    return _each(df, NUMERIC_COLUMNS, number)


def drop_empty(df: DataFrame, stamped: tuple[str, ...] = STAMPED_COLUMNS) -> DataFrame:
    """Rows with a value in at least one column that is not in ``stamped``.

    Reporting Country is always filled, so the default keeps nearly every row; pass
    ``ALL_STAMPED_COLUMNS`` to drop the rows that hold nothing of their own.
    """
    told = _told(df, stamped)
    return df if told is None else df.filter(told)


def _told(df: DataFrame, stamped: tuple[str, ...]) -> Column | None:
    telling = [col(c).isNotNull() for c in df.columns if c not in stamped]
    return reduce(or_, telling) if telling else None


def drop_repeats(df: DataFrame) -> DataFrame:
    """One of each set of fully equal rows; Source File is part of the row."""
    return df.dropDuplicates()


def typed(df: DataFrame) -> DataFrame:
    """All cleaning rules that look at one row."""
    for step in (trim_and_nullify, normalise_hsn, fill_chapter, normalise_countries,
                 upper_codes, parse_dates, parse_numbers):
        df = step(df)
    return df


def distinct_rows(df: DataFrame, stamped: tuple[str, ...] = STAMPED_COLUMNS) -> DataFrame:
    """Each different row once, with ``_copies`` and whether it holds anything (``_told``).

    The counts make a second pass over the feeds needless. As an aggregate of the grouping
    the emptiness test also stays above the rules that made the columns; as a filter it
    would be pushed below them and repeat them all.
    """
    names = list(map(col, df.columns))
    told = _told(df, stamped)
    return (df.withColumn("_told", F.lit(True) if told is None else told).groupBy(*names)
            .agg(F.count("*").alias("_copies"), F.max("_told").alias("_told")))


def clean(df: DataFrame, stamped: tuple[str, ...] = STAMPED_COLUMNS) -> DataFrame:
    return distinct_rows(typed(df), stamped).filter("_told").drop("_copies", "_told")


def dedupe_across_files(df: DataFrame, key: tuple[str, ...] = DEDUPE_KEY) -> DataFrame:
    """First row of each key by source file; the other columns settle a tie.

    Filtering on the rank lets Spark keep one row per key inside every map task before
    the shuffle, so a key that holds a third of the rows reaches its reducer as one row
    per map task. A hash in front of the key columns settles nearly every comparison of
    the two sorts in its first eight bytes.
    """
    rest = [c for c in df.columns if c not in key and c != "Source File"]
    order = [F.col("Source File").asc_nulls_last(), *(col(c).asc_nulls_last() for c in rest)]
    rank = F.row_number().over(W.partitionBy("_hash", *map(col, key)).orderBy(*order))
    return (df.withColumn("_hash", F.xxhash64(*map(col, key))).withColumn("_rank", rank)
            .filter("_rank = 1").drop("_rank", "_hash"))


def add_search_columns(df: DataFrame) -> DataFrame:
    """Stored lower-case text for free search and a punctuation-free product key."""
    text = F.lower(F.concat_ws(" | ", *map(col, SEARCH_COLUMNS)))
    return df.withColumns({"_search": text,
                           "_pd_search": blank_to_null(squash(F.col("Product Description")))})


def exclude_overlap(df: DataFrame, chapters: tuple[str, ...] = ("29", "38"),
                    cutoff: str = "2025-03-01", code: str = "HSN", day: str = "Date"
                    ) -> tuple[DataFrame, DataFrame]:
    """Rows outside the slice another source already covers, and the excluded count.

    As text dates compare in order, no parsing is needed. A row whose code or date is
    missing is in neither result, as a condition on NULL is not true either way.
    """
    chapter = F.substring(strip(col(code)), 1, 2)
    day10 = F.substring(strip(col(day).cast("string")), 1, 10)
    covered = chapter.isin(*chapters) & (day10 >= cutoff)
    audit = (df.filter(covered).groupBy(chapter.alias("chapter"))
             .agg(F.count("*").alias("excluded")).orderBy(F.desc("excluded"), "chapter"))
    return df.filter(~covered), audit
