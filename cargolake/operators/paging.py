"""Ordered pages, capped exports and exact-size samples."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import SHIPMENT_COLUMNS, col
from ..session import scratch
from .filters import ShipmentFilter
from .predicates import FIELDS, SORT_FIELDS, Group, PredicateError, apply_tree
from .rank_pages import RANGE_ROWS, ordering, page_at

# Values of the sort column that are looked at to find where a capped export ends.
CUT_SAMPLE = 50_000


def page(df: DataFrame, sort_by: str, sort_order: str = "desc", number: int = 1,
         size: int = 50) -> DataFrame:
    return (df.orderBy(*ordering(df.columns, sort_by, sort_order))
            .offset((number - 1) * size).limit(size))


def page_after(df: DataFrame, last: dict | None, sort_by: str, sort_order: str = "desc",
               size: int = 50, shown: int = 1) -> DataFrame:
    """The page that follows a row, given as that row's values of all columns.

    ``shown`` is how many rows equal to it in every column the pages so far have shown; the
    others of them come first. Unlike an offset it costs the same however deep the page lies:
    only ``size`` rows are kept, and ``shown`` of the equal ones passed over. Without a row it
    is the first page.
    """
    columns = [sort_by, *(c for c in df.columns if c != sort_by)]
    if last is not None:
        beyond, equal = [], []
        for c in columns:
            value, down = last[c], c == sort_by and sort_order != "asc"
            if value is None:
                later = F.lit(False)  # NULLs are last already
            else:
                later = (col(c) < F.lit(value)) if down else (col(c) > F.lit(value))
                later = F.coalesce(later, F.lit(True))
            beyond.append(reduce(and_, [*equal, later]))
            equal.append(col(c).eqNullSafe(F.lit(value)))
        same = df.filter(reduce(and_, equal)).offset(shown).limit(size)
        df = df.filter(reduce(or_, beyond)).unionAll(same)
    return df.orderBy(*ordering(df.columns, sort_by, sort_order)).limit(size)


def page_meta(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Row total and page count of a filtered frame."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.lit(number).alias("page"),
                  F.lit(size).alias("page_size"),
                  F.ceil(total / F.lit(size)).alias("total_pages"))


def narrowed(df: DataFrame, sort_by: str, sort_order: str, rows: int) -> DataFrame:
    """Only rows that reach the value of the last wanted row in the sort column.

    Finding that value reads the filter and sort columns alone. As a literal it then reaches
    the Parquet statistics, so a page by date skips the row groups of other dates instead of
    reading every column of every row. Nothing is cut when fewer rows have a value.
    """
    key = col(sort_by)
    order = key.asc_nulls_last() if sort_order == "asc" else key.desc_nulls_last()
    last = F.max(key) if sort_order == "asc" else F.min(key)
    found = (df.select(key).orderBy(order).limit(rows)
             .agg(F.count(key).alias("n"), last.alias("last")).first())
    if found["n"] < rows:
        return df
    return df.filter(key <= F.lit(found["last"]) if sort_order == "asc"
                     else key >= F.lit(found["last"]))


def listed(df: DataFrame, columns: Iterable[str], sort_by: str, sort_order: str, number: int, size: int) -> DataFrame:
    """A page of some columns at any depth, with the rows and order that ``page`` gives.

    The first pages come from a cut at the value of their last row, later ones from counted ranks,
    so that no task sorts more than ``RANGE_ROWS`` rows.
    """
    columns = [col(c) for c in columns]
    if number * size > RANGE_ROWS:
        return page_at(df.select(*columns), sort_by, sort_order, number, size)
    rows = narrowed(df, sort_by, sort_order, number * size).select(*columns)
    return page(rows, sort_by, sort_order, number, size)


def list_shipments(df: DataFrame, f: ShipmentFilter) -> DataFrame:
    return _shipment_page(f.apply(df), f.sort_by or "Date", f.sort_order, f.page, f.page_size)


def _shipment_page(df: DataFrame, sort_by: str, sort_order: str, number: int, size: int) -> DataFrame:
    return listed(df, SHIPMENT_COLUMNS, sort_by, sort_order, number, size)


def list_by_tree(df: DataFrame, root: Group | None, sort_by: str | None = None,
                 sort_order: str = "desc", number: int = 1, size: int = 50) -> DataFrame:
    if sort_by and sort_by not in SORT_FIELDS:
        raise PredicateError(f"sort_by must be one of {sorted(SORT_FIELDS)}")
    return _shipment_page(apply_tree(df, root), FIELDS[sort_by or "date"][0], sort_order,
                          number, size)


def cut_value(df: DataFrame, sort_by: str, sort_order: str, cap: int):
    """A value of the sort column that at least ``cap`` rows reach, or None.

    Read off a bounded sample of the column and then counted, so the result never depends
    on the sample. Runs three jobs over that column.
    """
    key = col(sort_by)
    values = df.select(key).filter(key.isNotNull())
    total = values.count()
    if total < cap:
        return None
    share = min(1.0, CUT_SAMPLE / total)
    rank = math.ceil(cap * share + 6 * math.sqrt(cap * share) + 6)
    order = key.asc() if sort_order == "asc" else key.desc()
    end = F.max(key) if sort_order == "asc" else F.min(key)
    sampled = values.sample(share, 11) if share < 1 else values
    value = sampled.orderBy(order).limit(rank).agg(end.alias("v")).first()["v"]
    if value is None or values.filter(_reaches(key, value, sort_order)).count() < cap:
        return None
    return value


def _reaches(key: Column, value, sort_order: str) -> Column:
    return key <= F.lit(value) if sort_order == "asc" else key >= F.lit(value)


def first_rows(df: DataFrame, sort_by: str, sort_order: str = "desc",
               cap: int | None = None) -> DataFrame:
    """All rows in order, or the first ``cap`` of them.

    The cap is found without bringing the rows together: a value of the sort column that
    enough rows reach goes to the scan as a literal of the column's own type, what is left
    is sorted over many tasks and written, and each task's share of the cap follows from
    the rows that the tasks before it wrote.
    """
    order = ordering(df.columns, sort_by, sort_order)
    if cap is None:
        return df.orderBy(*order)
    value = cut_value(df, sort_by, sort_order, cap)
    if value is not None:
        df = df.filter(_reaches(col(sort_by), value, sort_order))
    spark = df.sparkSession
    path = scratch(spark, "sorted")
    # the identifier holds the task and, in its lower 33 bits, the row's place there
    ident = F.monotonically_increasing_id()
    (df.orderBy(*order).withColumn("_at", ident).write.parquet(path))
    rows = spark.read.parquet(path)
    task = F.shiftright("_at", 33)
    counts = rows.groupBy(task.alias("task")).count().orderBy("task").collect()  # one per task
    left, whole, part, room = cap, -1, -1, 0
    for r in counts:
        if r["count"] > left:
            part, room = r["task"], left
            break
        whole, left = r["task"], left - r["count"]
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    keep = (task <= whole) | ((task == part) & (place < room))
    return rows.filter(keep).orderBy("_at").drop("_at")


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A random sample of exactly ``n`` rows of the (already filtered) frame, all when fewer.

    Every row draws a number; those above a bound that ``n`` rows stay under with near
    certainty are ranked behind all others, so a task hands on few more rows than it has
    under the bound, yet none is lost should they be too few.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    bound = F.lit(n + 8 * math.sqrt(n) + 20) / F.greatest(total, F.lit(1))
    drawn = df.withColumn("_draw", F.rand(seed))
    return drawn.orderBy(F.col("_draw") > bound, "_draw").limit(n).drop("_draw")
