"""Pages at any depth, found by counting ranks instead of sorting up to them.

``page_at`` gives the same rows as an offset over the whole sort. It looks for the range of sort
values that holds the wanted ranks: some values are drawn as marks, every row is counted between
two marks or on one, and the cumulated counts say where the ranks lie. The range found is cut
again the same way until it has at most ``RANGE_ROWS`` rows; only these are sorted. A value that
many rows share is a mark, so it is a range of its own; within it the next column of the order
decides. Each step divides the rows by about the number of marks, reads the sort column alone
and hands its bounds to the scan as literals. The marks steer the way only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import col

#: Rows that are sorted for one page at most, unless a page itself has more.
RANGE_ROWS = 50_000
#: Values of a step's sample, and marks chosen from it.
SAMPLE, MARKS = 4_000, 63


def ordering(columns: Iterable[str], sort_by: str, sort_order: str = "desc") -> list[Column]:
    """The sort column with NULLs last, then every other column so that ties are settled."""
    first = col(sort_by).asc_nulls_last() if sort_order == "asc" else col(sort_by).desc_nulls_last()
    return [first, *(col(c).asc_nulls_last() for c in columns if c != sort_by)]


@dataclass(frozen=True)
class Slice:
    """Rows ``skip .. skip + take`` of a filtered frame in the order of its columns from ``at``."""
    df: DataFrame
    at: int
    rows: int
    skip: int
    take: int


def _marks(df: DataFrame, key: Column, rows: int) -> list:
    """Some values of the column, ascending; frequent ones are sure to be among them."""
    share = min(1.0, SAMPLE / max(1, rows))
    values = df.select(key.alias("v")).filter("v is not null")
    drawn = (values.sample(share, 5) if share < 1 else values).limit(4 * SAMPLE)
    sample = sorted(r["v"] for r in drawn.collect() if r["v"] == r["v"])
    if not sample:  # none was drawn: any value will do
        sample = [r["v"] for r in values.limit(1).collect() if r["v"] == r["v"]]
    return sorted({sample[(k * (len(sample) - 1)) // (MARKS - 1)] for k in range(MARKS)} if sample else [])


def _range_of(key: Column, marks: list, low: int, high: int) -> Column:
    """Number of the range a value is in: 2k + 1 on mark k, 2k before it; a balanced tree."""
    if low == high:
        return F.lit(2 * low)
    mid = (low + high) // 2
    return (F.when(key < F.lit(marks[mid]), _range_of(key, marks, low, mid))
            .when(key == F.lit(marks[mid]), F.lit(2 * mid + 1))
            .otherwise(_range_of(key, marks, mid + 1, high)))


def _within(key: Column, marks: list, number: int, floating: bool) -> Column:
    """The filter for one range, in a form that reaches the scan."""
    if number == _nulls(marks):
        return key.isNull()
    if number == _nans(marks):
        return F.isnan(key)
    if floating and number == 2 * len(marks):  # statistics of files and caches leave NaN out
        return _within(key, marks, number, False) & ~F.isnan(key)
    k, on = divmod(number, 2)
    if on:
        return key == F.lit(marks[k])
    above = key > F.lit(marks[k - 1]) if k else key.isNotNull()
    return above & (key < F.lit(marks[k])) if k < len(marks) else above


def _nans(marks: list) -> int:
    return 2 * len(marks) + 1


def _nulls(marks: list) -> int:
    return 2 * len(marks) + 2


def rank_histogram(df: DataFrame, key: Column, marks: list, floating: bool = False) -> dict[int, int]:
    """Rows of every range: below, on and between the marks, above them, NaN, NULL."""
    number = F.when(key.isNull(), _nulls(marks))
    if floating:
        number = number.when(F.isnan(key), _nans(marks))
    number = number.otherwise(_range_of(key, marks, 0, len(marks)))
    found = df.select(number.alias("range")).groupBy("range").agg(F.count("*").alias("rows")).collect()
    return {r["range"]: r["rows"] for r in found}


def _cut(part: Slice, name: str, down: bool) -> Iterator[Slice]:
    """The parts of a slice by ranges of one column, in order."""
    key = col(name)
    floating = part.df.schema[name].dataType.typeName() in ("double", "float")
    marks = _marks(part.df, key, part.rows)
    counts = rank_histogram(part.df, key, marks, floating)
    nulls = _nulls(marks)
    order = sorted(counts, key=lambda r: (r == nulls, -r if down else r))  # NULLs are last either way
    skip, take = part.skip, part.take
    for number in order:
        rows = counts[number]
        if skip >= rows:
            skip -= rows
            continue
        mine = min(take, rows - skip)
        # all rows of a mark, of NaN or of NULL agree in this column: the next one decides
        agreed = number == nulls or number % 2
        chosen = part.df.filter(_within(key, marks, number, floating))
        yield Slice(chosen, part.at + bool(agreed), rows, skip, mine)
        skip, take = 0, take - mine
        if not take:
            return


def slices(df: DataFrame, sort_by: str, sort_order: str, skip: int, take: int,
           range_rows: int) -> Iterator[Slice]:
    """Slices of at most ``range_rows`` rows each that together are the wanted rows, in order."""
    names = [sort_by, *(c for c in df.columns if c != sort_by)]
    todo = [Slice(df, 0, df.count(), skip, take)]
    while todo:
        part = todo.pop()
        if part.rows <= max(range_rows, part.take) or part.at == len(names):
            if part.take and part.skip < part.rows:
                yield part
        else:
            todo += reversed(list(_cut(part, names[part.at], part.at == 0 and sort_order != "asc")))


def page_at(df: DataFrame, sort_by: str, sort_order: str = "desc", number: int = 1, size: int = 50,
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """A page of the ordered frame, whatever its number; runs counting jobs while the plan is made.

    At most ``range_rows`` rows (or a page) are sorted in a task. Rows that agree in every column
    are alike, so no order among them is looked for. A page beyond the end is empty.
    """
    order = ordering(df.columns, sort_by, sort_order)
    found = None
    for part in slices(df, sort_by, sort_order, (number - 1) * size, size, range_rows):
        if part.at == len(df.columns):
            rows = part.df.limit(part.take)  # all alike
        else:
            rows = part.df.orderBy(*order).offset(part.skip).limit(part.take)
        found = rows if found is None else found.unionAll(rows)
    return df.limit(0) if found is None else found.orderBy(*order)
