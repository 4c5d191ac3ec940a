"""Registry of queries. A query gets the fixture views and returns a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import col
from .views import Views, with_views

Query = Callable[[Views], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLES[name] = with_views(sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        add(name, fn, sql)
        return fn
    return register


def rounded(df: DataFrame, *names: str, digits: int = 2) -> DataFrame:
    """Float sums depend on the order of addition, so both sides compare them rounded."""
    return df.withColumns({n: F.round(col(n), digits) for n in names})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Views(spark, sf_dir)))
            for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
