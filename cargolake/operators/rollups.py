"""Stored roll-ups and sketches of the shipments table, and answers drawn from them.

``key_rollup`` holds volume by month and the filter keys, ``party_rollup`` the same by party, and
``sketches`` mergeable distinct-count sketches of fixed size. A question whose filter touches
their keys alone (and whole months) reads them instead of the shipments; any other reads the
shipments. Both ways give the same rows, but for the sketches, whose counts are estimates.

Columns keep their canonical names, ``Date`` being the first of the month, so a filter applies to
a roll-up as it does to the table.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import PARTY_COLUMNS, col
from . import analytics
from .filters import ShipmentFilter

KEYS = ("Trade Type", "HS Chapter", "Origin Country", "Destination Country", "Country", "Reporting Country")
#: Fields of a filter that the keys can answer; dates only by whole months.
KEY_FIELDS = frozenset({"trade_type", "hs_chapter", "origin_country", "destination_country", "country",
                        "reporting_country", "date_from", "date_to"})
#: Keys of the sketches, and the fields they can answer.
SKETCH_KEYS = ("Trade Type", "HS Chapter", "Reporting Country")
SKETCH_FIELDS = frozenset({"trade_type", "hs_chapter", "reporting_country", "date_from", "date_to"})
#: Size of a sketch: 2 ** 12 registers, a standard error of about 1.04 / 64 = 1.6 %.
LOG_SIZE = 12
ERROR = 1.04 / 2 ** (LOG_SIZE / 2)

_VOLUME = {"shipments": "shipments", "total_value": "value", "total_quantity": "quantity"}


def _month() -> Column:
    return F.trunc("Date", "MM").alias("month_")


def _measures() -> list[Column]:
    return [F.count("*").alias("shipments"), F.sum("Value").alias("value"), F.sum("Quantity").alias("quantity"),
            F.sum("Unit Price USD").alias("price"), F.count("Unit Price USD").alias("prices")]


def key_rollup(df: DataFrame) -> DataFrame:
    """Volume by month and keys. It combines before its shuffle; a hot key is a row a task."""
    return df.groupBy(_month(), *map(col, KEYS)).agg(*_measures()).withColumnRenamed("month_", "Date")


def party_rollup(df: DataFrame) -> DataFrame:
    """Volume by month, keys, role and party. One role at a time, so no row is copied for roles
    that it does not fill before its own combine."""
    parts = [df.filter(col(p).isNotNull())
             .groupBy(F.lit(p).alias("role"), col(p).alias("party"), _month(), *map(col, KEYS)).agg(*_measures())
             for p in PARTY_COLUMNS]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumnRenamed("month_", "Date")


def _sketched() -> dict[str, Column]:
    places = F.coalesce("Origin Country", "Destination Country")
    return {"importers": F.col("Importer"), "exporters": F.col("Exporter"), "suppliers": F.col("Supplier"),
            "buyers": F.col("Buyer"), "hsn": F.col("HSN"), "countries": places}


def sketches(df: DataFrame) -> DataFrame:
    """Rows, dates and one sketch for each counted column, by month and a few keys."""
    return df.groupBy(_month(), *map(col, SKETCH_KEYS)).agg(
        F.count("*").alias("rows"), F.min("Date").alias("date_min"), F.max("Date").alias("date_max"),
        *(F.hll_sketch_agg(c, F.lit(LOG_SIZE)).alias(n) for n, c in _sketched().items())
    ).withColumnRenamed("month_", "Date")


def _whole_months(f: ShipmentFilter) -> bool:
    first = f.date_from is None or f.date_from.day == 1
    last = f.date_to is None or f.date_to.day == calendar.monthrange(f.date_to.year, f.date_to.month)[1]
    return first and last


def answers(f: ShipmentFilter, fields: frozenset[str]) -> bool:
    """Whether a roll-up with these fields has all that the filter asks."""
    return set(f.predicates()) <= fields and _whole_months(f)


def _summed() -> list[Column]:
    return [F.sum(source).alias(name) for name, source in _VOLUME.items()]


@dataclass(frozen=True)
class Rollups:
    """The shipments with what is stored beside them."""
    shipments: DataFrame
    keys: DataFrame
    parties: DataFrame
    sketches: DataFrame

    def monthly(self, f: ShipmentFilter, by: tuple[str, ...] = ()) -> DataFrame:
        """As ``analytics.monthly``."""
        if not answers(f, KEY_FIELDS):
            return analytics.monthly(f.apply(self.shipments), by)
        names = [k for k in by if k in analytics.TREND_KEYS]
        return (f.apply(self.keys).filter("Date IS NOT NULL")
                .groupBy(F.col("Date").alias("month"), *map(col, names)).agg(*_summed())
                .orderBy("month", *(col(k).asc_nulls_last() for k in names)))

    def totals(self, f: ShipmentFilter) -> DataFrame:
        """As ``analytics.totals``."""
        if not answers(f, KEY_FIELDS):
            return analytics.totals(f.apply(self.shipments))
        price = F.sum("price") / F.nullif(F.sum("prices"), F.lit(0))
        return f.apply(self.keys).agg(
            F.coalesce(F.sum("shipments"), F.lit(0)).alias("count"), F.sum("quantity").alias("total_quantity"),
            F.sum("value").alias("total_value"), price.alias("avg_unit_price_usd"))

    def top_parties(self, f: ShipmentFilter, party: str, limit: int = 25) -> DataFrame:
        """As ``analytics.top_parties``; the filter may also look into the names of that role."""
        if party not in PARTY_COLUMNS or not answers(f, KEY_FIELDS | {party.lower()}):
            return analytics.top_parties(f.apply(self.shipments), party, limit)
        rows = self.parties.filter(F.col("role") == party).withColumnRenamed("party", party)
        return (f.apply(rows).groupBy(col(party).alias("name")).agg(*_summed())
                .orderBy(F.col("total_value").desc_nulls_last(), "name").limit(limit))

    def dataset_stats(self, f: ShipmentFilter) -> DataFrame:
        """As ``analytics.dataset_stats`` with estimated distinct counts, where sketches can answer."""
        if not answers(f, SKETCH_FIELDS):
            return analytics.dataset_stats(f.apply(self.shipments))
        names = ("importers", "exporters", "suppliers", "hsn", "countries")
        return f.apply(self.sketches).agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"), F.min("date_min").alias("date_min"),
            F.max("date_max").alias("date_max"), *(_estimate(n).alias(f"distinct_{n}") for n in names))

    def party_universe(self, f: ShipmentFilter, party: str) -> DataFrame:
        """As ``analytics.party_universe``, estimated where sketches can answer."""
        if party not in PARTY_COLUMNS or not answers(f, SKETCH_FIELDS):
            return analytics.party_universe(f.apply(self.shipments), party)
        return f.apply(self.sketches).agg(_estimate(party.lower() + "s").alias("total"))


def _estimate(name: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0))
