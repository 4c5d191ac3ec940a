"""The eight saved reports over the shipments table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..functions.text import contains
from ..operators.paging import ordering
from ..schema import col


def _recent(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*map(col, names)).orderBy(*ordering(names, "Date"))


def by_importer(df: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Latest shipments of an importer."""
    return _recent(df.filter(contains(F.col("Importer"), text)), "Date", "Importer", "Supplier",
                   "Origin Country", "HSN", "Quantity", "Unit", "Value", "Currency",
                   "Source File").limit(limit)


def by_code(df: DataFrame, hsn: str, limit: int = 100) -> DataFrame:
    """Shipments of one exact product code."""
    return _recent(df.filter(F.col("HSN") == hsn), "Date", "Trade Type", "Importer", "Exporter",
                   "Supplier", "Buyer", "Origin Country", "Destination Country",
                   "Value").limit(limit)


def by_supplier(df: DataFrame, text: str) -> DataFrame:
    """All shipments of a supplier, latest first."""
    return _recent(df.filter(contains(F.col("Supplier"), text)), "Date", "Importer", "Supplier",
                   "Origin Country", "Product Description", "Quantity", "Value")


def country_volume(df: DataFrame, limit: int = 100) -> DataFrame:
    country = F.coalesce("Origin Country", "Destination Country").alias("counterparty_country")
    return (df.groupBy("HS Chapter", "Trade Type", country)
            .agg(F.count("*").alias("shipments"), F.sum("Quantity").alias("total_quantity"),
                 F.sum("Value").alias("total_value"))
            .orderBy(F.col("total_value").desc_nulls_last(),
                     *(F.col(c).asc_nulls_last()
                       for c in ("HS Chapter", "Trade Type", "counterparty_country")))
            .limit(limit))


def top_party(df: DataFrame, party: str, trade_type: str, limit: int = 20) -> DataFrame:
    """Largest importers of the imports or exporters of the exports."""
    return (df.filter((F.col("Trade Type") == trade_type) & col(party).isNotNull())
            .groupBy(col(party))
            .agg(F.count("*").alias("shipments"), F.sum("Value").alias("total_value"))
            .orderBy(F.col("total_value").desc_nulls_last(), col(party)).limit(limit))


def monthly_counts(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("Date").isNotNull())
            .groupBy(F.trunc("Date", "MM").alias("month"), "HS Chapter", "Trade Type")
            .agg(F.count("*").alias("shipments"))
            .orderBy("month", F.col("HS Chapter").asc_nulls_last(),
                     F.col("Trade Type").asc_nulls_last()))


def recent_suppliers(df: DataFrame, importer: str, since: date) -> DataFrame:
    return (df.filter(contains(F.col("Importer"), importer) & (F.col("Date") >= F.lit(since)))
            .select("Supplier", "Origin Country").distinct())
