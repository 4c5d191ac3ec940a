"""The canonical shipments table: columns, types and the whitelists built on it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Names and order of the canonical columns.
SHIPMENT_COLUMNS = (
    "Date", "Importer", "Exporter", "Supplier", "Buyer", "HSN", "Country", "Port",
    "Quantity", "Unit", "Value", "Unit Price USD", "Currency", "Product Description",
    "Origin Country", "Destination Country", "Trade Type", "Reporting Country",
    "HS Chapter", "IEC", "BE/SB Number", "CHA Name", "Importer Address",
    "Exporter Address", "Supplier Address", "Buyer Address", "City", "State", "Mode",
    "Source File",
)
NUMERIC_COLUMNS = ("Quantity", "Value", "Unit Price USD")
COUNTRY_COLUMNS = ("Country", "Origin Country", "Destination Country")
UPPER_COLUMNS = ("Currency", "Unit", "Trade Type", "Mode")
PARTY_COLUMNS = ("Importer", "Exporter", "Supplier", "Buyer")
SEARCH_COLUMNS = ("Importer", "Exporter", "Supplier", "Buyer", "Product Description", "HSN")
SORTABLE_COLUMNS = (
    "Date", "Importer", "Exporter", "Supplier", "Buyer", "HSN", "Quantity", "Value",
    "Unit Price USD", "Origin Country", "Destination Country", "Trade Type",
    "Reporting Country", "HS Chapter",
)
DEDUPE_KEY = (
    "Date", "Importer", "Exporter", "Supplier", "Buyer", "HSN", "Quantity", "Value",
    "Product Description", "BE/SB Number",
)


def _type_of(name: str) -> T.DataType:
    if name == "Date":
        return T.DateType()
    return T.DoubleType() if name in NUMERIC_COLUMNS else T.StringType()


SHIPMENT_SCHEMA = T.StructType([T.StructField(c, _type_of(c)) for c in SHIPMENT_COLUMNS])


def col(name: str) -> Column:
    """Column by exact name; feed headers may hold dots, spaces, slashes or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
