"""Feed rows to canonical rows, everything still text.

``map_feed`` is one projection over the raw feed. Raw columns that a value rule needs
travel along under a reserved name, so no rule has to join back to the feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, strip
from ..functions.values import number
from ..schema import col
from .headers import (CIF_HEADERS, DESTINATION_PORT_HEADER, INVOICE_PRICE_HEADER,
                      LOCAL_UNIT_PRICE_HEADERS, USD_HEADERS, USD_TOTAL_HEADER, Decision,
                      HeaderRules, decide, first_header, joined_sources, normalise,
                      single_sources)

DEFAULT_REPORTING_COUNTRY = "INDIA"

# Country names looked for in a file name, first hit wins.
REPORTING_COUNTRY_TOKENS = {
    "AUSTRALIA": "AUSTRALIA", "COLOMBIA": "COLOMBIA", "PERU": "PERU", "TURKEY": "TURKEY",
    "VIETNAM": "VIETNAM", "VIET NAM": "VIETNAM", "ARGENTINA": "ARGENTINA",
    "UGANDA": "UGANDA", "RUSSIA": "RUSSIA", "TANZANIA": "TANZANIA",
    "ETHIOPIA": "ETHIOPIA", "ECUADOR": "ECUADOR", "BOLIVIA": "BOLIVIA",
    "PHILIPPINES": "PHILIPPINES", "KENYA": "KENYA", "NIGERIA": "NIGERIA",
    "MEXICO": "MEXICO", "BRAZIL": "BRAZIL", "EGYPT": "EGYPT", "INDONESIA": "INDONESIA",
    "ZIMBABWE": "ZIMBABWE", "ZAMBIA": "ZAMBIA", "SOUTH AFRICA": "SOUTH AFRICA",
}

# Feeds whose unit price is worked out from value and quantity.
RATIO_PRICE_COUNTRIES = ("COLOMBIA", "AUSTRALIA", "TURKEY")

# Raw columns that travel with the mapped row, by reserved name.
CARRIED = {
    "_usd_total": USD_TOTAL_HEADER,
    "_cif": CIF_HEADERS,
    "_local_price": LOCAL_UNIT_PRICE_HEADERS,
    "_invoice_price": INVOICE_PRICE_HEADER,
    "_destination_port": DESTINATION_PORT_HEADER,
}


def file_metadata(file_name: Column) -> dict[str, Column]:
    """Trade type, chapter and reporting country told by a file name."""
    stem = F.upper(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""))
    trade = F.when(stem.contains("EXPORT"), "EXPORT").when(stem.contains("IMPORT"), "IMPORT")
    chapter = blank_to_null(F.regexp_extract(stem, r"\b(\d{2,4})\b", 1))
    country = reduce(lambda acc, item: acc.when(stem.contains(item[0]), item[1]),
                     REPORTING_COUNTRY_TOKENS.items(), F.when(F.lit(False), ""))
    return {"trade_type": trade, "hs_chapter": chapter,
            "reporting_country": country.otherwise(DEFAULT_REPORTING_COUNTRY)}


def join_parts(parts: list[Column]) -> Column:
    """Address parts joined by a bar; gaps collapse, an empty result is NULL."""
    text = F.concat_ws(" | ", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return blank_to_null(F.btrim(F.regexp_replace(text, r"(\s\|\s){2,}", " | "), F.lit(" |")))


def project_canonical(feed: DataFrame, decisions: list[Decision], file_name: Column,
                      rules: HeaderRules) -> DataFrame:
    """The canonical columns in order, as text, plus the carried raw columns."""
    singles, parts = single_sources(decisions), joined_sources(decisions)
    meta = file_metadata(file_name)

    def target(name: str) -> Column:
        if name == "Trade Type":
            return meta["trade_type"]
        if name == "Reporting Country":
            return meta["reporting_country"]
        if name == "Source File":
            return file_name
        if name in parts:
            return join_parts([col(c) for c in parts[name]])
        own = col(singles[name]).cast("string") if name in singles else F.lit(None).cast("string")
        return F.coalesce(own, meta["hs_chapter"]) if name == "HS Chapter" else own

    headers = [d.source_column for d in decisions]
    carried = {alias: first_header(headers, keys) for alias, keys in CARRIED.items()}
    return feed.select(
        *(target(name).alias(name) for name in rules.columns),
        *(col(h).cast("string").alias(alias) for alias, h in carried.items() if h))


def _when_carried(df: DataFrame, alias: str, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value) if alias in df.columns else df


def prefer_usd_total(df: DataFrame) -> DataFrame:
    """A stated USD total takes the place of whatever mapped to Value."""
    return _when_carried(df, "_usd_total", "Value", F.coalesce(
        blank_to_null(strip(F.col("_usd_total"))), F.col("Value")))


def prefer_cif(df: DataFrame) -> DataFrame:
    """A positive CIF value takes the place of Value."""
    cif = strip(F.col("_cif"))
    return _when_carried(df, "_cif", "Value",
                         F.when(number(cif) > 0, cif).otherwise(F.col("Value")))


def derive_value(df: DataFrame) -> DataFrame:
    """Quantity times local unit price where Value is no number."""
    quantity, price = number(F.col("Quantity")), number(F.col("_local_price"))
    missing = number(F.col("Value")).isNull() & quantity.isNotNull() & price.isNotNull()
    return _when_carried(df, "_local_price", "Value", F.when(
        missing, F.round(quantity * price, 3).cast("string")).otherwise(F.col("Value")))


def unit_price_from_invoice(df: DataFrame) -> DataFrame:
    """The invoice price is the USD unit price when the invoice is in USD."""
    usable = (F.col("Unit Price USD").isNull() & (F.upper("Currency") == "USD")
              & F.col("_invoice_price").isNotNull())
    return _when_carried(df, "_invoice_price", "Unit Price USD", F.when(
        usable, F.col("_invoice_price")).otherwise(F.col("Unit Price USD")))


def unit_price_from_value(df: DataFrame) -> DataFrame:
    """Value per quantity for the feeds that state no unit price."""
    value, quantity = number(F.col("Value")), number(F.col("Quantity"))
    usable = (F.upper("Reporting Country").isin(*RATIO_PRICE_COUNTRIES)
              & F.col("Unit Price USD").isNull() & value.isNotNull() & (quantity > 0))
    return df.withColumn("Unit Price USD", F.when(
        usable, F.round(value / quantity, 4).cast("string")).otherwise(F.col("Unit Price USD")))


def destination_from_port(df: DataFrame, ports: DataFrame | None) -> DataFrame:
    """Destination Country of a known destination port, where none is stated.

    ``ports`` has the columns ``port`` and ``country``. It carries no broadcast hint:
    Spark broadcasts it when its size allows and otherwise joins by shuffle, where
    adaptive execution splits a hot port.
    """
    if ports is None or "_destination_port" not in df.columns:
        return df
    known = (ports.groupBy(F.lower(strip(F.col("port"))).alias("_port_key"))
             .agg(F.max("country").alias("_port_country")))
    keyed = df.withColumn("_port_key", F.lower(strip(F.col("_destination_port"))))
    return (keyed.join(known, "_port_key", "left")
            .withColumn("Destination Country",
                        F.coalesce("Destination Country", "_port_country"))
            .drop("_port_key", "_port_country"))


def import_port(df: DataFrame) -> DataFrame:
    """On imports the port of destination is the domestic port."""
    return _when_carried(df, "_destination_port", "Port", F.when(
        F.col("Trade Type") == "IMPORT",
        F.coalesce(blank_to_null(strip(F.col("_destination_port"))), F.col("Port")),
    ).otherwise(F.col("Port")))


def stamp_usd(df: DataFrame, headers: list[str]) -> DataFrame:
    """Feeds with an explicit USD header are in USD throughout."""
    if {normalise(h) for h in headers} & set(USD_HEADERS):
        return df.withColumn("Currency", F.lit("USD"))
    return df


def consolidate(df: DataFrame) -> DataFrame:
    """Party and geography roles by trade direction.

    The domestic side is the reporting country; the partner is the first country named
    that is not. Each party column is filled on one direction only.
    """
    home = F.upper(F.coalesce(F.col("Reporting Country"), F.lit(DEFAULT_REPORTING_COUNTRY)))
    export, imported = F.col("Trade Type") == "EXPORT", F.col("Trade Type") == "IMPORT"

    def foreign(name: str) -> Column:
        place = strip(F.col(name))
        return F.when((place != "") & (F.upper(place) != home), place)

    def stated(name: str) -> Column:
        return blank_to_null(strip(F.col(name)))

    def by_direction(name: str, on_export: Column, on_import: Column) -> Column:
        return F.when(export, on_export).when(imported, on_import).otherwise(F.col(name))

    nothing = F.lit(None).cast("string")
    places = ("Destination Country", "Country", "Origin Country")
    partner = F.when(export, F.coalesce(*map(foreign, places))).when(
        imported, F.coalesce(*map(foreign, reversed(places))))
    return df.withColumn("_partner", partner).withColumns({
        "Origin Country": by_direction("Origin Country", home, F.col("_partner")),
        "Destination Country": by_direction("Destination Country", F.col("_partner"), home),
        "Country": by_direction("Country", F.col("_partner"), F.col("_partner")),
        "Importer": by_direction("Importer", nothing,
                                 F.coalesce(stated("Importer"), stated("Buyer"))),
        "Exporter": by_direction("Exporter", F.col("Exporter"), nothing),
        "Supplier": by_direction("Supplier", nothing,
                                 F.coalesce(stated("Supplier"), stated("Exporter"))),
        "Buyer": by_direction("Buyer", F.coalesce(stated("Buyer"), stated("Importer")), nothing),
    }).drop("_partner")


def map_feed(feed: DataFrame, file_name: Column, rules: HeaderRules | None = None,
             ports: DataFrame | None = None, headers: list[str] | None = None) -> DataFrame:
    """Canonical text rows of a feed whose files share one header.

    ``file_name`` is the name of each row's file; ``headers`` lists the feed's own columns
    when the frame carries others beside them.
    """
    rules = rules or HeaderRules()
    headers = headers or feed.columns
    df = project_canonical(feed, decide(headers, rules), file_name, rules)
    for rule in (prefer_usd_total, prefer_cif, derive_value, unit_price_from_invoice):
        df = rule(df)
    df = import_port(destination_from_port(df, ports))
    df = unit_price_from_value(stamp_usd(df, headers))
    return consolidate(df).select(*map(col, rules.columns))


def counterparties(df: DataFrame) -> DataFrame:
    """Buyer and seller side of a row whatever its direction."""
    return df.withColumns({"Buyer Side": F.coalesce("Importer", "Buyer"),
                           "Seller Side": F.coalesce("Supplier", "Exporter")})
