"""The shared shipment filter: optional predicates, all of which must hold."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains, key_text, like, like_pattern, starts_with
from ..schema import SEARCH_COLUMNS, SORTABLE_COLUMNS, col

TRADE_TYPES = ("IMPORT", "EXPORT")


def conditions(text: str | list[str]) -> list[tuple[str, str]]:
    """``op|value`` conditions; those without a value are left out."""
    items = text.split(";;") if isinstance(text, str) else text
    pairs = ((op.strip().lower(), value.strip())
             for op, _, value in (str(item).partition("|") for item in items))
    return [(op, value) for op, value in pairs if value]


def combine(parts: list[Column], join: str | None) -> Column | None:
    """Parts joined by OR when asked for, else by AND; nothing from an empty list."""
    if not parts:
        return None
    return reduce(or_ if (join or "and").lower() == "or" else and_, parts)


def any_contains(names, text: str) -> Column:
    return reduce(or_, (contains(col(n), text) for n in names))


def product_condition(op: str, value: str, stored_key: bool = False) -> Column | None:
    """One product condition. The negative ones also hold for a missing description."""
    text = F.col("Product Description")
    if op == "contains":
        return like(F.col("_pd_search"), key_text(value)) if stored_key else contains(text, value)
    if op == "notcontains":
        if stored_key:
            return ~like(F.coalesce(F.col("_pd_search"), F.lit("")), key_text(value))
        return text.isNull() | ~contains(text, value)
    if op == "equals":
        return F.lower(text) == F.lower(F.lit(value))
    if op == "notequals":
        return text.isNull() | (F.lower(text) != F.lower(F.lit(value)))
    return None


@dataclass(frozen=True)
class ShipmentFilter:
    """Every field is optional. ``%`` and ``_`` in a text act as wildcards.

    The two flags make free text and product conditions read the stored search columns
    of ``add_search_columns``.
    """

    q: str | None = None
    pd: str | None = None
    pd_join: str | None = None
    importer: str | None = None
    exporter: str | None = None
    supplier: str | None = None
    buyer: str | None = None
    port: str | None = None
    hsn: str | None = None
    hs_chapter: str | None = None
    country: str | None = None
    origin_country: str | None = None
    destination_country: str | None = None
    trade_type: str | None = None
    reporting_country: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    min_value: float | None = None
    max_value: float | None = None
    min_quantity: float | None = None
    max_quantity: float | None = None
    page: int = 1
    page_size: int = 50
    sort_by: str | None = None
    sort_order: str = "desc"
    use_search_column: bool = False
    use_pd_search: bool = False

    def __post_init__(self) -> None:
        if self.sort_by and self.sort_by not in SORTABLE_COLUMNS:
            raise ValueError(f"sort_by must be one of {sorted(SORTABLE_COLUMNS)}")
        if self.sort_order not in ("asc", "desc"):
            raise ValueError("sort_order must be asc or desc")
        if self.trade_type and self.trade_type not in TRADE_TYPES:
            raise ValueError(f"trade_type must be one of {TRADE_TYPES}")
        if self.page < 1 or not 1 <= self.page_size <= 1000:
            raise ValueError("page starts at 1, page_size lies between 1 and 1000")
        for low, high in (("date_from", "date_to"), ("min_value", "max_value"),
                          ("min_quantity", "max_quantity")):
            a, b = getattr(self, low), getattr(self, high)
            if a is not None and b is not None and a > b:
                raise ValueError(f"{low} must be <= {high}")

    def _product(self) -> Column | None:
        built = (product_condition(op, value, self.use_pd_search)
                 for op, value in conditions(self.pd or ""))
        return combine([c for c in built if c is not None], self.pd_join)

    def predicates(self) -> dict[str, Column]:
        """The active predicates by field name."""
        active: dict[str, Column | None] = {}
        if self.q:
            active["q"] = (F.col("_search").like(like_pattern(f"%{self.q.lower()}%"))
                           if self.use_search_column else any_contains(SEARCH_COLUMNS, self.q))
        if self.pd:
            active["product"] = self._product()
        for name, target in (("importer", "Importer"), ("exporter", "Exporter"),
                             ("supplier", "Supplier"), ("buyer", "Buyer"), ("port", "Port"),
                             ("origin_country", "Origin Country"),
                             ("destination_country", "Destination Country")):
            if value := getattr(self, name):
                active[name] = contains(col(target), value)
        if self.hsn:
            # A digit prefix reaches the Parquet scan, a pattern does not.
            active["hsn"] = (F.col("HSN").startswith(self.hsn) if self.hsn.isdigit()
                             else starts_with(F.col("HSN"), self.hsn))
        if self.hs_chapter:
            active["hs_chapter"] = F.col("HS Chapter") == self.hs_chapter
        if self.country:
            active["country"] = any_contains(
                ("Origin Country", "Destination Country", "Country"), self.country)
        if self.trade_type:
            active["trade_type"] = F.col("Trade Type") == self.trade_type
        if self.reporting_country:
            active["reporting_country"] = (
                F.col("Reporting Country") == self.reporting_country.upper())
        if self.date_from:
            active["date_from"] = F.col("Date") >= F.lit(self.date_from)
        if self.date_to:
            active["date_to"] = F.col("Date") <= F.lit(self.date_to)
        for name, target in (("value", "Value"), ("quantity", "Quantity")):
            low, high = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if low is not None:
                active[f"min_{name}"] = F.col(target) >= float(low)
            if high is not None:
                active[f"max_{name}"] = F.col(target) <= float(high)
        return {k: v for k, v in active.items() if v is not None}

    def applied(self) -> dict[str, object]:
        """The filters in force, as given, for the page description."""
        return {k: getattr(self, "pd" if k == "product" else k) for k in self.predicates()}

    def apply(self, df: DataFrame) -> DataFrame:
        parts = list(self.predicates().values())
        return df.filter(reduce(and_, parts)) if parts else df


def shortcut(name: str, value: str, **others) -> ShipmentFilter:
    """The filter behind the search by one entity; a product search is free text."""
    allowed = ("importer", "exporter", "supplier", "buyer", "hsn", "country", "product")
    if name not in allowed:
        raise ValueError(f"shortcut must be one of {allowed}")
    return ShipmentFilter(**{**others, "q" if name == "product" else name: value})
