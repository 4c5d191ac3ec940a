"""Nested predicate trees: groups (AND / OR, negation) of conditions on known fields."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from datetime import date
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import contains, ends_with, starts_with
from ..schema import col

EMPTY_OPS = ("is_empty", "is_not_empty")
LIST_OPS = ("in_list", "not_in_list")
ORDER_OPS = ("greater_than", "less_than", "greater_or_equal", "less_or_equal", "between")
OPERATORS = {
    "text": ("contains", "not_contains", "equals", "not_equals", "starts_with", "ends_with",
             *LIST_OPS, *EMPTY_OPS),
    "number": ("equals", "not_equals", *ORDER_OPS, *EMPTY_OPS),
    "date": ("equals", "not_equals", *ORDER_OPS, *EMPTY_OPS),
    "enum": ("equals", "not_equals", *LIST_OPS, *EMPTY_OPS),
}

# Queryable field, its column, its label and its type.
FIELDS = {
    "date": ("Date", "Date", "date"),
    "importer": ("Importer", "Importer", "text"),
    "exporter": ("Exporter", "Exporter", "text"),
    "supplier": ("Supplier", "Supplier", "text"),
    "buyer": ("Buyer", "Buyer", "text"),
    "hsn": ("HSN", "HSN", "text"),
    "hs_chapter": ("HS Chapter", "HS Chapter", "text"),
    "iec": ("IEC", "IEC", "text"),
    "origin_country": ("Origin Country", "Origin Country", "text"),
    "destination_country": ("Destination Country", "Destination Country", "text"),
    "port": ("Port", "Port", "text"),
    "quantity": ("Quantity", "Quantity", "number"),
    "value": ("Value", "Value (declared)", "number"),
    "product_description": ("Product Description", "Product Description", "text"),
    "trade_type": ("Trade Type", "Trade Type", "enum"),
    "mode": ("Mode", "Mode of Shipment", "text"),
    "city": ("City", "City", "text"),
    "state": ("State", "State", "text"),
    "cha_name": ("CHA Name", "CHA Name", "text"),
    "currency": ("Currency", "Currency", "text"),
    "unit": ("Unit", "Unit (UQC)", "text"),
}
ENUM_VALUES = {"trade_type": ("IMPORT", "EXPORT")}
SORT_FIELDS = ("date", "importer", "exporter", "supplier", "buyer", "hsn", "value", "quantity",
               "origin_country", "destination_country", "trade_type", "hs_chapter")


class PredicateError(ValueError):
    """Unknown field, operator that does not suit the field, or missing values."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None
    values: tuple | list | None = None
    negate: bool = False

    def column(self) -> Column:
        if self.field not in FIELDS:
            raise PredicateError(f"unknown field {self.field!r}")
        name, _, kind = FIELDS[self.field]
        if self.operator not in OPERATORS[kind]:
            raise PredicateError(f"{self.operator!r} does not apply to the {kind} field {self.field!r}")
        test = self._test(col(name), kind)
        return ~test if self.negate else test

    def _test(self, c: Column, kind: str) -> Column:
        textual = kind in ("text", "enum")
        if self.operator in EMPTY_OPS:
            empty = (c.isNull() | (c == "")) if textual else c.isNull()
            filled = (c.isNotNull() & (c != "")) if textual else c.isNotNull()
            return empty if self.operator == "is_empty" else filled
        if self.operator in LIST_OPS:
            if not self.values:
                raise PredicateError(f"{self.operator} needs at least one value")
            member = F.lower(c).isin(*(str(v).lower() for v in self.values))
            return member if self.operator == "in_list" else ~member
        if self.operator == "between":
            if len(self.values or ()) != 2:
                raise PredicateError("between needs exactly two values")
            return c.between(*(_literal(v, kind) for v in self.values))
        if self.value is None:
            raise PredicateError(f"{self.operator} needs a value")
        if self.operator in ("contains", "not_contains"):
            found = contains(c, self.value)
            return found if self.operator == "contains" else ~found
        if self.operator == "starts_with":
            return starts_with(c, self.value)
        if self.operator == "ends_with":
            return ends_with(c, self.value)
        wanted = _literal(self.value, kind)
        if textual:
            c, wanted = F.lower(c), F.lower(wanted)
        return {"equals": c == wanted, "not_equals": c != wanted, "greater_than": c > wanted,
                "less_than": c < wanted, "greater_or_equal": c >= wanted,
                "less_or_equal": c <= wanted}[self.operator]


@dataclass(frozen=True)
class Group:
    conditions: list[Group | Condition] = dc_field(default_factory=list)
    logic: str = "AND"
    negate: bool = False

    def column(self) -> Column | None:
        """The group as one Column; empty groups vanish."""
        if self.logic not in ("AND", "OR"):
            raise PredicateError(f"unknown logic {self.logic!r}")
        parts = [c for c in (node.column() for node in self.conditions) if c is not None]
        if not parts:
            return None
        whole = reduce(and_ if self.logic == "AND" else or_, parts)
        return ~whole if self.negate else whole


def _literal(value: Any, kind: str) -> Column:
    if kind == "number":
        return F.lit(float(value))
    if kind == "date":
        return F.lit(value if isinstance(value, date) else date.fromisoformat(str(value)[:10]))
    return F.lit(str(value))


def tree(node: dict) -> Group | Condition:
    """Tree of a plain (JSON) document; unknown keys are an error."""
    body = {k: v for k, v in node.items() if k != "type"}
    if node.get("type") == "condition":
        return Condition(**body)
    return Group(**{**body, "conditions": [tree(n) for n in body.get("conditions", ())]})


def sanitise(node: Group | Condition) -> Group | Condition | None:
    """The tree without unfinished conditions and without the groups they leave empty."""
    if isinstance(node, Group):
        kept = [n for n in map(sanitise, node.conditions) if n is not None]
        return Group(kept, node.logic, node.negate) if kept else None
    if not node.field:
        return None
    if node.operator in EMPTY_OPS:
        return node
    if node.operator == "between":
        ok = len(node.values or ()) == 2 and all(v not in ("", None) for v in node.values)
    elif node.operator in LIST_OPS:
        ok = bool(node.values)
    else:
        ok = node.value not in ("", None)
    return node if ok else None


def apply_tree(df: DataFrame, root: Group | None) -> DataFrame:
    where = root.column() if root else None
    return df if where is None else df.filter(where)


def explain(root: Group | None) -> str:
    """The condition the tree stands for, as Spark prints it."""
    where = root.column() if root else None
    return "" if where is None else str(where)


def summary(root: Group | None) -> dict[str, Any]:
    if root is None:
        return {}

    def count(node: Group | Condition) -> tuple[int, int]:
        if isinstance(node, Condition):
            return 1, 0
        inner = [count(n) for n in node.conditions]
        return sum(c for c, _ in inner), 1 + sum(g for _, g in inner)

    n_conditions, n_groups = count(root)
    return {"conditions": n_conditions, "groups": n_groups, "root_logic": root.logic}


def field_listing(spark: SparkSession) -> DataFrame:
    """The queryable fields with their operators, for a query screen."""
    rows = [(name, label, kind, list(OPERATORS[kind]), list(ENUM_VALUES.get(name, ())) or None)
            for name, (_, label, kind) in FIELDS.items()]
    return spark.createDataFrame(rows, "name string, label string, type string, "
                                       "operators array<string>, enum_values array<string>")
