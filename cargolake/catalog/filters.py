"""Filters, predicate trees, pages and exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..operators.cleaning import add_search_columns
from ..operators.filters import ShipmentFilter, shortcut
from ..operators.paging import list_by_tree, list_shipments, page_meta, sample_rows
from ..operators.rank_pages import page_at
from ..operators.predicates import Condition, Group, apply_tree, sanitise, tree
from ..schema import NUMERIC_COLUMNS, SHIPMENT_COLUMNS, col
from ..session import scratch
from ..sources.feeds import read_csv
from ..sources.writers import export_shipments, shipment_export
from .registry import add, query
from .views import Views

_SHOWN = {"id": "BE/SB Number", "date": "Date", "hsn": "HSN", "quantity": "Quantity",
          "value": "Value", "importer": "Importer"}
_SHOWN_SQL = ", ".join(f'"{c}" AS {a}' for a, c in _SHOWN.items())


def shown(df: DataFrame) -> DataFrame:
    return df.select(*(col(c).alias(a) for a, c in _SHOWN.items()))


def _filter(name: str, f: ShipmentFilter, where: str, stored: bool = False) -> None:
    def run(v: Views) -> DataFrame:
        df = add_search_columns(v.shipments) if stored else v.shipments
        return shown(f.apply(df))
    add(name, run, f"SELECT {_SHOWN_SQL} FROM shipments WHERE {where}")


_PD = '"Product Description"'
_PD_KEY = f"regexp_replace(lower({_PD}), '[^a-z0-9]', '', 'g')"
_ANY_TEXT = " OR ".join(f'"{c}" ILIKE \'%00012%\'' for c in
                        ("Importer", "Exporter", "Supplier", "Buyer", "Product Description", "HSN"))

_filter("flt_q_multi", ShipmentFilter(q="00012"), _ANY_TEXT)
_filter("flt_q_search", ShipmentFilter(q="Brand#1", use_search_column=True), '''
lower(concat_ws(' | ', "Importer", "Exporter", "Supplier", "Buyer", "Product Description", "HSN"))
LIKE '%brand#1%' ''', stored=True)
_filter("flt_pd_contains", ShipmentFilter(pd="contains|promo;;contains|RING"),
        f"{_PD} ILIKE '%promo%' AND {_PD} ILIKE '%ring%'")
_filter("flt_pd_contains_stored",
        ShipmentFilter(pd="contains|Brand # 1;;contains|g-b", pd_join="or", use_pd_search=True),
        f"{_PD_KEY} LIKE '%brand1%' OR {_PD_KEY} LIKE '%gb%'", stored=True)
_filter("flt_pd_notcontains", ShipmentFilter(pd="notcontains|brand#2;;notcontains|large"),
        f"({_PD} IS NULL OR {_PD} NOT ILIKE '%brand#2%') AND ({_PD} IS NULL OR {_PD} NOT ILIKE '%large%')")
_filter("flt_pd_equals",
        ShipmentFilter(pd="equals|economy SMALL ring brand#2;;equals|PROMO red widget Brand#1",
                       pd_join="OR"),
        f"lower({_PD}) = 'economy small ring brand#2' OR lower({_PD}) = 'promo red widget brand#1'")
_filter("flt_pd_notequals", ShipmentFilter(pd="notequals|ECONOMY small ring Brand#2"),
        f"{_PD} IS NULL OR lower({_PD}) <> 'economy small ring brand#2'")
for _field, _column, _text in (
        ("importer", "Importer", "customer#00000001"), ("exporter", "Exporter", "SUPPLIER#0000_0001"),
        ("supplier", "Supplier", "plier#00000002"), ("buyer", "Buyer", "000017"),
        ("port", "Port", "urgent"), ("origin", "Origin Country", "nation_1"),
        ("destination", "Destination Country", "NATION_2")):
    _name = {"origin": "origin_country", "destination": "destination_country"}.get(_field, _field)
    _filter(f"flt_{_field}", ShipmentFilter(**{_name: _text}), f"\"{_column}\" ILIKE '%{_text}%'")
_filter("flt_hsn_prefix", ShipmentFilter(hsn="29000"), "\"HSN\" ILIKE '29000%'")
_filter("flt_hs_chapter", ShipmentFilter(hs_chapter="38"), "\"HS Chapter\" = '38'")
_filter("flt_country_any", ShipmentFilter(country="nation_7"), '''
"Origin Country" ILIKE '%nation_7%' OR "Destination Country" ILIKE '%nation_7%'
OR "Country" ILIKE '%nation_7%' ''')
_filter("flt_trade_type", ShipmentFilter(trade_type="IMPORT"), "\"Trade Type\" = 'IMPORT'")
_filter("flt_reporting_country", ShipmentFilter(reporting_country="nation_4"),
        "\"Reporting Country\" = 'NATION_4'")
_filter("flt_date_range", ShipmentFilter(date_from=date(1997, 3, 1), date_to=date(1998, 2, 28)),
        "\"Date\" >= DATE '1997-03-01' AND \"Date\" <= DATE '1998-02-28'")
_filter("flt_numeric_range",
        ShipmentFilter(min_value=20000, max_value=50000.5, min_quantity=10, max_quantity=20),
        '"Value" >= 20000 AND "Value" <= 50000.5 AND "Quantity" >= 10 AND "Quantity" <= 20')


@query("flt_shortcuts", f'''
SELECT 'supplier' AS route, {_SHOWN_SQL} FROM shipments
WHERE "Supplier" ILIKE '%00003%' AND "Trade Type" = 'IMPORT'
UNION ALL SELECT 'hsn', {_SHOWN_SQL} FROM shipments WHERE "HSN" ILIKE '380001%'
UNION ALL SELECT 'product', {_SHOWN_SQL} FROM shipments WHERE {_ANY_TEXT.replace("00012", "brand#24")}''')
def shortcuts(v: Views) -> DataFrame:
    routes = {"supplier": shortcut("supplier", "00003", trade_type="IMPORT"),
              "hsn": shortcut("hsn", "380001"), "product": shortcut("product", "brand#24")}
    frames = [shown(f.apply(v.shipments)).select(F.lit(r).alias("route"), "*")
              for r, f in routes.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _tree(name: str, root: Group, where: str) -> None:
    add(name, lambda v: shown(apply_tree(v.shipments, root)),
        f"SELECT {_SHOWN_SQL} FROM shipments WHERE {where}")


def _one(name: str, where: str, field: str, operator: str, **kwargs) -> None:
    _tree(name, Group([Condition(field, operator, **kwargs)]), where)


_one("qb_contains", "\"Importer\" ILIKE '%000003%'", "importer", "contains", value="000003")
_one("qb_not_contains", "\"Importer\" NOT ILIKE '%00001%'", "importer", "not_contains", value="00001")
_one("qb_starts_with", f"{_PD} ILIKE 'promo%'", "product_description", "starts_with", value="promo")
_one("qb_ends_with", f"{_PD} ILIKE '%brand#7'", "product_description", "ends_with", value="brand#7")
_one("qb_equals", "LOWER(\"Port\") = 'port 1-urgent'", "port", "equals", value="Port 1-Urgent")
_one("qb_not_equals", "\"Quantity\" <> 7", "quantity", "not_equals", value="7")
_one("qb_gt", '"Value" > 90000', "value", "greater_than", value=90000)
_one("qb_lt", "\"Date\" < DATE '1996-02-01'", "date", "less_than", value="1996-02-01")
_one("qb_ge", "\"Date\" >= DATE '2001-06-01'", "date", "greater_or_equal", value=date(2001, 6, 1))
_one("qb_le", '"Quantity" <= 3', "quantity", "less_or_equal", value=3)
_one("qb_between", '"Value" BETWEEN 10000 AND 12500.5', "value", "between", values=[1e4, 12500.5])
_one("qb_in_list", "lower(\"Origin Country\") IN ('nation_3', 'nation_9')", "origin_country",
     "in_list", values=["Nation_3", "NATION_9"])
_one("qb_not_in_list", "lower(\"Mode\") NOT IN ('air')", "mode", "not_in_list", values=["Air"])
_one("qb_is_empty", "\"Mode\" IS NULL OR \"Mode\" = ''", "mode", "is_empty")
_one("qb_is_not_empty", '"Value" IS NOT NULL', "value", "is_not_empty")

_tree("qb_group_and", tree({"type": "group", "logic": "AND", "conditions": [
    {"type": "group", "logic": "OR", "conditions": [
        {"type": "condition", "field": "importer", "operator": "contains", "value": "00005"},
        {"type": "condition", "field": "importer", "operator": "contains", "value": "00007"}]},
    {"type": "condition", "field": "hs_chapter", "operator": "equals", "value": "38"},
    {"type": "group", "conditions": []}]}),
    "(\"Importer\" ILIKE '%00005%' OR \"Importer\" ILIKE '%00007%') AND LOWER(\"HS Chapter\") = '38'")
_tree("qb_group_or", Group([
    Condition("trade_type", "equals", "export"), Group([
        Condition("quantity", "greater_than", 45), Condition("city", "in_list", values=["building"])])],
    "OR"),
    "LOWER(\"Trade Type\") = 'export' OR (\"Quantity\" > 45 AND LOWER(\"City\") IN ('building'))")
_tree("qb_negate", Group([
    Condition("hsn", "starts_with", "3800", negate=True),
    Group([Condition("quantity", "less_than", 10), Condition("mode", "equals", "sea")], "OR",
          negate=True)]),
    "NOT (\"HSN\" ILIKE '3800%') AND (NOT (\"Quantity\" < 10 OR LOWER(\"Mode\") = 'sea'))")
_tree("qb_sanitize", sanitise(Group([
    Condition("supplier", "contains", ""), Condition("quantity", "between", values=[1, ""]),
    Group([Condition("port", "in_list", values=[])]), Condition("port", "contains", "low")])),
    "\"Port\" ILIKE '%low%'")


def order_sql(columns, sort_by: str, direction: str = "DESC") -> str:
    rest = ", ".join(f'"{c}" ASC NULLS LAST' for c in columns if c != sort_by)
    return f'ORDER BY "{sort_by}" {direction} NULLS LAST, {rest}'


_ALL = ", ".join(f'"{c}"' for c in SHIPMENT_COLUMNS)


@query("srt_page", f'''
SELECT {_ALL} FROM shipments WHERE "Trade Type" = 'IMPORT'
{order_sql(SHIPMENT_COLUMNS, "Date")} LIMIT 50 OFFSET 50''')
def page_two(v: Views) -> DataFrame:
    return list_shipments(v.shipments, ShipmentFilter(trade_type="IMPORT", page=2))


@query("srt_query_page", f'''
SELECT {_ALL} FROM shipments WHERE "Quantity" >= 40
{order_sql(SHIPMENT_COLUMNS, "Value", "ASC")} LIMIT 25 OFFSET 50''')
def tree_page(v: Views) -> DataFrame:
    root = Group([Condition("quantity", "greater_or_equal", 40)])
    return list_by_tree(v.shipments, root, "value", "asc", number=3, size=25)


def _deep(name: str, sort_by: str, direction: str, number: int, size: int) -> None:
    add(name, lambda v: page_at(v.stored_shipments(), sort_by, direction, number, size, range_rows=1_000), f'''
SELECT {_ALL} FROM shipments
{order_sql(SHIPMENT_COLUMNS, sort_by, direction.upper())} LIMIT {size} OFFSET {(number - 1) * size}''')


_deep("srt_page_deep", "Date", "desc", 100, 50)
_deep("srt_page_deep_ties", "Trade Type", "asc", 71, 61)
_deep("srt_page_deep_nulls", "Importer", "desc", 44, 117)
_deep("srt_page_last", "Value", "asc", 59, 100)


@query("srt_page_meta", '''
SELECT count(*) AS total, 2 AS page, 50 AS page_size,
       CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages
FROM shipments WHERE "HS Chapter" = '29' ''')
def meta(v: Views) -> DataFrame:
    return page_meta(ShipmentFilter(hs_chapter="29").apply(v.shipments), 2, 50)


_PART = """SELECT "BE/SB Number" FROM shipments WHERE "HS Chapter" = '29'"""


@query("srt_sample", f'''SELECT least(500, (SELECT count(*) FROM ({_PART}))) AS rows, true AS all_within''')
def sample(v: Views) -> DataFrame:
    """Size of the sample, and whether it lies within the filtered rows."""
    rows = ShipmentFilter(hs_chapter="29").apply(v.shipments)
    drawn = sample_rows(rows, 500)
    within = F.count_if(F.col("HS Chapter") == "29") == F.count("*")
    return drawn.agg(F.count("*").alias("rows"), within.alias("all_within"))


def _downloaded(v: Views, f: ShipmentFilter, cap: int | None) -> DataFrame:
    """The download is written and read back as text."""
    path = scratch(v.spark, "export")
    export_shipments(v.shipments, f, path, cap)
    df = read_csv(v.spark, [path])
    return df.withColumnRenamed("\ufeffDate", "Date")


_TEXTS = [c for c in SHIPMENT_COLUMNS if c not in NUMERIC_COLUMNS]
_TEXTS_SQL = ", ".join(f'CAST("{c}" AS STRING) AS "{c}"' for c in _TEXTS)


@query("snk_export_csv", f'''
SELECT {_TEXTS_SQL} FROM shipments WHERE "Exporter" ILIKE '%00001%' ''')
def export(v: Views) -> DataFrame:
    return _downloaded(v, ShipmentFilter(exporter="00001", sort_by="Value"), None).select(*map(col, _TEXTS))


@query("snk_export_csv_large", f'''
SELECT {_SHOWN_SQL} FROM (SELECT * FROM shipments
{order_sql(SHIPMENT_COLUMNS, "Date")} LIMIT 12000)''')
def export_large(v: Views) -> DataFrame:
    return shown(shipment_export(v.shipments, ShipmentFilter(), 12000))


