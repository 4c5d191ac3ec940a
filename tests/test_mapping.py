"""Header rules and value rules on small feeds."""
import pytest
from pyspark.sql import functions as F

from cargolake.operators import mapping as m
from cargolake.operators.headers import (COLUMN_OF_HEADER, IGNORED_HEADERS, HeaderRules, decide,
                                         mapping_report, normalise, single_sources)
from cargolake.schema import SHIPMENT_COLUMNS


def feed(spark, file_name, **cells):
    names = list(cells)
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([tuple(cells.values())], schema)
    row = m.map_feed(df, F.lit(file_name), headers=names).first()
    return row.asDict()


def test_header_rules():
    rules = HeaderRules()
    assert len(rules.exact) == len(COLUMN_OF_HEADER) == 106
    assert len(rules.joined) == 19 and len(IGNORED_HEADERS) == 36
    assert normalise(" BE-Date ") == normalise("be_date") == "bedate" and normalise(None) == ""
    got = {d.source_column: (d.target_column, d.strategy) for d in decide(
        ["BE_Date", "Period", "Importer Add 01", "Qty.", "Unit Rate (USD)", "abc", "Quantityy",
         "Std. Unit Rate $"], rules)}
    assert got == {"BE_Date": ("Date", "exact"), "Period": (None, "ignored"),
                   "Importer Add 01": ("Importer Address", "merge_group"),
                   "Qty.": ("Quantity", "exact"), "Unit Rate (USD)": (None, "ignored"),
                   "abc": (None, "unmapped"), "Quantityy": ("Quantity", "fuzzy"),
                   "Std. Unit Rate $": ("Unit Price USD", "exact")}


def test_last_exact_header_wins_and_fuzzy_only_fills():
    rules = HeaderRules()
    assert single_sources(decide(["Value", "Invoice Value"], rules))["Value"] == "Invoice Value"
    assert single_sources(decide(["Quantity", "Quantityy"], rules))["Quantity"] == "Quantity"


def test_rules_from_document():
    rules = HeaderRules.from_json('{"standard_columns": ["A"], "mappings": {"Col A": "A"}}')
    assert rules.exact == {"cola": "A"} and rules.columns == ("A",) and not rules.ignored
    with pytest.raises(ValueError):
        HeaderRules.from_json('{"mappings": {}}')


def test_file_metadata(spark):
    names = {"Turkey Import Chapter 29 and 38.xlsx": ("IMPORT", "29", "TURKEY"),
             "3808 ALL EXPORT TO WORLD APR 25.csv": ("EXPORT", "3808", "INDIA"),
             "29_import.csv": ("IMPORT", None, "INDIA"),
             "viet nam import export.csv": ("EXPORT", None, "VIETNAM"),
             "plain.csv": (None, None, "INDIA"), "12345 x": (None, None, "INDIA")}
    df = spark.createDataFrame([(n,) for n in names], "f string")
    meta = m.file_metadata(F.col("f"))
    assert {r[0]: tuple(r[1:]) for r in df.select("f", *meta.values()).collect()} == names


def test_canonical_columns_and_import_roles(spark):
    row = feed(spark, "Peru Import 29.csv", **{
        "Consignee": " ACME ", "Shipper": "Foreign Co", "Country": "PERU",
        "Export Country": "China", "Junk": "x"})
    assert tuple(row) == SHIPMENT_COLUMNS
    assert row["Importer"] == "ACME" and row["Supplier"] == "Foreign Co"
    assert row["Buyer"] is None and row["Exporter"] is None
    assert (row["Origin Country"], row["Destination Country"], row["Country"]) == (
        "China", "PERU", "China")
    assert row["Reporting Country"] == "PERU" and row["HS Chapter"] == "29"


def test_export_roles_and_own_chapter(spark):
    row = feed(spark, "export 38.csv", **{"Exporter": "Home", "Consignee": "", "Importer": "Far",
                                          "Foreign Country": "india", "Country": "Kenya",
                                          "Chapter": "29"})
    assert (row["Exporter"], row["Buyer"], row["Importer"], row["Supplier"]) == (
        "Home", "Far", None, None)
    assert (row["Origin Country"], row["Destination Country"], row["Country"]) == (
        "INDIA", "Kenya", "Kenya")
    assert row["HS Chapter"] == "29"


def test_unknown_direction_is_left_alone(spark):
    row = feed(spark, "feed.csv", Importer="A", Exporter="B", Country="C")
    assert (row["Importer"], row["Exporter"], row["Country"], row["Trade Type"]) == (
        "A", "B", "C", None)


@pytest.mark.parametrize("cells,value", [
    ({"Value": "5", "Total Value in USD": " 7 "}, "7"), ({"Total Value in USD": " ", "Value": "5"}, "5"),
    ({"Value": "5", "Value CIF $": " 1,000 "}, "1,000"), ({"Value FOB": "5", "Value CIF $": "0"}, "0"),
    ({"Value CIF US$": "x", "Value": "5"}, "5"), ({"Quantity": "1,000", "Unit_Price": "2.5"}, "2500.0"),
    ({"Quantity": "3", "Unit_Price": "2", "Value": "9"}, "9"), ({"Quantity": "x", "Unit_Price": "2"}, None),
])
def test_value_rules(spark, cells, value):
    assert feed(spark, "import.csv", **cells)["Value"] == value


@pytest.mark.parametrize("file_name,cells,price", [
    ("import.csv", {"Currency": "usd", "Invoice_Unit_Price_FC": "4"}, "4"),
    ("import.csv", {"Currency": "EUR", "Invoice_Unit_Price_FC": "4"}, None),
    ("Colombia import.csv", {"Value": "10", "Quantity": "3"}, "3.3333"),
    ("Colombia import.csv", {"Value": "10", "Quantity": "0"}, None),
    ("Colombia import.csv", {"Value": "10", "Quantity": "4", "CIF Unit": "9"}, "9"),
    ("Peru import.csv", {"Value": "10", "Quantity": "4"}, None),
])
def test_unit_price_rules(spark, file_name, cells, price):
    assert feed(spark, file_name, **cells)["Unit Price USD"] == price


def test_usd_stamp_ports_and_addresses(spark):
    row = feed(spark, "import.csv", **{"Currency": "COP", "Unit Rate": "3", "Port": "Abroad",
                                       "Port of Destination": " Home ", "Importer Address": "a",
                                       "Importer Add 01": " ", "Importer Add 02": None,
                                       "Importer Add 03": "b"})
    assert row["Currency"] == "USD" and row["Port"] == "Home"
    assert row["Importer Address"] == "a |   | b"
    empty = feed(spark, "import.csv", **{"Buyer Address": None, "Consignee Add 01": ""})
    assert empty["Buyer Address"] is None


def test_destination_from_port(spark):
    ports = spark.createDataFrame([("Santos ", "BRAZIL"), ("SANTOS", "BRAZIL"), ("Lima", "PERU")],
                                  "port string, country string")
    df = spark.createDataFrame([("santos", None), ("nowhere", None), ("lima", "Chile"), (None, None)],
                               "`Port of Destination` string, `Destination Country` string")
    rows = m.map_feed(df, F.lit("export.csv"), ports=ports).select("Destination Country").collect()
    assert sorted(str(r[0]) for r in rows) == ["BRAZIL", "Chile", "None", "None"]


def test_mapping_report(spark):
    df = spark.createDataFrame([("1", "f1"), ("2", "f1"), ("3", "f2")], "Qty string, f string")
    rows = {tuple(r) for r in mapping_report(df, F.col("f"), ["Qty", "zzzzz"]).collect()}
    assert rows == {(f, "Qty", "qty", "Quantity", "exact", None) for f in ("f1", "f2")} | {
        (f, "zzzzz", "zzzzz", None, "unmapped", None) for f in ("f1", "f2")}
