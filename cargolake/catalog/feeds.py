"""Sources, header mapping, value rules, sinks and the whole build."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import agbio
from ..operators import mapping as m
from ..operators.argentina import folded_header
from ..operators.cleaning import clean, dedupe_across_files
from ..operators.headers import HeaderRules, decide, mapping_report, normalise, normalise_column
from ..functions.text import folded_key
from ..plans.build import build_shipments
from ..schema import SHIPMENT_COLUMNS, col
from ..session import scratch
from ..sources import feeds, writers
from .cleaning import _FOLD as FOLDED
from .filters import order_sql
from .registry import add, query, rounded
from .views import Views

def _headers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "file_name"]


def _projected(v: Views, name: str) -> DataFrame:
    """A raw feed as canonical text columns, before any value rule."""
    raw = v[name]
    rules = HeaderRules()
    return m.project_canonical(raw, decide(_headers(raw), rules), F.col("file_name"), rules)


def _pick(df: DataFrame, **names: str) -> DataFrame:
    return df.select(F.col("BE/SB Number").alias("id"), *(col(c).alias(a) for a, c in names.items()))


# Sources.

@query("src_scan_folder", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, 'parquet' AS suffix, count(*) AS rows FROM {t}"
    for t in ("benchmark", "conversations", "customer", "documents", "embeddings", "events",
              "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")))
def scan(v: Views) -> DataFrame:
    return _file_rows(v, feeds.scan_folder(v.spark, v.folder))


@query("src_limit_files", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, 'parquet' AS suffix, count(*) AS rows FROM {t}"
    for t in ("benchmark", "conversations", "customer")))
def limit_files(v: Views) -> DataFrame:
    return _file_rows(v, feeds.first_files(feeds.scan_folder(v.spark, v.folder), 3))


def _file_rows(v: Views, files: DataFrame) -> DataFrame:
    """Row count of each listed file."""
    parts = [v.spark.read.parquet(feeds.literal_path(r["path"])).agg(F.count("*").alias("rows"))
             .select(F.lit(r["name"]).alias("name"), F.lit(r["suffix"]).alias("suffix"), "rows")
             for r in files.collect()]
    return reduce(DataFrame.unionByName, parts)


_RAW = '''"BE_NO", "ImporterName", "Quantity", "Country",
  coalesce("Importer_Add_02", '') AS "Importer_Add_02"'''


@query("src_csv_strings", f"SELECT {_RAW} FROM raw_import")
def csv_strings(v: Views) -> DataFrame:
    """Two feeds of one layout with their columns in opposite order."""
    path = scratch(v.spark, "feed-csv")
    raw = v["raw_import"].drop("file_name")
    early = F.col("Period") < "1995"
    writers.write_csv(raw.filter(early), f"{path}/a")
    writers.write_csv(raw.filter(early.isNull() | ~early).select(*map(col, reversed(raw.columns))), f"{path}/b")
    df = feeds.read_csv(v.spark, [f"{path}/a", f"{path}/b"])
    return df.select("BE_NO", "ImporterName", "Quantity", "Country",
                     F.coalesce("Importer_Add_02", F.lit("")).alias("Importer_Add_02"))


@query("src_parquet_strings", '''
SELECT CAST(l_orderkey AS STRING) AS l_orderkey, CAST(l_linenumber AS STRING) AS l_linenumber,
       CAST(l_quantity AS STRING) AS l_quantity, CAST(l_extendedprice AS STRING) AS l_extendedprice,
       CAST(l_shipdate AS STRING) AS l_shipdate, l_returnflag FROM lineitem''')
def parquet_strings(v: Views) -> DataFrame:
    return feeds.read_parquet(v.spark, [f"{v.folder}/lineitem.parquet"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


@query("src_union_parts", '''
SELECT "BE/SB Number" AS id, "Importer" AS party, "Port" AS port, NULL::VARCHAR AS mode
FROM shipments WHERE "Trade Type" = 'IMPORT'
UNION ALL SELECT "BE/SB Number", "Buyer", NULL, "Mode" FROM shipments WHERE "Trade Type" = 'EXPORT' ''')
def union_parts(v: Views) -> DataFrame:
    key, df = F.col("BE/SB Number").alias("id"), v.shipments
    return feeds.union_parts({
        "29": df.filter(F.col("Trade Type") == "IMPORT").select(
            key, F.col("Importer").alias("party"), F.col("Port").alias("port")),
        "38": df.filter(F.col("Trade Type") == "EXPORT").select(
            key, F.col("Buyer").alias("party"), F.col("Mode").alias("mode")),
        " Notes ": df.select(key, F.col("City").alias("party")),
        "empty": df.filter("false").select(key, F.col("City").alias("party")),
        "narrow": df.select(key)})


@query("set_union_by_name", '''
SELECT "Trade Type" AS trade_type, "Source File" AS source_file, count(*) AS rows,
       count("Value") AS with_value FROM repeated GROUP BY 1, 2''')
def union_by_name(v: Views) -> DataFrame:
    df = v["repeated"]
    parts = {t: df.filter(F.col("Trade Type") == t).select(*reversed(df.columns) if t == "EXPORT"
                                                           else df.columns)
             for t in ("IMPORT", "EXPORT")}
    return (feeds.union_parts(parts)
            .groupBy(F.col("Trade Type").alias("trade_type"), F.col("Source File").alias("source_file"))
            .agg(F.count("*").alias("rows"), F.count("Value").alias("with_value")))


@query("src_shards_by_name", '''
SELECT "BE/SB Number" AS id, "Trade Type" AS trade_type,
       CASE WHEN "Trade Type" = 'IMPORT' THEN "Port" END AS port,
       CASE WHEN "Trade Type" = 'EXPORT' THEN "Mode" END AS mode FROM shipments''')
def shards(v: Views) -> DataFrame:
    folder = scratch(v.spark, "shards")
    for trade, column in (("IMPORT", "Port"), ("EXPORT", "Mode")):
        (v.shipments.filter(F.col("Trade Type") == trade)
         .select(F.col("BE/SB Number").alias("id"), F.col("Trade Type").alias("trade_type"),
                 col(column).alias(column.lower()))
         .write.mode("append").parquet(folder))
    return feeds.read_shards(v.spark, folder).select("id", "trade_type", "port", "mode")


def market_files(v: Views) -> str:
    """Market rows as the source delivers them: files that begin with two title lines."""
    path, parts = scratch(v.spark, "market-csv"), 4
    raw = v["market"].select(*(col(c).cast("string").alias(c) for c in agbio.COLUMNS))
    names = [[f"Group {i}" for i in range(len(agbio.COLUMNS))],
             ["AI", "Type", "Country", *["AI Value (m.)"] * 14, "Total"]]
    titles = v.spark.createDataFrame([tuple(n) for n in names], raw.schema).select(
        "*", F.when(F.col("product") == "AI", 1).otherwise(0).alias("_line"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = raw.select("*", F.lit(2).alias("_line"),
                      F.pmod(F.hash(*map(col, agbio.COLUMNS)), F.lit(parts)).alias("part"))
    (titles.unionByName(rows).repartition(parts, "part").sortWithinPartitions("part", "_line")
     .drop("_line").write.option("header", "false").option("emptyValue", "").partitionBy("part").csv(path))
    return path


@query("src_positional_header", '''
SELECT product, type, country, cereals, vine, total_usd_m, 'market.csv' AS source_file
FROM market''')
def positional(v: Views) -> DataFrame:
    path = market_files(v)
    df = agbio.load(feeds.read_positional(v.spark, path, agbio.COLUMNS), F.lit("market.csv"))
    return df.select("product", "type", "country", "cereals", "vine", "total_usd_m", "source_file")


_STEM = '''upper(CASE "Mode" WHEN 'AIR' THEN 'Viet Nam import ' || "HS Chapter" || ' year '
    WHEN 'SEA' THEN 'South Africa EXPORT of IMPORTS ' ELSE 'feed_29_' END
  || substr("Source File", 8, 4))'''


@query("src_file_metadata", f'''
WITH f AS (SELECT "BE/SB Number" AS id, {_STEM} AS stem FROM shipments)
SELECT id, CASE WHEN contains(stem, 'EXPORT') THEN 'EXPORT' WHEN contains(stem, 'IMPORT') THEN 'IMPORT' END
         AS trade_type,
       nullif(regexp_extract(stem, '\\b([0-9]{{2,4}})\\b', 1), '') AS hs_chapter,
       CASE WHEN contains(stem, 'VIET NAM') THEN 'VIETNAM' WHEN contains(stem, 'SOUTH AFRICA') THEN 'SOUTH AFRICA'
            ELSE 'INDIA' END AS reporting_country FROM f''')
def file_metadata(v: Views) -> DataFrame:
    name = F.expr(_STEM.replace('"', "`") + " || '.Csv'")
    meta = m.file_metadata(F.col("file_name"))
    return (v.shipments.select(F.col("BE/SB Number").alias("id"), name.alias("file_name"))
            .select("id", *(c.alias(n) for n, c in meta.items())))


# Header rules.

@query("map_header_norm", '''
SELECT "BE/SB Number" AS id, regexp_replace(lower(trim("Product Description")), '[^a-z0-9]+', '', 'g')
       AS header FROM shipments''')
def header_norm(v: Views) -> DataFrame:
    return v.shipments.select(F.col("BE/SB Number").alias("id"),
                              normalise_column(F.col("Product Description")).alias("header"))


@query("map_header_norm_accent", f'''
SELECT doc_id, regexp_replace(lower('Formulacion ' || {FOLDED} || ' (%) n'), '[^a-z0-9]', '', 'g') AS header
FROM texts''')
def header_norm_accent(v: Views) -> DataFrame:
    assert folded_header("Formulación (%)") == "formulacion" and normalise("BE_Date") == "bedate"
    header = F.concat(F.lit("Fórmulación "), F.col("Product Description"), F.lit(" (%) ñ"))
    return v["texts"].select("doc_id", folded_key(header).alias("header"))


def _text(name: str, view: str, sql: str, **names: str) -> None:
    add(name, lambda v: _pick(_projected(v, view), **names), sql)


_text("map_exact", "raw_import", '''
SELECT "BE_NO" AS id, "BE_Date" AS date, "CTH_HSCODE" AS hsn, "UQC" AS unit,
       "Port of Shipment" AS port FROM raw_import''', date="Date", hsn="HSN", unit="Unit", port="Port")
_text("map_exact_last_wins", "raw_export", '''
SELECT "SB No" AS id, "Value CIF $" AS value, "Indian Port" AS port FROM raw_export''',
      value="Value", port="Port")
_text("map_merge_group", "raw_import", '''
SELECT "BE_NO" AS id, array_to_string(list_filter(["Importer_Add_01", "Importer_Add_02",
       "Importer_Add_03"], lambda x: x <> ''), ' | ') AS address FROM raw_import''',
      address="Importer Address")
_text("map_fuzzy_header", "raw_import", '''
SELECT "BE_NO" AS id, "Product_Descriptin" AS product FROM raw_import''',
      product="Product Description")
_text("map_stamp_literals", "raw_import", '''
SELECT "BE_NO" AS id, 'IMPORT' AS trade_type, file_name AS source_file,
       CASE WHEN file_name LIKE 'Turkey%' THEN 'TURKEY' WHEN file_name LIKE 'colombia%' THEN 'COLOMBIA'
            ELSE 'INDIA' END AS reporting FROM raw_import''',
      trade_type="Trade Type", source_file="Source File", reporting="Reporting Country")
_text("map_hs_chapter", "raw_export", '''
SELECT "SB No" AS id, coalesce("Chapter", CASE WHEN file_name LIKE '3808%' THEN '3808'
       WHEN file_name LIKE 'Australia%' THEN '29' END) AS chapter FROM raw_export''',
      chapter="HS Chapter")

@query("map_ignore", '''
SELECT f.file_name AS source_file, d.source_column, d.normalised
FROM (SELECT DISTINCT file_name FROM raw_import) f CROSS JOIN (VALUES
  ('Port of Destination', 'portofdestination'), ('Unit_Price', 'unitprice'),
  ('Invoice_Unit_Price_FC', 'invoiceunitpricefc'), ('Period', 'period')) d(source_column, normalised)''')
def ignored(v: Views) -> DataFrame:
    return (_report(v).filter(F.col("strategy") == "ignored")
            .select("source_file", "source_column", "normalised"))


def _report(v: Views) -> DataFrame:
    raw = v["raw_import"]
    return mapping_report(raw, F.col("file_name"), _headers(raw))


_DECISIONS = [
    ("BE_Date", "bedate", "Date", "exact"), ("BE_NO", "beno", "BE/SB Number", "exact"),
    ("CTH_HSCODE", "cthhscode", "HSN", "exact"),
    ("ImporterName", "importername", "Importer", "exact"),
    ("Consignee Name", "consigneename", "Buyer", "exact"),
    ("SupplierName", "suppliername", "Supplier", "exact"),
    ("Shipper Name", "shippername", "Exporter", "exact"),
    ("Country_of_Origin", "countryoforigin", "Origin Country", "exact"),
    ("Country", "country", "Country", "exact"),
    ("Importing Country", "importingcountry", "Destination Country", "exact"),
    ("Port of Destination", "portofdestination", None, "ignored"),
    ("Port of Shipment", "portofshipment", "Port", "exact"),
    ("Quantity", "quantity", "Quantity", "exact"), ("UQC", "uqc", "Unit", "exact"),
    ("Total_Ass_Value", "totalassvalue", "Value", "exact"),
    ("Unit_Price", "unitprice", None, "ignored"),
    ("Invoice_Unit_Price_FC", "invoiceunitpricefc", None, "ignored"),
    ("INVOICE_CURRENCY", "invoicecurrency", "Currency", "exact"),
    ("Product_Descriptin", "productdescriptin", "Product Description", "fuzzy"),
    ("Importer_Add_01", "importeradd01", "Importer Address", "merge_group"),
    ("Importer_Add_02", "importeradd02", "Importer Address", "merge_group"),
    ("Importer_Add_03", "importeradd03", "Importer Address", "merge_group"),
    ("Period", "period", None, "ignored"), ("Zq Xv Remark", "zqxvremark", None, "unmapped"),
    ("Mode of Shipment", "modeofshipment", "Mode", "exact"),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


add("snk_mapping_report", _report, f'''
SELECT f.file_name AS source_file, d.*
FROM (SELECT DISTINCT file_name FROM raw_import) f CROSS JOIN (VALUES
{", ".join("(" + ", ".join(map(_quoted, d)) + (", 97)" if d[3] == "fuzzy" else ", NULL)") for d in _DECISIONS)}
) d(source_column, normalised, target_column, strategy, fuzzy_score)''')


# Value rules.

def _num(c: str) -> str:
    return f"TRY_CAST(replace({c}, ',', '') AS DOUBLE)"


def _rule(name: str, view: str, rule, sql: str, **names: str) -> None:
    add(name, lambda v: _pick(rule(_projected(v, view)), **names), sql)


_rule("map_prefer_usd_total", "raw_export", m.prefer_usd_total, '''
SELECT "SB No" AS id, coalesce(nullif(trim("Total_Value_in_USD"), ''), "Value CIF $") AS value
FROM raw_export''', value="Value")
_rule("map_prefer_cif", "raw_export", lambda df: m.prefer_cif(m.prefer_usd_total(df)), f'''
SELECT "SB No" AS id, CASE WHEN {_num('trim("Value CIF $")')} > 0 THEN trim("Value CIF $")
  ELSE coalesce(nullif(trim("Total_Value_in_USD"), ''), "Value CIF $") END AS value
FROM raw_export''', value="Value")
_DERIVED = f'''
SELECT "BE_NO" AS id, CASE WHEN {_num('"Total_Ass_Value"')} IS NULL THEN
         round({_num('"Quantity"')} * {_num('"Unit_Price"')}, 3) ELSE {_num('"Total_Ass_Value"')} END AS value
FROM raw_import'''


def _as_number(name: str, column: str):
    def change(df: DataFrame) -> DataFrame:
        return df.withColumn(name, _number(column))
    return change


def _number(column: str) -> Column:
    return F.replace(col(column), F.lit(","), F.lit("")).try_cast("double")


_rule("map_derive_value", "raw_import",
      lambda df: _as_number("Value", "Value")(m.derive_value(df)), _DERIVED, value="Value")
_rule("join_row_aligned", "raw_import",
      lambda df: _as_number("Value", "Value")(m.derive_value(m.prefer_cif(m.prefer_usd_total(df)))),
      _DERIVED, value="Value")
_rule("map_unit_price_fc", "raw_import", m.unit_price_from_invoice, '''
SELECT "BE_NO" AS id, CASE WHEN upper("INVOICE_CURRENCY") = 'USD' THEN "Invoice_Unit_Price_FC" END
  AS unit_price FROM raw_import''', unit_price="Unit Price USD")
_rule("map_unit_price_ratio", "raw_export",
      lambda df: _as_number("Unit Price USD", "Unit Price USD")(
          m.unit_price_from_value(m.prefer_usd_total(df))), f'''
WITH r AS (SELECT "SB No" AS id, file_name, {_num('"Qty"')} AS q,
             {_num("""coalesce(nullif(trim("Total_Value_in_USD"), ''), "Value CIF $")""")} AS val
           FROM raw_export)
SELECT id, CASE WHEN file_name LIKE 'Australia%' AND q > 0 THEN round(val / q, 4) END AS unit_price
FROM r''', unit_price="Unit Price USD")


def _ported(v: Views, name: str) -> DataFrame:
    return m.destination_from_port(_projected(v, name), v["ports"])


add("map_port_country", lambda v: _pick(_ported(v, "raw_export"), destination="Destination Country"), '''
SELECT "SB No" AS id, coalesce("Foreign Country", ports.country) AS destination
FROM raw_export LEFT JOIN ports ON lower(trim("Port of Destination")) = lower(port)''')
add("join_port_lookup", lambda v: (
    _ported(v, "raw_import").groupBy(F.col("Destination Country").alias("destination"))
    .agg(F.count("*").alias("rows"))), '''
SELECT coalesce("Importing Country", ports.country) AS destination, count(*) AS rows
FROM raw_import LEFT JOIN ports ON lower(trim("Port of Destination")) = lower(port) GROUP BY 1''')
_rule("map_port_override", "raw_import", m.import_port, '''
SELECT "BE_NO" AS id, coalesce(nullif(trim("Port of Destination"), ''), "Port of Shipment") AS port
FROM raw_import''', port="Port")
add("map_stamp_usd", lambda v: _pick(
    m.stamp_usd(_projected(v, "raw_export"), _headers(v["raw_export"])), currency="Currency"),
    'SELECT "SB No" AS id, \'USD\' AS currency FROM raw_export')

_PARTIES = dict(importer="Importer", exporter="Exporter", supplier="Supplier", buyer="Buyer",
                origin="Origin Country", destination="Destination Country", country="Country")


def _foreign(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' AND upper(trim({c})) <> home THEN trim({c}) END"


_HOME = '''CASE WHEN file_name LIKE 'Turkey%' THEN 'TURKEY' WHEN file_name LIKE 'colombia%' THEN 'COLOMBIA'
  WHEN file_name LIKE 'Peru%' THEN 'PERU' WHEN file_name LIKE 'Australia%' THEN 'AUSTRALIA' ELSE 'INDIA' END'''
_IMPORT_SIDES = f'''
SELECT "BE_NO" AS id, coalesce(nullif(trim("ImporterName"), ''), nullif(trim("Consignee Name"), '')) AS importer,
  NULL::VARCHAR AS exporter,
  coalesce(nullif(trim("SupplierName"), ''), nullif(trim("Shipper Name"), '')) AS supplier,
  NULL::VARCHAR AS buyer, coalesce({_foreign('"Country_of_Origin"')}, {_foreign('"Country"')},
    {_foreign('"Importing Country"')}) AS origin,
  home AS destination, origin AS country
FROM (SELECT *, {_HOME} AS home FROM raw_import)'''
_EXPORT_SIDES = f'''
SELECT "SB No" AS id, NULL::VARCHAR AS importer, "Exporter Name" AS exporter, NULL::VARCHAR AS supplier,
  coalesce(nullif(trim("Consignee Name"), ''), nullif(trim("Importer"), '')) AS buyer,
  home AS origin, coalesce({_foreign('"Foreign Country"')}, {_foreign('"Country"')}) AS destination,
  destination AS country
FROM (SELECT *, {_HOME} AS home FROM raw_export)'''


@query("map_consolidate", f"{_IMPORT_SIDES} UNION ALL {_EXPORT_SIDES}")
def consolidate(v: Views) -> DataFrame:
    sides = [_pick(m.consolidate(_projected(v, n)), **_PARTIES) for n in ("raw_import", "raw_export")]
    return sides[0].unionByName(sides[1])


_PARTNER = f'''coalesce({_foreign('"Country_of_Origin"')}, {_foreign('r."Country"')},
    {_foreign('"Importing Country"')}, {_foreign("port_country")})'''
_VALUE = f'''CASE WHEN {_num('"Total_Ass_Value"')} IS NULL THEN round({_num('"Quantity"')} * {_num('"Unit_Price"')}, 3)
  ELSE {_num('"Total_Ass_Value"')} END'''
_ADDRESS = '''array_to_string(list_filter(["Importer_Add_01", "Importer_Add_02", "Importer_Add_03"],
  lambda x: x <> ''), ' | ')'''
_MAPPED = f'''
SELECT {_VALUE} AS "Value", CASE WHEN upper("INVOICE_CURRENCY") = 'USD' AND "Invoice_Unit_Price_FC" IS NOT NULL
    THEN {_num('"Invoice_Unit_Price_FC"')} WHEN home IN ('TURKEY', 'COLOMBIA') AND {_num('"Quantity"')} > 0
    THEN round(({_VALUE}) / {_num('"Quantity"')}, 4) END AS "Unit Price USD",
  {_ADDRESS} AS "Importer Address", NULL::VARCHAR AS "IEC", NULL::VARCHAR AS "CHA Name",
  NULL::VARCHAR AS "Exporter Address", NULL::VARCHAR AS "Supplier Address", NULL::VARCHAR AS "Buyer Address",
  NULL::VARCHAR AS "City", NULL::VARCHAR AS "State", "BE_Date" AS "Date", coalesce(nullif(trim("ImporterName"), ''), nullif(trim("Consignee Name"), ''))
    AS "Importer", NULL::VARCHAR AS "Exporter",
  coalesce(nullif(trim("SupplierName"), ''), nullif(trim("Shipper Name"), '')) AS "Supplier",
  NULL::VARCHAR AS "Buyer", "CTH_HSCODE" AS "HSN",
  {_PARTNER} AS "Country",
  coalesce(nullif(trim("Port of Destination"), ''), "Port of Shipment") AS "Port",
  "Quantity", "UQC" AS "Unit", "INVOICE_CURRENCY" AS "Currency", "Product_Descriptin" AS "Product Description",
  {_PARTNER} AS "Origin Country", home AS "Destination Country", 'IMPORT' AS "Trade Type",
  home AS "Reporting Country", CASE WHEN file_name LIKE '29%' THEN '29' WHEN file_name LIKE 'Turkey%'
    THEN '38' END AS "HS Chapter", "BE_NO" AS "BE/SB Number", "Mode of Shipment" AS "Mode",
  file_name AS "Source File"
FROM (SELECT *, {_HOME} AS home FROM raw_import) r
LEFT JOIN (SELECT lower(port) AS port_key, country AS port_country FROM ports) p
  ON lower(trim("Port of Destination")) = port_key'''


@query("map_canonical_select", _MAPPED)
def canonical(v: Views) -> DataFrame:
    raw = v["raw_import"]
    df = m.map_feed(raw, F.col("file_name"), ports=v["ports"], headers=_headers(raw))
    assert tuple(df.columns) == SHIPMENT_COLUMNS
    for name in ("Value", "Unit Price USD"):
        df = _as_number(name, name)(df)
    return df


# Sinks and the whole build.

_BY_FILE = '''SELECT "Reporting Country" AS reporting, "Source File" AS source_file, count(*) AS rows,
  round(sum("Value"), 2) AS value, min("Date") AS first FROM shipments GROUP BY 1, 2'''


def _by_file(df: DataFrame) -> DataFrame:
    return rounded(df.groupBy(F.col("Reporting Country").alias("reporting"),
                              F.col("Source File").alias("source_file"))
                   .agg(F.count("*").alias("rows"), F.sum("Value").alias("value"),
                        F.min("Date").alias("first")), "value")


@query("snk_shard_parquet", _BY_FILE)
def shard_parquet(v: Views) -> DataFrame:
    path = scratch(v.spark, "shards")
    writers.write_shards(v.shipments, path)
    return _by_file(writers.read_table(v.spark, path))


@query("snk_merged_parquet", '''SELECT "Reporting Country" AS reporting, "Source File" AS source_file,
  count(*) AS rows, round(sum("Value"), 2) AS value, min("Date") AS first
FROM (SELECT DISTINCT ON ("Date", "Importer", "Exporter", "Supplier", "Buyer", "HSN", "Quantity", "Value",
  "Product Description", "BE/SB Number") * FROM repeated ORDER BY "Source File") GROUP BY 1, 2''')
def merged_parquet(v: Views) -> DataFrame:
    path = scratch(v.spark, "merged")
    kept = writers.staged(dedupe_across_files(v.stored_repeated()), scratch(v.spark, "kept"))
    writers.write_shards(kept, path)
    return _by_file(writers.read_table(v.spark, path))


@query("snk_sample_csv", f'''
SELECT CAST("Date" AS STRING) AS "Date", "BE/SB Number", "Importer", "HSN", "Product Description"
FROM (SELECT * FROM shipments {order_sql(SHIPMENT_COLUMNS, "Date")} LIMIT 1000)''')
def sample_csv(v: Views) -> DataFrame:
    path = scratch(v.spark, "sample")
    writers.write_sample(v.shipments, path)
    return feeds.read_csv(v.spark, [path]).select(
        "Date", "BE/SB Number", "Importer", "HSN", "Product Description")


@query("snk_split_direction", 'SELECT "Trade Type", count(*) AS rows FROM shipments GROUP BY 1')
def split_direction(v: Views) -> DataFrame:
    path = scratch(v.spark, "directions")
    writers.write_by_direction(v.shipments, path)
    return writers.direction_counts(v.spark.read.parquet(path))


@query("snk_replace_table", "SELECT type, count(*) AS rows FROM ledger GROUP BY 1")
def replace_table(v: Views) -> DataFrame:
    path = scratch(v.spark, "ledger")
    name = "cargolake_" + path.rsplit("-", 1)[-1]
    for df in (v["ledger"].filter("quantity > 10"), v["ledger"]):
        location = writers.replace_table(df, name, path)
    assert v.spark.table(name).columns == v["ledger"].columns
    v.spark.sql(f"DROP TABLE {name}")  # external: its files stay
    return v.spark.read.parquet(location).groupBy("type").agg(F.count("*").alias("rows"))


@query("snk_run_summary", '''
SELECT "Source File" AS file, true AS success, count(*) AS rows_in,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM repeated) d WHERE d."Source File" = r."Source File")
    AS rows_out, NULL::VARCHAR AS error
FROM repeated r GROUP BY 1''')
def run_summary(v: Views) -> DataFrame:
    raw = v.stored_repeated()
    counts = raw.groupBy(F.col("Source File").alias("file")).agg(F.count("*").alias("rows_in"))
    return writers.run_summary(counts, clean(raw.select(
        *(col(c).cast("string").alias(c) for c in raw.columns))))


def write_named(raw: DataFrame, target: str, work: str) -> None:
    """Packed CSV files that bear the names in ``file_name``: written by folder, then moved.

    They are packed for speed, as each is read once. Large names come in several files, each in a folder of its own.
    """
    (raw.write.option("header", "true").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
     .option("zlib.compress.level", "BEST_SPEED").partitionBy("file_name").csv(work, compression="gzip"))
    spark = raw.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(work).getFileSystem(spark._jsc.hadoopConfiguration())
    written = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(work)
               .select("path").collect())
    for i, row in enumerate(written):
        name = row["path"].split("/")[-2].removeprefix("file_name=")
        system.mkdirs(path(f"{target}/{i}"))
        system.rename(path(row["path"]), path(f"{target}/{i}/{name}{feeds.PACKED}"))


@query("build_shipments", '''
WITH e AS (SELECT file_name, count(*) AS n FROM (SELECT DISTINCT * FROM raw_export) GROUP BY 1
           UNION ALL SELECT file_name, count(*) FROM (SELECT DISTINCT * FROM raw_import) GROUP BY 1),
r AS (SELECT file_name FROM raw_export UNION ALL SELECT file_name FROM raw_import)
SELECT r.file_name AS file, true AS success, count(*) AS rows_in, max(n) AS rows_out, NULL::VARCHAR AS error
FROM r JOIN e ON r.file_name = e.file_name GROUP BY 1''')
def build(v: Views) -> DataFrame:
    return build_shipments(v.spark, *_feeds(v), ports=v["ports"])


def _feeds(v: Views) -> tuple[str, str]:
    source, target = scratch(v.spark, "feeds"), scratch(v.spark, "built")
    for name in ("raw_import", "raw_export"):
        write_named(v[name], f"{source}/{name}", scratch(v.spark, "unnamed"))
    return source, target


_BUILT = ("Importer", "Exporter", "Supplier", "Buyer", "HSN", "Port", "Unit", "Currency", "Product Description",
          "Trade Type", "Reporting Country", "BE/SB Number", "Mode", "Importer Address", "Source File")


def _up(c: str) -> str:
    return f"upper(nullif(trim({c}), ''))"


@query("build_table", f'''
WITH i AS (SELECT DISTINCT * FROM raw_import)
SELECT coalesce(nullif(trim("ImporterName"), ''), nullif(trim("Consignee Name"), '')) AS "Importer",
  NULL::VARCHAR AS "Exporter", coalesce(nullif(trim("SupplierName"), ''), nullif(trim("Shipper Name"), '')) AS "Supplier",
  NULL::VARCHAR AS "Buyer", substr(regexp_replace("CTH_HSCODE", '[^0-9]', '', 'g'), 1, 8) AS "HSN",
  coalesce(nullif(trim("Port of Destination"), ''), "Port of Shipment") AS "Port", {_up('"UQC"')} AS "Unit",
  {_up('"INVOICE_CURRENCY"')} AS "Currency", trim("Product_Descriptin") AS "Product Description",
  'IMPORT' AS "Trade Type", {_HOME} AS "Reporting Country", "BE_NO" AS "BE/SB Number", {_up('"Mode of Shipment"')} AS "Mode",
  {_ADDRESS} AS "Importer Address", file_name AS "Source File" FROM i''')
def built_table(v: Views) -> DataFrame:
    """The import rows of the stored table, text columns."""
    source, target = _feeds(v)
    build_shipments(v.spark, source, target, ports=v["ports"])
    table = writers.read_table(v.spark, f"{target}/shipments")
    return table.filter(F.col("Trade Type") == "IMPORT").select(*map(col, _BUILT))
