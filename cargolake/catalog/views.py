"""Fixture views over the sample tables, in SQL that Spark and the oracle both read.

The text is shared so that both sides start from the same rows; it uses double quotes for
column names, which become backticks for Spark. ``{name}`` stands for a table or for
another view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch
from ..sources.writers import staged

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _day_first(d: str, mark: str) -> str:
    return f"substr({d}, 9, 2) || '{mark}' || substr({d}, 6, 2) || '{mark}' || substr({d}, 1, 4)"


_DATE = 'CAST("Date" AS STRING)'

VIEWS = {
    # The canonical table.
    "shipments": '''
WITH j AS (
  SELECT l.*, o.o_orderdate, o.o_orderpriority, c.c_name, c.c_mktsegment, s.s_name,
         p.p_name, p.p_type, p.p_brand, p.p_size, cn.n_name AS c_nation, sn.n_name AS s_nation,
         CASE WHEN l.l_linestatus = 'O' THEN 'IMPORT' ELSE 'EXPORT' END AS dir,
         CASE WHEN p.p_type IN ('ECONOMY','PROMO','LARGE') THEN '29' ELSE '38' END AS ch
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey
  JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey)
SELECT
  CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS "Date",
  CASE WHEN dir = 'IMPORT' THEN c_name END AS "Importer",
  CASE WHEN dir = 'EXPORT' THEN s_name END AS "Exporter",
  CASE WHEN dir = 'IMPORT' THEN s_name END AS "Supplier",
  CASE WHEN dir = 'EXPORT' THEN c_name END AS "Buyer",
  CASE WHEN p_size > 1 THEN ch || lpad(CAST(l_partkey % 1000000 AS STRING), 6, '0') END AS "HSN",
  CASE WHEN dir = 'IMPORT' THEN s_nation ELSE c_nation END AS "Country",
  'PORT ' || o_orderpriority AS "Port",
  l_quantity AS "Quantity",
  'KGS' AS "Unit",
  CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS "Value",
  CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS "Unit Price USD",
  'USD' AS "Currency",
  p_type || ' ' || p_name || ' ' || p_brand AS "Product Description",
  s_nation AS "Origin Country",
  c_nation AS "Destination Country",
  dir AS "Trade Type",
  CASE WHEN dir = 'IMPORT' THEN c_nation ELSE s_nation END AS "Reporting Country",
  ch AS "HS Chapter",
  CAST(NULL AS STRING) AS "IEC",
  CAST(l_orderkey AS STRING) AS "BE/SB Number",
  CAST(NULL AS STRING) AS "CHA Name",
  CAST(NULL AS STRING) AS "Importer Address",
  CAST(NULL AS STRING) AS "Exporter Address",
  CAST(NULL AS STRING) AS "Supplier Address",
  CAST(NULL AS STRING) AS "Buyer Address",
  c_mktsegment AS "City",
  CAST(NULL AS STRING) AS "State",
  CASE WHEN l_returnflag = 'R' THEN 'AIR' WHEN l_returnflag = 'A' THEN 'SEA' END AS "Mode",
  dir || '_' || CAST(year(o_orderdate) AS STRING) || '.parquet' AS "Source File"
FROM j''',

    # One year again under another file name, and some rows with other details: repeats for
    # the de-duplication across files.
    "repeated": '''
SELECT * FROM {shipments}
UNION ALL
SELECT "Date", "Importer", "Exporter", "Supplier", "Buyer", "HSN", "Country",
       'PORT AGAIN' AS "Port", "Quantity", "Unit", "Value", "Unit Price USD", "Currency",
       "Product Description", "Origin Country", "Destination Country", "Trade Type",
       "Reporting Country", "HS Chapter", "IEC", "BE/SB Number", "CHA Name",
       "Importer Address", "Exporter Address", "Supplier Address", "Buyer Address", "City",
       "State", "Mode", 'A_' || "Source File" AS "Source File"
FROM {shipments} WHERE "Source File" LIKE '%1997%'
UNION ALL
SELECT * FROM {shipments} WHERE "Source File" LIKE '%1996%' AND "HS Chapter" = '38'
''',

    # Canonical text rows with the usual dirt.
    "dirty": f'''
SELECT "BE/SB Number" AS id,
  CASE k WHEN 0 THEN '  ' || name || ' ' WHEN 1 THEN 'N/A' WHEN 2 THEN ' nil ' WHEN 3 THEN '-'
         WHEN 4 THEN '' ELSE lower(name) END AS "Importer",
  CASE k WHEN 0 THEN 'usa' WHEN 1 THEN ' U.K. ' WHEN 2 THEN 'None' WHEN 3 THEN 'nil'
         WHEN 4 THEN 'Korea, Republic of' ELSE lower("Country") END AS "Country",
  CASE k WHEN 0 THEN {_DATE} WHEN 1 THEN {_DATE} || ' 12:30:00'
         WHEN 2 THEN {_day_first(_DATE, '-')} WHEN 3 THEN {_day_first(_DATE, '/')} || ' 08:15'
         WHEN 4 THEN substr({_DATE}, 1, 4) || substr({_DATE}, 6, 2) ELSE '31-02-2020' END AS "Date",
  CASE k WHEN 0 THEN '12,' || lpad(CAST(CAST("Quantity" AS BIGINT) AS STRING), 3, '0')
         WHEN 1 THEN 'abc' WHEN 2 THEN '' ELSE CAST("Quantity" AS STRING) END AS "Quantity",
  CASE WHEN k = 3 THEN NULL ELSE CAST("Value" AS STRING) END AS "Value",
  CASE k WHEN 0 THEN substr("HSN", 1, 4) || '.' || substr("HSN", 5, 4) || '.0000'
         WHEN 1 THEN 'none' WHEN 2 THEN substr("HSN", 1, 2) ELSE "HSN" || '00' END AS "HSN",
  CASE WHEN k IN (0, 3) THEN NULL ELSE "HS Chapter" END AS "HS Chapter",
  lower("Trade Type") AS "Trade Type", lower("Currency") AS "Currency",
  lower("Unit") AS "Unit", lower("Mode") AS "Mode", "Source File"
FROM (SELECT *, coalesce("Importer", "Buyer") AS name,
             CAST("BE/SB Number" AS BIGINT) % 6 AS k FROM {{shipments}}) b''',

    # Import feed with the headers of one customs service.
    "raw_import": f'''
SELECT
  CASE k WHEN 0 THEN {_DATE} WHEN 1 THEN {_DATE} || ' 00:00:00'
         WHEN 2 THEN {_day_first(_DATE, '-')} ELSE {_day_first(_DATE, '/')} END AS "BE_Date",
  "BE/SB Number" AS "BE_NO",
  "HSN" || '.00' AS "CTH_HSCODE",
  CASE k WHEN 1 THEN ' ' WHEN 2 THEN ' ' || "Importer" || ' ' ELSE "Importer" END AS "ImporterName",
  CASE k WHEN 1 THEN "Importer" END AS "Consignee Name",
  CASE k WHEN 4 THEN NULL ELSE "Supplier" END AS "SupplierName",
  CASE k WHEN 4 THEN "Supplier" END AS "Shipper Name",
  CASE k WHEN 3 THEN 'india' WHEN 5 THEN ' Turkey ' ELSE "Origin Country" END AS "Country_of_Origin",
  CASE k WHEN 3 THEN "Origin Country" WHEN 5 THEN ' ' END AS "Country",
  CASE k WHEN 5 THEN "Destination Country" END AS "Importing Country",
  CASE k WHEN 4 THEN ' ' ELSE '  ' || lower("Port") END AS "Port of Destination",
  "Port" AS "Port of Shipment",
  CASE k WHEN 5 THEN CAST(CAST("Quantity" AS BIGINT) AS STRING) || ',000'
         WHEN 4 THEN 'x' ELSE CAST("Quantity" AS STRING) END AS "Quantity",
  lower("Unit") AS "UQC",
  CASE k WHEN 0 THEN CAST("Value" AS STRING) WHEN 1 THEN 'abc' END AS "Total_Ass_Value",
  CAST(CAST(floor("Value" / "Quantity") AS BIGINT) AS STRING)
    || CASE k WHEN 3 THEN '.251731' ELSE '.25' END AS "Unit_Price",
  CASE WHEN k > 1 THEN CAST(CAST(floor("Value" / "Quantity") AS BIGINT) AS STRING) || '.5' END
    AS "Invoice_Unit_Price_FC",
  CASE WHEN k IN (0, 1, 2) THEN 'usd' WHEN k = 3 THEN NULL ELSE 'EUR' END AS "INVOICE_CURRENCY",
  "Product Description" AS "Product_Descriptin",
  '12 Main Road' AS "Importer_Add_01",
  CASE WHEN k IN (0, 2) THEN NULL WHEN k = 1 THEN '' ELSE "City" END AS "Importer_Add_02",
  CASE WHEN k IN (0, 3) THEN NULL ELSE 'Block ' || CAST(k AS STRING) END AS "Importer_Add_03",
  substr({_DATE}, 1, 4) AS "Period",
  'note' AS "Zq Xv Remark",
  "Mode" AS "Mode of Shipment",
  CASE k % 3 WHEN 0 THEN '29 ALL PORTS IMPORT ' || substr("Source File", 8, 4) || '.csv'
             WHEN 1 THEN 'Turkey Import Chapter 38 and 29 v' || substr("Source File", 8, 4) || '.csv'
             ELSE 'colombia_import_' || substr("Source File", 8, 4) || '.csv' END AS file_name
FROM (SELECT *, CAST("BE/SB Number" AS BIGINT) % 6 AS k FROM {{shipments}}
      WHERE "Trade Type" = 'IMPORT') b''',

    # Export feed of another service: local and USD values side by side, own chapter column.
    "raw_export": f'''
SELECT
  {_DATE} AS "SB Dt", "BE/SB Number" AS "SB No", "HSN" AS "HS Code",
  CASE k WHEN 2 THEN NULL ELSE "HS Chapter" END AS "Chapter",
  "Exporter" AS "Exporter Name",
  CASE k WHEN 1 THEN NULL ELSE "Buyer" END AS "Consignee Name",
  CASE k WHEN 1 THEN "Buyer" END AS "Importer",
  CASE k WHEN 0 THEN NULL WHEN 1 THEN 'Peru' ELSE "Destination Country" END AS "Foreign Country",
  CASE k WHEN 1 THEN "Country" END AS "Country",
  CASE k WHEN 2 THEN 'unknown port' ELSE "Port" END AS "Port of Destination",
  'Indian ' || "Port" AS "Indian Port",
  CASE k WHEN 0 THEN '8' WHEN 1 THEN '5' WHEN 2 THEN '0' WHEN 3 THEN '7' ELSE '16' END AS "Qty",
  "Unit" AS "Unit",
  CAST(CAST(floor("Value") AS BIGINT) AS STRING) AS "Invoice Value",
  CASE k WHEN 0 THEN ' ' WHEN 1 THEN NULL
         ELSE CAST(CAST(floor("Value") + 1 AS BIGINT) AS STRING) END AS "Total_Value_in_USD",
  CASE k WHEN 3 THEN ' 1,' || lpad(CAST(CAST("Quantity" AS BIGINT) AS STRING), 3, '0') || ' '
         WHEN 4 THEN '0' WHEN 5 THEN 'abc' END AS "Value CIF $",
  "Product Description" AS "Goods Description",
  'EUR' AS "Currency",
  "City" AS "Consignee Address", CASE k WHEN 2 THEN NULL ELSE 'Dock 4' END AS "Consignee Add 01",
  CASE k % 3 WHEN 0 THEN '3808 ALL EXPORT TO WORLD APR 25.csv'
             WHEN 1 THEN 'Peru Export.csv' ELSE 'Australia export 29 ' || "HS Chapter" || '.csv' END
    AS file_name
FROM (SELECT *, CAST("BE/SB Number" AS BIGINT) % 6 AS k FROM {{shipments}}
      WHERE "Trade Type" = 'EXPORT') b''',

    # Ports of the data and the country each lies in; one port is left out.
    "ports": '''
SELECT 'Port ' || o_orderpriority AS port, 'NATION_' || substr(o_orderpriority, 1, 1) AS country
FROM {orders} WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2''',

    # Product texts in several languages.
    "texts": '''
SELECT doc_id, text AS "Product Description" FROM {documents}
UNION ALL SELECT -1, '5 ㎏ ⑩ ㎎/ℓ Ⅷ 𝐀bc' FROM {region}''',

    # Import ledger with its own columns.
    "ledger": '''
SELECT
  CASE WHEN l_tax = 0.08 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
  CAST(month(l_shipdate) AS DOUBLE) AS month, CAST(year(l_shipdate) AS DOUBLE) AS year,
  CASE WHEN l_discount = 0.1 THEN NULL ELSE c_name END AS importer,
  'UNIFIED ' || c_name AS importer_unified,
  CASE WHEN l_discount = 0.09 THEN NULL ELSE sn.n_name END AS origin_country,
  CASE l_returnflag WHEN 'R' THEN 'TECNICO' WHEN 'A' THEN 'FORMULADO' END AS type,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'sal de ' || p_name END AS active_ingredient,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS active_ingredient_en,
  p_brand AS brand, p_type AS formulation, c_mktsegment AS segment,
  'BOX ' || CAST(p_size AS STRING) AS presentation,
  l_quantity AS quantity, 'KG' AS unit, l_extendedprice / l_quantity AS fob_unit_usd,
  l_extendedprice AS fob_total_usd,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * (1 + l_tax) / l_quantity END AS cif_unit_usd,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * (1 + l_tax) END AS cif_total_usd,
  o_orderpriority AS transport,
  'ARGENTINA' AS destination_country, 'IMPORT' AS trade_type, 'ledger.csv' AS source_file
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey''',

    # The ledger as a feed: Spanish headers, text cells, an empty and an unknown column.
    "raw_ledger": '''
SELECT CAST(date AS STRING) || ' 00:00:00' AS "Date",
  CAST(CAST(year AS BIGINT) AS STRING) AS "Year",
  importer AS "Importer", origin_country AS "Country of Origin", type AS "Type",
  active_ingredient AS "Active Ingredients", brand AS "Marca Comercial",
  formulation AS "Formulación",
  CASE WHEN quantity > 40 THEN 'n.d.' ELSE CAST(quantity AS STRING) END AS "Cantidad",
  CAST(fob_total_usd AS STRING) AS "FOB Total (USD)", CAST(NULL AS STRING) AS "Quarter",
  'zz' AS "Observaciones", transport AS "Transporte"
FROM {ledger}''',

    # Market values by product, type, country and crop, in millions.
    "market": '''
SELECT p_brand AS product, p_type AS type,
  CASE WHEN n_name = 'NATION_3' THEN NULL ELSE n_name END AS country,
''' + ",\n".join(
        "  CAST(sum(CASE WHEN p_size % 15 = {i} THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END)"
        " AS DOUBLE) / 1000000 AS {c}".replace("{i}", str(i)).replace("{c}", c)
        for i, c in enumerate(("cereals", "cotton", "maize", "oilseed_rape", "other_crops",
                               "other_fv", "pome_stone_fruit", "potato", "rice", "soybean",
                               "sugar_beet", "sugarcane", "sunflower", "vine"))) + ''',
  CAST(sum(CASE WHEN p_size % 15 < 14 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS DOUBLE)
    / 1000000 AS total_usd_m,
  'market.csv' AS source_file
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
GROUP BY p_brand, p_type, n_name''',

    # Two countries' registries with their own headers.
    "registered": '''
SELECT DISTINCT l_partkey AS id, s_nationkey AS nation, p_name, p_brand, p_type, p_size
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey''',

    "raw_turkey": '''
SELECT 'TR-' || CAST(id AS STRING) || '-' || CAST(nation AS STRING) AS "License No",
  ' ' || p_name || CASE p_size % 9 WHEN 1 THEN ' TC' ELSE '' END || ' ' AS "Plant Protection Product",
  CASE p_size % 12 WHEN 0 THEN 'GLIFOSATO 48%' WHEN 1 THEN 'Imidacloprid + Abamectina'
    WHEN 2 THEN 'IMAZAPIC 52,5%, IMAZAPIR 17,5%' WHEN 3 THEN 'Clorpirifós (480 EC) 480 g/L'
    WHEN 4 THEN '2,4-D Dimetil amina 720 g / l' WHEN 5 THEN 'Tebukonazol setara dengan 95,5 %'
    WHEN 6 THEN 'azufre 800 g/kg' WHEN 7 THEN 'oxicloruro de cobre 950 g/kg'
    WHEN 8 THEN p_name WHEN 9 THEN '' WHEN 10 THEN 'Lambda-cialotrina; metalaxil-m' END
    AS "Active Ingredient",
  CASE p_size % 4 WHEN 0 THEN ' ' ELSE 'Firma ' || p_brand END AS "Licensed Company",
  CASE p_size % 3 WHEN 0 THEN 'active' END AS "License Status",
  CASE p_size % 8 WHEN 0 THEN 'EC' WHEN 1 THEN 'Wettable Powder' WHEN 2 THEN 'Concentrado emulsionable'
    WHEN 3 THEN 'ACTIVE CONSTITUENT' WHEN 4 THEN 'technical' WHEN 5 THEN 'teknik' END
    AS "Formulation",
  p_type || ' ' || chr(34) || 'ü' || chr(34) || ' ' || p_brand AS "Remark"
FROM {registered} WHERE nation < 13''',

    "raw_ecuador": '''
SELECT 'EC-' || CAST(id AS STRING) || '-' || CAST(nation AS STRING) AS "N° de Registro",
  p_name AS "Nombre Comercial",
  'Ingrediente activo  ' || CASE p_size % 4 WHEN 0 THEN 'MANCOZEB 80 %'
    WHEN 1 THEN 'cimoxanilo 8 %, Ingrediente Activo MANCOZEB 64 %'
    WHEN 2 THEN 'Aditivo de importancia toxicológica nafta' ELSE p_brand END || ' ,'
    AS "Composición de Producto",
  'Fábrica ' || p_brand AS "Fabricante / Formulador",
  CASE p_size % 2 WHEN 0 THEN 'VIGENTE' END AS "Estado",
  CASE p_size % 3 WHEN 0 THEN 'WP' WHEN 1 THEN 'Suspensión' END AS "Formulación"
FROM {registered} WHERE nation >= 13''',
}

_NAMED = re.compile(r"\{(\w+)\}")


def _plain(name: str) -> str:
    return _NAMED.sub(r"\1", VIEWS[name])


def _needs(name: str, found: dict[str, None]) -> None:
    for other in _NAMED.findall(VIEWS[name]):
        if other in VIEWS:
            _needs(other, found)
    found[name] = None


def with_views(sql: str) -> str:
    """Oracle text with the definitions of the views it reads in front."""
    needed: dict[str, None] = {}
    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, flags=re.IGNORECASE):
            _needs(name, needed)
    if not needed:
        return sql.strip()
    body = ",\n".join(f"{name} AS ({_plain(name)})" for name in needed)
    rest = sql.strip()
    if rest[:5].upper() == "WITH ":
        return f"WITH {body},\n{rest[5:]}"
    return f"WITH {body}\n{rest}"


#: Columns of the join that the shipments are selected from, in narrow pieces.
_LINES = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
          "l_returnflag", "l_linestatus", "l_shipdate")


class Views:
    """The sample tables and the views over them as frames of one session.

    Three views give Spark the rows of their SQL by a lighter plan; the SQL stays what the oracle reads.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in ("shipments", "repeated", "ledger"):
            return getattr(self, f"_{name}")()
        text = VIEWS[name].replace('"', "`")
        return self.spark.sql(text, **{n: self[n] for n in set(_NAMED.findall(text))})

    @cached_property
    def shipments(self) -> DataFrame:
        return self["shipments"]

    def _lines(self, nations: bool) -> DataFrame:
        """Lines with part, supplier, order and customer. The orders bring their customers along, so
        the lines meet them while they are narrow and are not shuffled for the customers."""
        nation = self["nation"]
        supplier = self["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", "s_name", F.col("n_name").alias("s_nation"))
        customer = self["customer"]
        if nations:
            customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self["orders"].join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "c_name", "c_mktsegment",
            *([F.col("n_name").alias("c_nation")] if nations else []))
        part = self["part"].select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
        return (self["lineitem"].select(*_LINES)
                .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")))

    def _shipments(self) -> DataFrame:
        lines = self._lines(nations=True).withColumns({
            "dir": F.when(F.col("l_linestatus") == "O", "IMPORT").otherwise("EXPORT"),
            "ch": F.when(F.col("p_type").isin("ECONOMY", "PROMO", "LARGE"), "29").otherwise("38")})
        selected = VIEWS["shipments"][VIEWS["shipments"].index("\nSELECT\n"):].replace("FROM j", "FROM {j}")
        return self.spark.sql(selected.replace('"', "`"), j=lines)

    def _ledger(self) -> DataFrame:
        selected = VIEWS["ledger"][:VIEWS["ledger"].index("FROM {lineitem}")].replace("sn.n_name", "s_nation")
        return self.spark.sql(selected.replace('"', "`") + "FROM {j}", j=self._lines(nations=False))

    def _repeated(self) -> DataFrame:
        return self._repeats(self.shipments)

    def _repeats(self, shipments: DataFrame) -> DataFrame:
        """Every shipment read once, and handed on as often as the three parts of the view hold it."""
        def within(year: str) -> Column:
            return F.col("Source File").contains(year)
        other = F.when(within("1997"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        again = F.when(within("1996") & (F.col("HS Chapter") == "38"), F.array(F.lit(False))).otherwise(
            F.array().cast("array<boolean>"))
        rows = shipments.select("*", F.explode(F.concat(other, again)).alias("_other"))
        return rows.withColumns({
            "Port": F.when(F.col("_other"), "PORT AGAIN").otherwise(F.col("Port")),
            "Source File": F.when(F.col("_other"), F.concat(F.lit("A_"), F.col("Source File"))).otherwise(
                F.col("Source File"))}).drop("_other")

    def stored_shipments(self) -> DataFrame:
        """The shipments written and read back, as the build hands them on: for operators that read
        their table several times, so that its joins run once."""
        return staged(self.shipments, scratch(self.spark, "shipments"))

    def stored_repeated(self) -> DataFrame:
        """The repeats over stored shipments: for operators that shuffle whole rows, which then do not
        add to the shuffle files of the joins."""
        return self._repeats(self.stored_shipments())
