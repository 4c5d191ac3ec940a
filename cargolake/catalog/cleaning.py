"""Cleaning, derived columns and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fold_accents, folded_key
from ..operators import cleaning as c
from ..schema import DEDUPE_KEY, SEARCH_COLUMNS, SHIPMENT_COLUMNS, col
from .registry import query
from .views import Views

_NULLS = "('', 'n/a', 'na', 'null', 'none', '-', 'nil')"
_COUNTRY_NULLS = "('', 'n/a', 'na', 'null', 'none', '-')"


def _dirty(v: Views) -> DataFrame:
    return v["dirty"]


@query("cln_trim_nullify", f'''
SELECT id, CASE WHEN lower(trim("Importer")) NOT IN {_NULLS} THEN trim("Importer") END AS importer,
       CASE WHEN lower(trim("Country")) NOT IN {_NULLS} THEN trim("Country") END AS country
FROM dirty''')
def trim_nullify(v: Views) -> DataFrame:
    df = c.trim_and_nullify(_dirty(v))
    return df.select("id", F.col("Importer").alias("importer"), F.col("Country").alias("country"))


@query("cln_hsn", '''
SELECT id, nullif(substr(regexp_replace("HSN", '[^0-9]', '', 'g'), 1, 8), '') AS hsn FROM dirty''')
def hsn(v: Views) -> DataFrame:
    return c.normalise_hsn(_dirty(v)).select("id", F.col("HSN").alias("hsn"))


@query("cln_chapter_from_hsn", '''
WITH d AS (SELECT id, "HS Chapter" AS ch,
                  substr(regexp_replace("HSN", '[^0-9]', '', 'g'), 1, 8) AS code FROM dirty)
SELECT id, coalesce(ch, CASE WHEN length(code) >= 2 THEN substr(code, 1, 2) END) AS chapter
FROM d''')
def chapter(v: Views) -> DataFrame:
    df = c.fill_chapter(c.normalise_hsn(_dirty(v)))
    return df.select("id", F.col("HS Chapter").alias("chapter"))


_COUNTRY_SQL = f'''
WITH d AS (SELECT id, CASE WHEN lower(trim("Country")) NOT IN {_COUNTRY_NULLS}
                           THEN upper(trim("Country")) END AS name FROM dirty)
SELECT id, CASE name WHEN 'USA' THEN 'UNITED STATES' WHEN 'U.K.' THEN 'UNITED KINGDOM'
           WHEN 'KOREA, REPUBLIC OF' THEN 'SOUTH KOREA' ELSE name END AS country FROM d'''


@query("cln_country", _COUNTRY_SQL)
def country(v: Views) -> DataFrame:
    return c.normalise_countries(_dirty(v)).select("id", F.col("Country").alias("country"))


@query("join_alias_lookup", f'''
WITH d AS (SELECT CASE WHEN lower(trim("Country")) NOT IN {_COUNTRY_NULLS}
                       THEN upper(trim("Country")) END AS name FROM dirty),
aliases(alias, target) AS (VALUES ('USA', 'UNITED STATES'), ('U.K.', 'UNITED KINGDOM'),
  ('KOREA, REPUBLIC OF', 'SOUTH KOREA'))
SELECT coalesce(target, name) AS country, count(*) AS rows
FROM d LEFT JOIN aliases ON name = alias GROUP BY 1''')
def alias_lookup(v: Views) -> DataFrame:
    return (c.normalise_countries(_dirty(v)).groupBy(F.col("Country").alias("country"))
            .agg(F.count("*").alias("rows")))


@query("cln_upper", '''
SELECT id, upper("Trade Type") AS trade_type, upper("Currency") AS currency,
       upper("Unit") AS unit, upper("Mode") AS mode FROM dirty''')
def upper(v: Views) -> DataFrame:
    return c.upper_codes(_dirty(v)).select(
        "id", F.col("Trade Type").alias("trade_type"), F.col("Currency").alias("currency"),
        F.col("Unit").alias("unit"), F.col("Mode").alias("mode"))


_DATE_SQL = '''CASE
    WHEN regexp_full_match("Date", '[0-9]{6}') THEN TRY_CAST(substr("Date", 1, 4) || '-' || substr("Date", 5, 2) || '-01' AS DATE)
    WHEN regexp_matches("Date", '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(substr("Date", 1, 10) AS DATE)
    WHEN regexp_matches("Date", '^[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}')
      THEN TRY_CAST(substr("Date", 7, 4) || '-' || substr("Date", 4, 2) || '-' || substr("Date", 1, 2) AS DATE)
  END'''


@query("cln_date", f'SELECT id, {_DATE_SQL} AS date FROM dirty')
def date(v: Views) -> DataFrame:
    return c.parse_dates(_dirty(v)).select("id", F.col("Date").alias("date"))


@query("cln_numeric", '''
SELECT id, TRY_CAST(replace("Quantity", ',', '') AS DOUBLE) AS quantity,
       TRY_CAST(replace("Value", ',', '') AS DOUBLE) AS value FROM dirty''')
def numeric(v: Views) -> DataFrame:
    return c.parse_numbers(_dirty(v)).select(
        "id", F.col("Quantity").alias("quantity"), F.col("Value").alias("value"))


@query("cln_drop_empty", '''
SELECT "HS Chapter" AS chapter, "Trade Type" AS trade_type, count(*) AS rows,
       count("Value") AS with_value
FROM shipments WHERE "Value" IS NOT NULL OR "Date" IS NOT NULL GROUP BY 1, 2''')
def drop_empty(v: Views) -> DataFrame:
    df = v.shipments.select("Value", "Date", "HS Chapter", "Trade Type", "Source File")
    return (c.drop_empty(df).groupBy(F.col("HS Chapter").alias("chapter"),
                                     F.col("Trade Type").alias("trade_type"))
            .agg(F.count("*").alias("rows"), F.count("Value").alias("with_value")))


@query("cln_dedupe_file", '''
SELECT "Source File" AS source_file, count(*) AS rows, sum("Quantity") AS quantity
FROM (SELECT DISTINCT * FROM repeated) GROUP BY 1''')
def dedupe_file(v: Views) -> DataFrame:
    return (c.drop_repeats(v["repeated"]).groupBy(F.col("Source File").alias("source_file"))
            .agg(F.count("*").alias("rows"), F.sum("Quantity").alias("quantity")))


_KEY = ", ".join(f'"{k}"' for k in DEDUPE_KEY)
_REST = ", ".join(f'"{k}" NULLS LAST' for k in SHIPMENT_COLUMNS
                  if k not in DEDUPE_KEY and k != "Source File")


@query("win_cross_file_dedupe", f'''
WITH r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}
             ORDER BY "Source File" NULLS LAST, {_REST}) AS rn FROM repeated)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1''')
def cross_file(v: Views) -> DataFrame:
    return c.dedupe_across_files(v["repeated"])


@query("drv_search", '''
SELECT "BE/SB Number" AS id, lower(concat_ws(' | ', "Importer", "Exporter", "Supplier", "Buyer",
       "Product Description", "HSN")) AS search FROM shipments''')
def search_column(v: Views) -> DataFrame:
    return c.add_search_columns(v.shipments).select(
        F.col("BE/SB Number").alias("id"), F.col("_search").alias("search"))


@query("drv_pd_search", '''
SELECT doc_id, nullif(regexp_replace(lower("Product Description"), '[^a-z0-9]', '', 'g'), '')
       AS pd_search FROM texts''')
def product_key(v: Views) -> DataFrame:
    named = v["texts"].withColumns({n: F.lit(None).cast("string") for n in SEARCH_COLUMNS
                                    if n != "Product Description"})
    return c.add_search_columns(named).select("doc_id", F.col("_pd_search").alias("pd_search"))


_FOLD = '"Product Description"'
for _char, _plain in (("㎏", "kg"), ("⑩", "10"), ("㎎", "mg"), ("ℓ", "l"), ("Ⅷ", "VIII"), ("𝐀", "A")):
    _FOLD = f"replace({_FOLD}, '{_char}', '{_plain}')"
_FOLD = f"regexp_replace(strip_accents({_FOLD}), '[^\\x00-\\x7F]', '', 'g')"


@query("drv_normq", f'''
SELECT doc_id, regexp_replace(lower({_FOLD}), '[^a-z0-9]', '', 'g') AS key FROM texts''')
def term_key(v: Views) -> DataFrame:
    return v["texts"].select("doc_id", folded_key(F.col("Product Description")).alias("key"))


@query("txt_accent_fold", f"SELECT doc_id, {_FOLD} AS folded FROM texts")
def accent_fold(v: Views) -> DataFrame:
    return v["texts"].select("doc_id", fold_accents(F.col("Product Description")).alias("folded"))


_COVERED = '''substr("HSN", 1, 2) IN ('29', '38') AND CAST("Date" AS STRING) >= '1999-06-01' '''


@query("flt_exclude_overlap", f'''
SELECT "BE/SB Number" AS id, "HSN" AS hsn, "Date" AS date, "Quantity" AS quantity
FROM shipments WHERE NOT ({_COVERED})''')
def overlap_kept(v: Views) -> DataFrame:
    kept, _ = c.exclude_overlap(v.shipments, cutoff="1999-06-01")
    return kept.select(F.col("BE/SB Number").alias("id"), F.col("HSN").alias("hsn"),
                       F.col("Date").alias("date"), F.col("Quantity").alias("quantity"))


@query("agg_overlap_audit", f'''
SELECT substr("HSN", 1, 2) AS chapter, count(*) AS excluded
FROM shipments WHERE {_COVERED} GROUP BY 1''')
def overlap_audit(v: Views) -> DataFrame:
    return c.exclude_overlap(v.shipments, cutoff="1999-06-01")[1]


@query("set_distinct", '''
SELECT DISTINCT "Origin Country" AS origin, "Port" AS port FROM shipments''')
def distinct(v: Views) -> DataFrame:
    return v.shipments.select(col("Origin Country").alias("origin"),
                              col("Port").alias("port")).distinct()
