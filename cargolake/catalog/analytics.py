"""Roll-ups, duplicate groups, keywords, names and the saved reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..operators import advanced, analytics as a, entities, name_index
from ..operators.filters import ShipmentFilter
from ..operators.mapping import counterparties
from ..operators.rollups import ERROR, Rollups
from ..plans import saved
from ..plans.build import write_rollups
from ..schema import DEDUPE_KEY, SHIPMENT_COLUMNS, col
from ..session import scratch
from ..sources.writers import write_stage
from .registry import add, query, rounded
from .views import Views

_KEY = ", ".join(f'"{k}"' for k in DEDUPE_KEY)
_VOLUME = '''count(*) AS shipments, round(sum("Value"), 2) AS total_value,
       round(sum("Quantity"), 2) AS total_quantity'''
_SUMS = ("total_value", "total_quantity")


@query("agg_count", '''SELECT count(*) AS total FROM shipments WHERE "Value" >= 30000''')
def count(v: Views) -> DataFrame:
    return a.count_rows(ShipmentFilter(min_value=30000).apply(v.shipments))


_TOTALS = '''SELECT count(*) AS count, round(sum("Quantity"), 2) AS total_quantity,
       round(sum("Value"), 2) AS total_value, round(avg("Unit Price USD"), 4) AS avg_unit_price_usd
FROM shipments WHERE '''


def _totals(v: Views, f: ShipmentFilter) -> DataFrame:
    df = rounded(a.totals(f.apply(v.shipments)), *_SUMS)
    return rounded(df, "avg_unit_price_usd", digits=4)


@query("agg_totals", _TOTALS + "\"Importer\" ILIKE '%0001%'")
def totals(v: Views) -> DataFrame:
    return _totals(v, ShipmentFilter(importer="0001"))


@query("agg_selection", _TOTALS + '''"HSN" ILIKE '3800010%' AND "Trade Type" = 'EXPORT' ''')
def selection(v: Views) -> DataFrame:
    return _totals(v, ShipmentFilter(hsn="3800010", trade_type="EXPORT"))


def _top(party: str) -> None:
    add(f"agg_top_{party.lower()}s", lambda v: rounded(a.top_parties(v.shipments, party), *_SUMS),
        f'''SELECT "{party}" AS name, {_VOLUME} FROM shipments WHERE "{party}" IS NOT NULL
GROUP BY 1 ORDER BY sum("Value") DESC NULLS LAST, name LIMIT 25''')


for _party in ("Importer", "Exporter", "Supplier", "Buyer"):
    _top(_party)


@query("agg_party_universe", '''
SELECT count(DISTINCT "Importer") AS total FROM shipments
WHERE "Importer" IS NOT NULL AND "HS Chapter" = '29' ''')
def universe(v: Views) -> DataFrame:
    return a.party_universe(ShipmentFilter(hs_chapter="29").apply(v.shipments), "Importer")


_MONTH = "CAST(date_trunc('month', \"Date\") AS DATE) AS month"

add("agg_monthly", lambda v: rounded(a.monthly(v.shipments), *_SUMS),
    f'SELECT {_MONTH}, {_VOLUME} FROM shipments WHERE "Date" IS NOT NULL GROUP BY 1')


def _monthly(name: str, key: str) -> None:
    add(f"agg_monthly_by_{name}",
        lambda v: rounded(a.monthly(v.shipments, [key, "Port"]), *_SUMS),
        f'''SELECT {_MONTH}, "{key}", {_VOLUME} FROM shipments WHERE "Date" IS NOT NULL
GROUP BY 1, 2''')


for _name, _key in (("trade_type", "Trade Type"), ("hs_chapter", "HS Chapter"),
                    ("origin", "Origin Country"), ("destination", "Destination Country")):
    _monthly(_name, _key)

_COUNTRY = '''SELECT coalesce("Origin Country", "Destination Country", "Country") AS country,
       "Trade Type" AS trade_type, {volume},
       count(DISTINCT "Importer") AS unique_importers, count(DISTINCT "Exporter") AS unique_exporters
FROM shipments GROUP BY 1, 2 ORDER BY sum("Value") DESC NULLS LAST, country, trade_type LIMIT 50'''


@query("agg_country", _COUNTRY.replace("{volume}", _VOLUME))
def country(v: Views) -> DataFrame:
    return rounded(a.by_country(v.shipments), *_SUMS)


@query("agg_country_counterparty", _COUNTRY.replace("{volume}", _VOLUME).replace(
    'coalesce("Origin Country", "Destination Country", "Country")', '"Country"'))
def counterparty_country(v: Views) -> DataFrame:
    return rounded(a.by_country(v.shipments, counterparty=True), *_SUMS)


@query("agg_heat_intensity", f'''
WITH c AS ({_COUNTRY.replace("{volume}", 'count(*) AS shipments, sum("Value") AS total_value')})
SELECT country, trade_type,
       round(least(1.0, pow(total_value / (SELECT max(total_value) FROM c), 0.7)), 6) AS intensity
FROM c''')
def heat(v: Views) -> DataFrame:
    df = a.heat(a.by_country(v.shipments)).select("country", "trade_type", "intensity")
    return rounded(df, "intensity", digits=6)


@query("agg_hsn", f'''
SELECT "HSN" AS hsn, max("HS Chapter") AS hs_chapter, max("Trade Type") AS trade_type, {_VOLUME},
       max(CASE WHEN "Importer" IS NOT NULL AND "Value" IS NOT NULL
           THEN {{'v': "Value", 'n': "Importer"}} END).n AS top_importer,
       max(CASE WHEN "Exporter" IS NOT NULL AND "Value" IS NOT NULL
           THEN {{'v': "Value", 'n': "Exporter"}} END).n AS top_exporter
FROM shipments WHERE "HSN" IS NOT NULL GROUP BY 1
ORDER BY sum("Value") DESC NULLS LAST, hsn LIMIT 50''')
def hsn(v: Views) -> DataFrame:
    return rounded(a.by_hsn(v.shipments), *_SUMS)


@query("agg_duplicates", f'''
WITH g AS (SELECT {_KEY}, count(*) AS occurrences FROM repeated GROUP BY {_KEY} HAVING count(*) >= 2
  ORDER BY occurrences DESC, {", ".join(f'"{k}" ASC NULLS LAST' for k in DEDUPE_KEY)} LIMIT 100)
SELECT DISTINCT {", ".join(f'g."{k}"' for k in DEDUPE_KEY)}, occurrences, r."Source File"
FROM g JOIN repeated r ON {" AND ".join(f'g."{k}" IS NOT DISTINCT FROM r."{k}"' for k in DEDUPE_KEY)}''')
def duplicates(v: Views) -> DataFrame:
    return advanced.duplicates(v["repeated"])


_SUPPLIERS = '''WITH s AS (SELECT "Supplier" AS supplier, count(*) AS shipments,
  sum("Value") AS total_value FROM shipments WHERE "Importer" ILIKE '%customer#00000001%' GROUP BY 1)
'''


def _shares_sql(whole: str) -> str:
    return _SUPPLIERS + f'''SELECT supplier, shipments, round(total_value, 2) AS total_value,
  round(CASE WHEN supplier IS NULL THEN 0 ELSE coalesce(total_value, 0) / ({whole}) * 100 END, 6)
    AS share_pct
FROM s ORDER BY coalesce(total_value, 0) DESC, supplier NULLS LAST LIMIT 10'''


def _shares(v: Views) -> DataFrame:
    df = rounded(advanced.supplier_shares(v.shipments, "customer#00000001"), "total_value")
    return rounded(df, "share_pct", digits=6)


add("agg_supplier_shares", _shares, _shares_sql("SELECT sum(total_value) FROM s"))
add("win_share_of_total", _shares, _SUPPLIERS + '''
SELECT supplier, shipments, round(total_value, 2) AS total_value,
  round(coalesce(total_value, 0) / whole * 100, 6) AS share_pct
FROM (SELECT *, sum(total_value) OVER () AS whole FROM s)
ORDER BY coalesce(total_value, 0) DESC, supplier NULLS LAST LIMIT 10''')


@query("agg_hhi", _SUPPLIERS + '''
SELECT count(supplier) AS total_suppliers, round(sum(total_value), 2) AS total_value,
  round(sum(CASE WHEN supplier IS NOT NULL THEN pow(coalesce(total_value, 0)
    / (SELECT sum(total_value) FROM s) * 100, 2) END), 6) AS hhi FROM s''')
def hhi(v: Views) -> DataFrame:
    df = rounded(advanced.concentration(v.shipments, "customer#00000001"), "total_value")
    return rounded(df, "hhi", digits=6)


_STOP = ", ".join("'" + w + "'" for w in advanced.STOPWORDS)
_WORDS = '''WITH w AS (SELECT unnest(regexp_extract_all(lower("Product Description"),
  '[a-zA-Z][a-zA-Z\\-]+')) AS keyword FROM {view}),
c AS (SELECT keyword, count(*) AS occurrences FROM w
  WHERE length(keyword) >= 3 AND keyword NOT IN ({stop}) GROUP BY 1)
'''


def _words_sql(view: str) -> str:
    return _WORDS.replace("{view}", view).replace("{stop}", _STOP)


add("agg_keywords", lambda v: advanced.keywords(v["texts"]),
    _words_sql("texts") + "SELECT * FROM c ORDER BY occurrences DESC, keyword LIMIT 50")
add("agg_keywords_shipments", lambda v: advanced.keywords(v.shipments),
    _words_sql("shipments") + "SELECT * FROM c ORDER BY occurrences DESC, keyword LIMIT 50")
add("agg_keyword_total", lambda v: advanced.keyword_total(v["texts"]),
    _words_sql("texts") + "SELECT count(*) AS total_keywords FROM c")


@query("agg_dataset_stats", '''
SELECT count(*) AS total_rows, min("Date") AS date_min, max("Date") AS date_max,
       count(DISTINCT "Importer") AS distinct_importers,
       count(DISTINCT "Exporter") AS distinct_exporters,
       count(DISTINCT "Supplier") AS distinct_suppliers, count(DISTINCT "HSN") AS distinct_hsn,
       count(DISTINCT coalesce("Origin Country", "Destination Country")) AS distinct_countries
FROM shipments''')
def stats(v: Views) -> DataFrame:
    return a.dataset_stats(v.shipments)


def _counts(name: str, column: str) -> None:
    add(name, lambda v: a.counts_by(v.shipments, column),
        f'''SELECT coalesce(nullif("{column}", ''), 'unknown') AS name, count(*) AS count
FROM shipments GROUP BY 1''')


_counts("agg_by_trade_type", "Trade Type")
_counts("agg_by_chapter", "HS Chapter")
_counts("agg_by_mode", "Mode")


@query("agg_market_coverage", '''
SELECT coalesce("Reporting Country", 'unknown') AS reporting_country, count(*) AS rows,
       min("Date") AS date_min, max("Date") AS date_max FROM shipments GROUP BY 1''')
def coverage(v: Views) -> DataFrame:
    return a.market_coverage(v.shipments)


@query("agg_entity_counts", '''
SELECT "Buyer" AS name, count(*) AS shipments FROM shipments WHERE "Buyer" IS NOT NULL GROUP BY 1''')
def entity_counts(v: Views) -> DataFrame:
    return entities.entity_counts(v.shipments, "Buyer")


@query("agg_trend_pivot", f'''
SELECT {_MONTH}, round(sum(CASE WHEN "Trade Type" = 'EXPORT' THEN "Value" END), 2) AS "EXPORT",
       round(sum(CASE WHEN "Trade Type" = 'IMPORT' THEN "Value" END), 2) AS "IMPORT"
FROM shipments WHERE "Date" IS NOT NULL GROUP BY 1''')
def pivot(v: Views) -> DataFrame:
    return rounded(a.trend_pivot(v.shipments, "Trade Type"), "EXPORT", "IMPORT")


_MONTHS = f'''WITH m AS (SELECT {_MONTH}, coalesce(sum("Value"), 0) AS value
  FROM shipments WHERE "Date" IS NOT NULL GROUP BY 1),
w AS (SELECT *, lag(value) OVER (ORDER BY month) AS previous FROM m)
SELECT month, round(value, 2) AS value, round(previous, 2) AS previous_value,
       round(CASE WHEN previous <> 0 THEN (value - previous) / previous * 100 END, 6) AS change_pct
FROM w'''


def _change(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, "value", "previous_value"), "change_pct", digits=6)


add("agg_mom_change", lambda v: _change(a.month_change(v.shipments)),
    _MONTHS + " ORDER BY month DESC LIMIT 1")
add("win_mom", lambda v: _change(a.month_changes(v.shipments)), _MONTHS)


@query("map_counterparty", '''
SELECT "BE/SB Number" AS id, coalesce("Importer", "Buyer") AS buyer_side,
       coalesce("Supplier", "Exporter") AS seller_side FROM shipments''')
def sides(v: Views) -> DataFrame:
    return counterparties(v.shipments).select(
        F.col("BE/SB Number").alias("id"), F.col("Buyer Side").alias("buyer_side"),
        F.col("Seller Side").alias("seller_side"))


@query("map_list_projection", "SELECT " + ", ".join(f'"{c}"' for c in SHIPMENT_COLUMNS)
       + " FROM repeated")
def projection(v: Views) -> DataFrame:
    return v["repeated"].select(*map(col, SHIPMENT_COLUMNS))


@query("txt_suggest", '''
SELECT DISTINCT "Supplier" AS name FROM shipments WHERE "Supplier" ILIKE '%000004%'
ORDER BY CASE WHEN name ILIKE '000004%' THEN 0 ELSE 1 END, name LIMIT 10''')
def suggest(v: Views) -> DataFrame:
    return entities.suggest(v.shipments, "Supplier", "000004")


@query("txt_suggest_prefix", '''
SELECT DISTINCT "Importer" AS name FROM shipments WHERE "Importer" ILIKE '%customer#0000000%'
ORDER BY name LIMIT 10''')
def suggest_prefix(v: Views) -> DataFrame:
    return entities.suggest(v.shipments, "Importer", "customer#0000000")


def _close(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1))"


def _similar_sql(query_text: str, cutoff: int) -> str:
    return f'''
WITH e AS (SELECT "Importer" AS name, lower("Importer") AS t, '{query_text}' AS q, count(*) AS shipments
           FROM shipments WHERE "Importer" IS NOT NULL GROUP BY 1),
s AS (SELECT *, round(100 * greatest({_close("t", "q")},
  0.95::DOUBLE * {_close("array_to_string(list_sort(string_split(t, ' ')), ' ')", "array_to_string(list_sort(string_split(q, ' ')), ' ')")},
  0.9::DOUBLE * list_max(list_transform(string_split(t, ' '), lambda w: {_close("w", "q")})),
  CASE WHEN contains(t, q) THEN 0.9::DOUBLE ELSE 0 END), 6) AS raw FROM e)
SELECT name, CAST(floor(raw) AS INTEGER) AS score, shipments FROM s WHERE raw >= {cutoff}
ORDER BY raw DESC, name LIMIT 10'''


@query("txt_similar", _similar_sql("custmer#000000042", 70))
def similar(v: Views) -> DataFrame:
    return entities.similar(entities.entity_counts(v.shipments, "Importer"), "Custmer#000000042")


def _index(v: Views) -> name_index.SimilarIndex:
    """The index with its names and grams as written and read back, as they are read several times."""
    names, grams = scratch(v.spark, "names"), scratch(v.spark, "grams")
    write_stage(entities.entity_counts(v.shipments, "Importer"), names)
    counted = v.spark.read.parquet(names)
    write_stage(name_index.gram_rows(counted), grams)
    return name_index.similar_index(counted, v.spark.read.parquet(grams))


add("txt_similar_grams", lambda v: name_index.similar(_index(v), "Custmer#000000042"),
    _similar_sql("custmer#000000042", 70))
add("txt_similar_grams_contained", lambda v: name_index.similar(_index(v), "00000013", cutoff=88),
    _similar_sql("00000013", 88))
add("txt_similar_grams_words", lambda v: name_index.similar(_index(v), "000000007 customer", cutoff=60),
    _similar_sql("000000007 customer", 60))


def _rotated(v: Views, party: str) -> DataFrame:
    """The sorted rotations as written and read back: a range of them is a range of files."""
    path = scratch(v.spark, "rotations")
    write_stage(name_index.rotations(entities.entity_counts(v.shipments, party)), path)
    return v.spark.read.parquet(path)


add("txt_suggest_rotations", lambda v: name_index.suggest(_rotated(v, "Supplier"), "000004"), '''
SELECT DISTINCT "Supplier" AS name FROM shipments WHERE "Supplier" ILIKE '%000004%'
ORDER BY CASE WHEN name ILIKE '000004%' THEN 0 ELSE 1 END, name LIMIT 10''')
add("txt_suggest_rotations_prefix",
    lambda v: name_index.suggest(_rotated(v, "Importer"), "customer#0000000"), '''
SELECT DISTINCT "Importer" AS name FROM shipments WHERE "Importer" ILIKE '%customer#0000000%'
ORDER BY name LIMIT 10''')


# Answers from stored roll-ups and sketches.

def _rollups(v: Views) -> Rollups:
    path, shipments = scratch(v.spark, "rollups"), v.stored_shipments()
    write_rollups(shipments, path)
    return Rollups(shipments, *(v.spark.read.parquet(f"{path}/{n}")
                                  for n in ("rollup_keys", "rollup_parties", "sketches")))


add("agg_monthly_rollup", lambda v: rounded(
    _rollups(v).monthly(ShipmentFilter(trade_type="IMPORT", country="NATION_1"), ("HS Chapter",)), *_SUMS), f'''
SELECT {_MONTH}, "HS Chapter", {_VOLUME} FROM shipments
WHERE "Date" IS NOT NULL AND "Trade Type" = 'IMPORT' AND ("Origin Country" ILIKE '%NATION_1%'
  OR "Destination Country" ILIKE '%NATION_1%' OR "Country" ILIKE '%NATION_1%') GROUP BY 1, 2''')
add("agg_top_importers_rollup", lambda v: rounded(_rollups(v).top_parties(
    ShipmentFilter(importer="0001", date_from=date(1996, 2, 1), date_to=date(1999, 8, 31)), "Importer"), *_SUMS), f'''
SELECT "Importer" AS name, {_VOLUME} FROM shipments WHERE "Importer" ILIKE '%0001%'
  AND "Date" BETWEEN DATE '1996-02-01' AND DATE '1999-08-31'
GROUP BY 1 ORDER BY sum("Value") DESC NULLS LAST, name LIMIT 25''')
add("agg_totals_rollup", lambda v: rounded(rounded(
    _rollups(v).totals(ShipmentFilter(hs_chapter="29")), *_SUMS), "avg_unit_price_usd", digits=4),
    _TOTALS + "\"HS Chapter\" = '29'")


@query("agg_dataset_stats_sketch", '''
SELECT t.name, t.exact, true AS near FROM (
  SELECT 'importers' AS name, count(DISTINCT "Importer") AS exact FROM shipments WHERE "Trade Type" = 'IMPORT'
  UNION ALL SELECT 'suppliers', count(DISTINCT "Supplier") FROM shipments WHERE "Trade Type" = 'IMPORT'
  UNION ALL SELECT 'hsn', count(DISTINCT "HSN") FROM shipments WHERE "Trade Type" = 'IMPORT'
  UNION ALL SELECT 'rows', count(*) FROM shipments WHERE "Trade Type" = 'IMPORT') t''')
def stats_sketch(v: Views) -> DataFrame:
    """Exact counts, and whether the united sketches are within four standard errors of them."""
    f = ShipmentFilter(trade_type="IMPORT")
    stored = _rollups(v)
    exact = a.dataset_stats(f.apply(stored.shipments))
    near = stored.dataset_stats(f)
    names = {"importers": "distinct_importers", "suppliers": "distinct_suppliers", "hsn": "distinct_hsn", "rows": "total_rows"}

    def long(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias(column))
                                            for n, c in names.items()))))
    both = long(exact, "exact").join(long(near, "estimate"), "name")
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.ceil(4 * ERROR * F.col("exact"))
    return both.select("name", "exact", within.alias("near"))


# The saved reports.

add("ex_1", lambda v: saved.by_importer(v.shipments, "00007"), '''
SELECT "Date", "Importer", "Supplier", "Origin Country", "HSN", "Quantity", "Unit", "Value",
       "Currency", "Source File" FROM shipments WHERE "Importer" ILIKE '%00007%'
ORDER BY "Date" DESC NULLS LAST, "Importer" NULLS LAST, "Supplier" NULLS LAST,
  "Origin Country" NULLS LAST, "HSN" NULLS LAST, "Quantity" NULLS LAST, "Unit" NULLS LAST,
  "Value" NULLS LAST, "Currency" NULLS LAST, "Source File" NULLS LAST LIMIT 50''')
add("ex_2", lambda v: saved.by_code(v.shipments, "38000017"), '''
SELECT "Date", "Trade Type", "Importer", "Exporter", "Supplier", "Buyer", "Origin Country",
       "Destination Country", "Value" FROM shipments WHERE "HSN" = '38000017'
ORDER BY "Date" DESC NULLS LAST, "Trade Type" NULLS LAST, "Importer" NULLS LAST,
  "Exporter" NULLS LAST, "Supplier" NULLS LAST, "Buyer" NULLS LAST, "Origin Country" NULLS LAST,
  "Destination Country" NULLS LAST, "Value" NULLS LAST LIMIT 100''')
add("ex_3", lambda v: saved.by_supplier(v.shipments, "0000005"), '''
SELECT "Date", "Importer", "Supplier", "Origin Country", "Product Description", "Quantity", "Value"
FROM shipments WHERE "Supplier" ILIKE '%0000005%' ''')
add("ex_4", lambda v: rounded(saved.country_volume(v.shipments), *_SUMS), f'''
SELECT "HS Chapter", "Trade Type", coalesce("Origin Country", "Destination Country")
       AS counterparty_country, {_VOLUME} FROM shipments GROUP BY 1, 2, 3
ORDER BY sum("Value") DESC NULLS LAST, 1, 2, 3 LIMIT 100''')
for _n, _party, _trade in ((5, "Importer", "IMPORT"), (6, "Exporter", "EXPORT")):
    add(f"ex_{_n}",
        lambda v, p=_party, t=_trade: rounded(saved.top_party(v.shipments, p, t), "total_value"), f'''
SELECT "{_party}", count(*) AS shipments, round(sum("Value"), 2) AS total_value FROM shipments
WHERE "Trade Type" = '{_trade}' AND "{_party}" IS NOT NULL GROUP BY 1
ORDER BY sum("Value") DESC NULLS LAST, 1 LIMIT 20''')
add("ex_7", lambda v: saved.monthly_counts(v.shipments), f'''
SELECT {_MONTH}, "HS Chapter", "Trade Type", count(*) AS shipments FROM shipments
WHERE "Date" IS NOT NULL GROUP BY 1, 2, 3''')
add("ex_8", lambda v: saved.recent_suppliers(v.shipments, "000001", date(1999, 1, 1)), '''
SELECT DISTINCT "Supplier", "Origin Country" FROM shipments
WHERE "Importer" ILIKE '%000001%' AND "Date" >= DATE '1999-01-01' ''')
