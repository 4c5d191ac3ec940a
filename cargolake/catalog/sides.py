"""Import ledger, market values and product registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vocabulary import to_english
from ..operators import agbio, argentina as ar, registration as reg
from ..plans import sides
from ..session import scratch
from ..sources.feeds import read_csv
from ..sources.writers import export_ledger, write_csv
from .feeds import market_files
from .filters import order_sql
from .registry import add, query, rounded
from .views import Views

# Import ledger.


@query("map_argentina", '''
SELECT date, CAST(CAST(year AS BIGINT) AS DOUBLE) AS year, importer, origin_country, type,
  active_ingredient, brand, formulation, CASE WHEN quantity <= 40 THEN quantity END AS quantity,
  fob_total_usd, transport, 'ARGENTINA' AS destination_country, 'IMPORT' AS trade_type,
  'ledger.csv' AS source_file FROM ledger''')
def load_ledger(v: Views) -> DataFrame:
    return ar.load(v["raw_ledger"], F.lit("ledger.csv"))


_LEDGER = "date, importer, origin_country, type, active_ingredient_en, quantity, fob_total_usd"


def _ledger(name: str, f: ar.LedgerFilter, where: str) -> None:
    add(name, lambda v: f.apply(v["ledger"]).select(*_LEDGER.split(", ")),
        f"SELECT {_LEDGER} FROM ledger WHERE {where}")


def _any(text: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{text}%'" for c in ar.SEARCH_COLUMNS) + ")"


_ledger("flt_arg_terms", ar.LedgerFilter(q="ring AND nation_3"), f"{_any('ring')} AND {_any('nation_3')}")
_ledger("flt_arg_terms_or", ar.LedgerFilter(q="brand#13 or tecnico AND x"),
        f"{_any('brand#13')} OR {_any('tecnico AND x')}")
_ledger("flt_arg_fields", ar.LedgerFilter(
    type="TECNICO", importer="00001", origin_country="nation_1", active_ingredient="SAL DE",
    date_from="1997-01-01", date_to="1999-12-31"), '''
type = 'TECNICO' AND importer ILIKE '%00001%' AND origin_country ILIKE '%nation_1%'
AND (active_ingredient_en ILIKE '%sal de%' OR active_ingredient ILIKE '%sal de%')
AND date >= DATE '1997-01-01' AND date <= DATE '1999-12-31' ''')
_ledger("flt_arg_year", ar.LedgerFilter(year=1998), "year = 1998")
_ledger("flt_arg_ai_ops", ar.LedgerFilter(
    ai=("contains|ring", "notcontains|small", "notequals|red ring", "unknown|x", "equals|")), '''
(active_ingredient_en ILIKE '%ring%' OR active_ingredient ILIKE '%ring%')
AND (coalesce(active_ingredient_en, '') NOT ILIKE '%small%' AND coalesce(active_ingredient, '') NOT ILIKE '%small%')
AND (coalesce(lower(active_ingredient_en), '') <> 'red ring' AND coalesce(lower(active_ingredient), '') <> 'red ring')''')
_ledger("flt_arg_ai_ops_or", ar.LedgerFilter(
    ai=("equals|SMALL RING", "equals|sal de red widget"), ai_join="or"), '''
lower(active_ingredient_en) IN ('small ring', 'sal de red widget')
OR lower(active_ingredient) IN ('small ring', 'sal de red widget')''')

add("map_list_projection_ledger", lambda v: v["ledger"].select(*ar.LIST_COLUMNS),
    f"SELECT {', '.join(ar.LIST_COLUMNS)} FROM ledger")
add("srt_arg_page", lambda v: ar.list_rows(v["ledger"], "cif_total_usd", "asc", 2),
    f'''SELECT {', '.join(ar.LIST_COLUMNS)} FROM ledger
{order_sql(ar.LIST_COLUMNS, "cif_total_usd", "ASC")} LIMIT 50 OFFSET 50''')
_EXPORTED = [c for c in ar.EXPORT_COLUMNS if not c.endswith("_usd") and c not in ("quantity", "year")]


def exported(v: Views, rows: DataFrame) -> DataFrame:
    """The download is written and read back; numbers are left out, engines print them differently."""
    path = scratch(v.spark, "ledger-export")
    export_ledger(rows, path, "no such column", cap=5000)
    df = read_csv(v.spark, [path])
    return df.withColumnRenamed("\ufeffdate", "date").select(*_EXPORTED)


add("snk_argentina_export",
    lambda v: exported(v, ar.LedgerFilter(type="FORMULADO").apply(v["ledger"])),
    f'''SELECT {', '.join(f"CAST({c} AS STRING) AS {c}" for c in _EXPORTED)} FROM ledger WHERE type = 'FORMULADO'
{order_sql(ar.EXPORT_COLUMNS, "date")} LIMIT 5000''')
add("agg_arg_stats", lambda v: rounded(ar.stats(v["ledger"]), "total_cif_usd"), '''
SELECT count(*) AS total_rows, count(DISTINCT importer) AS distinct_importers,
  count(DISTINCT origin_country) AS distinct_origin_countries, min(date) AS date_min,
  max(date) AS date_max, round(sum(cif_total_usd), 2) AS total_cif_usd FROM ledger''')
for _name, _column, _fn in (("origins", "origin_country", ar.top_origins),
                            ("ingredients", "active_ingredient_en", ar.top_ingredients)):
    add(f"agg_arg_top_{_name}", lambda v, fn=_fn: fn(v["ledger"]), f'''
SELECT {_column} AS name, count(*) AS count FROM ledger WHERE {_column} IS NOT NULL GROUP BY 1
ORDER BY count DESC, name LIMIT 10''')
add("agg_arg_top_importers", lambda v: rounded(ar.top_importers(v["ledger"]), "cif_total_usd"), '''
SELECT importer AS name, round(coalesce(sum(cif_total_usd), 0), 2) AS cif_total_usd FROM ledger
WHERE importer IS NOT NULL GROUP BY 1 ORDER BY sum(cif_total_usd) DESC NULLS LAST, name LIMIT 10''')
add("agg_arg_type_breakdown", lambda v: ar.type_breakdown(v["ledger"]),
    "SELECT type AS code, count(*) AS count FROM ledger GROUP BY 1")


@query("agg_arg_totals", '''
SELECT count(*) AS count, round(sum(quantity), 2) AS total_quantity,
  round(sum(fob_total_usd), 2) AS total_fob_usd, round(sum(cif_total_usd), 2) AS total_cif_usd,
  round(avg(fob_unit_usd), 4) AS avg_unit_fob_usd, round(avg(cif_unit_usd), 4) AS avg_unit_cif_usd
FROM ledger WHERE importer ILIKE '%00002%' ''')
def ledger_totals(v: Views) -> DataFrame:
    df = rounded(ar.totals(ar.LedgerFilter(importer="00002").apply(v["ledger"])),
                 "total_quantity", "total_fob_usd", "total_cif_usd")
    return rounded(df, "avg_unit_fob_usd", "avg_unit_cif_usd", digits=4)


# Market values.


@query("map_agbio", f"SELECT {', '.join(agbio.COLUMNS)}, 'market.csv' AS source_file FROM market")
def load_market(v: Views) -> DataFrame:
    raw = v["market"].select(*(F.concat(F.lit(" "), F.col(k), F.lit(" ")).alias(k)
                               for k in agbio.KEYS),
                             *(F.col(c).cast("string").alias(c)
                               for c in (*agbio.CROPS, "total_usd_m")))
    return agbio.load(raw, F.lit("market.csv"))


_MARKET = "product, type, country, total_usd_m"


def _market(name: str, f: agbio.MarketFilter, where: str) -> None:
    add(name, lambda v: f.apply(v["market"]).select(*_MARKET.split(", ")),
        f"SELECT {_MARKET} FROM market WHERE {where}")


_market("flt_agbio", agbio.MarketFilter(q="nation_1", product="brand#2", type="large"), '''
(product ILIKE '%nation_1%' OR country ILIKE '%nation_1%' OR type ILIKE '%nation_1%')
AND product ILIKE '%brand#2%' AND type ILIKE '%large%' ''')
_market("flt_agbio_country", agbio.MarketFilter(country="nation_2"), "country ILIKE '%nation_2%'")
add("map_list_projection_market", lambda v: v["market"].select(*agbio.COLUMNS),
    f"SELECT {', '.join(agbio.COLUMNS)} FROM market")
add("srt_agbio_page", lambda v: agbio.list_rows(v["market"], "cereals"),
    f'''SELECT {', '.join(agbio.COLUMNS)} FROM market
{order_sql(agbio.COLUMNS, "total_usd_m")} LIMIT 50''')
add("agg_agbio_stats", lambda v: rounded(agbio.stats(v["market"]), "total_value_usd_m", digits=4), '''
SELECT count(*) AS total_rows, count(DISTINCT product) AS distinct_products,
  count(DISTINCT country) AS distinct_countries, round(sum(total_usd_m), 4) AS total_value_usd_m
FROM market''')


def _top_sql(name: str, where: str = "true") -> str:
    return f'''SELECT {name} AS name, round(coalesce(sum(total_usd_m), 0), 4) AS total_usd_m
FROM market WHERE {where} GROUP BY 1 ORDER BY sum(total_usd_m) DESC NULLS LAST, name NULLS LAST LIMIT 10'''


for _name in ("product", "country"):
    add(f"agg_agbio_top_{_name}",
        lambda v, n=_name: rounded(agbio.top_by(v["market"], n), "total_usd_m", digits=4), _top_sql(_name))
add("agg_agbio_type_breakdown", lambda v: agbio.type_breakdown(v["market"]),
    "SELECT type AS code, count(*) AS count FROM market GROUP BY 1")
_FOCUS = "country ILIKE '%nation_1%'"
add("agg_agbio_breakdown", lambda v: rounded(agbio.breakdown(
    agbio.MarketFilter(country="nation_1").apply(v["market"])), "total_usd_m", digits=4), f'''
SELECT 'product' AS ranking, * FROM ({_top_sql("product", _FOCUS)})
UNION ALL SELECT 'country', * FROM ({_top_sql("country", _FOCUS)})''')


# Registrations.

def registrations(v: Views) -> DataFrame:
    return reg.load({"Turkey ": v["raw_turkey"], "ECUADOR": v["raw_ecuador"],
                     "Unknown land": v["raw_turkey"]})


_LABELLED = '''trim(regexp_replace(regexp_replace(regexp_replace("Composición de Producto",
    'ingrediente activo', '', 'gi'), 'aditivo de importancia toxicol[oó]gica', '', 'gi'), '\\s{2,}', ' ', 'g'), ' ,')'''
_TURKEY_FIELDS = ("License No", "Plant Protection Product", "Active Ingredient", "Licensed Company",
                  "License Status", "Formulation", "Remark")
_ECUADOR_FIELDS = ("N° de Registro", "Nombre Comercial", "Composición de Producto",
                   "Fabricante / Formulador", "Estado", "Formulación")


def _json_sql(fields) -> str:
    return "'{' || concat_ws(',', " + ", ".join(
        f"'\"{f}\":' || CAST(to_json(\"{f}\") AS VARCHAR)" for f in fields) + ") || '}'"


_REGISTERED = f'''
WITH r AS (
  SELECT {_json_sql(_TURKEY_FIELDS)} AS raw_json, 'Turkey' AS country, nullif(trim("Plant Protection Product"), '') AS product,
    nullif(trim("Active Ingredient"), '') AS active_ingredient, NULL::VARCHAR AS concentration,
    nullif(trim("Licensed Company"), '') AS company, "License Status" AS status,
    "License No" AS registration_no, nullif(trim("Formulation"), '') AS formulation_type,
    NULL::VARCHAR AS origin, 'Turkey' AS source_sheet FROM raw_turkey
  UNION ALL
  SELECT {_json_sql(_ECUADOR_FIELDS)}, 'Ecuador', "Nombre Comercial", nullif({_LABELLED}, ''), NULL, "Fábrica", "Estado",
    "N° de Registro", "Formulación", NULL, 'ECUADOR'
  FROM (SELECT *, "Fabricante / Formulador" AS "Fábrica" FROM raw_ecuador))
'''
_ENGLISH = '''CASE
    WHEN active_ingredient LIKE 'GLIFOSATO%' THEN 'Glyphosate 48%'
    WHEN active_ingredient LIKE 'Imidacloprid%' THEN 'Imidacloprid + Abamectin'
    WHEN active_ingredient LIKE 'IMAZAPIC%' THEN 'Imazapic 52,5%, Imazapyr 17,5%'
    WHEN active_ingredient LIKE 'Clorpir%' THEN 'Chlorpyrifos 480 g/l'
    WHEN active_ingredient LIKE '2,4-D%' THEN '2,4 2,4-D 720 g / l'
    WHEN active_ingredient LIKE 'Tebukonazol%' THEN 'Tebuconazole 95,5 %'
    WHEN active_ingredient LIKE 'azufre%' THEN 'Sulphur 800 g/kg'
    WHEN active_ingredient LIKE 'oxicloruro%' THEN 'Copper oxychloride 950 g/kg'
    WHEN active_ingredient LIKE 'Lambda%' THEN 'Lambda-cyhalothrin; Metalaxyl-M'
    WHEN active_ingredient LIKE 'MANCOZEB%' THEN 'Mancozeb 80 %'
    WHEN active_ingredient LIKE 'cimoxanilo%' THEN 'Cymoxanil 8 %, Mancozeb 64 %' END'''
_CATEGORY = '''CASE
    WHEN formulation_type IN ('technical', 'ACTIVE CONSTITUENT') OR product LIKE '% TC' THEN 'Technical'
    WHEN contains(active_ingredient, '+') THEN 'Formulation'
    WHEN formulation_type IN ('EC', 'WP', 'Wettable Powder', 'Concentrado emulsionable', 'Suspensión')
      THEN 'Formulation'
    WHEN active_ingredient LIKE '%480 g/L' OR active_ingredient LIKE '%720 g / l' THEN 'Formulation'
    WHEN active_ingredient LIKE '%95,5 _%' OR active_ingredient LIKE '%950 g/kg' THEN 'Technical'
    ELSE 'Unknown' END'''
_SQUASH = "nullif(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]', '', 'g'), '')"
_FULL = _REGISTERED.rstrip() + f''',
e AS (SELECT *, {_ENGLISH} AS active_ingredient_en, {_CATEGORY} AS category FROM r),
g AS (SELECT *, nullif(concat_ws(' ', {_SQUASH.replace("{c}", "active_ingredient_en")},
        {_SQUASH.replace("{c}", "active_ingredient")}), '') AS ai_search FROM e)
'''
_COMMON = "country, registration_no, product, active_ingredient, company, status, formulation_type"

for _name, _columns in (
        ("src_multi_registry", f"{_COMMON}, concentration, origin, source_sheet"),
        ("map_registration", _COMMON), ("map_blank_null", "registration_no, active_ingredient, company"),
        ("map_strip_labels", "registration_no, active_ingredient"),
        ("drv_category", "registration_no, category"),
        ("drv_ai_search", "registration_no, ai_search")):
    _where = " WHERE country = 'Ecuador'" if _name == "map_strip_labels" else ""
    add(_name, lambda v, c=_columns, w=_where: (
        registrations(v).filter("country = 'Ecuador'" if w else "true").select(*c.split(", "))),
        _FULL + f"SELECT {_columns} FROM g{_where}")


def _mapped(v: Views) -> DataFrame:
    return reg.map_registry(v["raw_turkey"], "Turkey").unionByName(
        reg.map_registry(v["raw_ecuador"], "Ecuador"))


_NAMES = _FULL + "SELECT registration_no, active_ingredient_en FROM g"
add("drv_ai_english", lambda v: _mapped(v).select(
    "registration_no", to_english(F.col("active_ingredient")).alias("active_ingredient_en")), _NAMES)
add("join_dict_back", lambda v: reg.attach_english(_mapped(v)).select(
    "registration_no", "active_ingredient_en"), _NAMES)


add("map_row_json", lambda v: _mapped(v).select("registration_no", "raw_json"),
    _FULL + "SELECT registration_no, raw_json FROM g")


def _field_sql(view: str, key: str, fields) -> str:
    return " UNION ALL ".join(
        f"SELECT \"{key}\" AS registration_no, '{f}' AS field, \"{f}\" AS value FROM {view} "
        f"WHERE trim(\"{f}\") <> ''" for f in fields)


add("map_json_details", lambda v: reg.details(_mapped(v).select("registration_no", "raw_json")),
    _field_sql("raw_turkey", "License No", _TURKEY_FIELDS) + " UNION ALL "
    + _field_sql("raw_ecuador", "N° de Registro", _ECUADOR_FIELDS))


def _registered(name: str, f: reg.RegistrationFilter, where: str) -> None:
    add(name, lambda v: f.apply(registrations(v)).select("country", "registration_no", "product"),
        _FULL + f"SELECT country, registration_no, product FROM g WHERE {where}")


_registered("flt_registration", reg.RegistrationFilter(
    q="2,4-D", product="r", category="Formulation", ai=("notcontains|mancozeb", "notequals|x")), '''
(product ILIKE '%2,4-D%' OR company ILIKE '%2,4-D%' OR ai_search LIKE '%24d%') AND product ILIKE '%r%'
AND category = 'Formulation' AND coalesce(ai_search, '') NOT LIKE '%mancozeb%' ''')
_registered("flt_registration_ai", reg.RegistrationFilter(
    country="Turkey", company="firma", ai=("contains|Glyphosate", "equals|GLIFOSATO 48%",
                                          "equals|imidacloprid + abamectin"), ai_join="or"), '''
country = 'Turkey' AND company ILIKE '%firma%' AND (ai_search LIKE '%glyphosate%'
OR lower(active_ingredient) = 'glifosato 48%' OR lower(active_ingredient_en) = 'imidacloprid + abamectin')''')
_registered("flt_registration_ingredient", reg.RegistrationFilter(active_ingredient="Lambda Cialotrina"),
            "ai_search LIKE '%lambdacialotrina%'")

_LISTED = ", ".join(reg.LIST_COLUMNS)
add("map_list_projection_registration",
    lambda v: registrations(v).select(*reg.LIST_COLUMNS), _FULL + f"SELECT {_LISTED} FROM g")
add("srt_reg_page", lambda v: reg.list_rows(registrations(v), "registration_no", "desc", 2, 100),
    _FULL + f'''SELECT {_LISTED} FROM g
{order_sql(reg.LIST_COLUMNS, "registration_no")} LIMIT 100 OFFSET 100''')
add("agg_reg_stats", lambda v: reg.stats(registrations(v)), _FULL + '''
SELECT count(*) AS total_rows, count(DISTINCT country) AS distinct_countries,
  count(DISTINCT active_ingredient) AS distinct_active_ingredients FROM g''')
add("agg_reg_country_counts", lambda v: reg.country_counts(registrations(v)), _FULL + '''
SELECT country AS name, count(*) AS count FROM g WHERE country IS NOT NULL GROUP BY 1''')
add("agg_reg_breakdown", lambda v: reg.breakdown(
    reg.RegistrationFilter(category="Formulation").apply(registrations(v))), _FULL + '''
SELECT country AS name, count(*) AS count FROM g WHERE category = 'Formulation' GROUP BY 1''')
add("agg_reg_breakdown_totals", lambda v: reg.breakdown_totals(
    reg.RegistrationFilter(active_ingredient="mancozeb").apply(registrations(v))), _FULL + '''
SELECT count(*) AS total, count(DISTINCT country) AS distinct_countries FROM g
WHERE ai_search LIKE '%mancozeb%' ''')


# Batch plans: the feeds as files, the table read back.

_LEDGER_SQL = '''
SELECT date, CAST(CAST(year AS BIGINT) AS DOUBLE) AS year, importer, origin_country, type,
  CASE WHEN quantity <= 40 THEN quantity END AS quantity, fob_total_usd, transport,
  'ARGENTINA' AS destination_country, 'IMPORT' AS trade_type, 'ledger.csv' AS source_file FROM ledger'''


@query("plan_ledger", _LEDGER_SQL)
def plan_ledger(v: Views) -> DataFrame:
    source = scratch(v.spark, "ledger-csv")
    write_csv(v["raw_ledger"], source)
    df = sides.build_ledger(v.spark, source, scratch(v.spark, "ledger"), "ledger.csv")
    return df.select("date", "year", "importer", "origin_country", "type", "quantity", "fob_total_usd",
                     "transport", "destination_country", "trade_type", "source_file")


@query("plan_market", f"SELECT {', '.join(agbio.COLUMNS)}, 'market.csv' AS source_file FROM market")
def plan_market(v: Views) -> DataFrame:
    return sides.build_market(v.spark, market_files(v), scratch(v.spark, "market"), "market.csv")


@query("plan_registrations", _FULL + f"SELECT {_COMMON}, category, active_ingredient_en, ai_search FROM g")
def plan_registrations(v: Views) -> DataFrame:
    sources = {"Turkey": scratch(v.spark, "turkey"), "Ecuador": scratch(v.spark, "ecuador")}
    for name, path in sources.items():
        write_csv(v[f"raw_{name.lower()}"], path)
    df = sides.build_registrations(v.spark, sources, scratch(v.spark, "registrations"))
    return df.select(*_COMMON.split(", "), "category", "active_ingredient_en", "ai_search")


_COVERED = '''substr("HSN", 1, 2) IN ('29', '38') AND CAST("Date" AS STRING) >= '1999-06-01' '''


def _prepared(v: Views) -> tuple[DataFrame, DataFrame]:
    source = scratch(v.spark, "overlap-csv")
    write_csv(v.shipments, source, compression="gzip")
    return sides.prepare_overlap(v.spark, source, scratch(v.spark, "overlap"), "1999-06-01")


add("plan_overlap", lambda v: _prepared(v)[0].select(
    F.col("BE/SB Number").alias("id"), F.col("HSN").alias("hsn"), F.col("Date").alias("date")),
    f'''SELECT "BE/SB Number" AS id, "HSN" AS hsn, CAST("Date" AS STRING) AS date FROM shipments
WHERE NOT ({_COVERED})''')
add("plan_overlap_audit", lambda v: _prepared(v)[1], f'''
SELECT substr("HSN", 1, 2) AS chapter, count(*) AS excluded FROM shipments WHERE {_COVERED} GROUP BY 1''')
