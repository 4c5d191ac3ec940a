"""Ledger, market and registration rules on literal rows."""
import pytest
from pyspark.sql import functions as F

from cargolake.functions.classify import category
from cargolake.functions.vocabulary import INGREDIENTS, default_vocabulary, name_key, to_english, vocabulary
from cargolake.operators import agbio, argentina as ar, registration as reg


@pytest.mark.parametrize("product,ai,conc,form,want", [
    (None, None, None, "technical", "Technical"), (None, "a + b", None, "Technical", "Technical"),
    ("X TC", None, None, " Formulation ", "Formulation"),
    (None, None, None, "ACTIVE CONSTITUENT", "Technical"), ("Foo tech", "a", None, None, "Technical"),
    (None, "a+b", None, None, "Formulation"), (None, "a", None, "sc", "Formulation"),
    (None, "a", None, "Concentración emulsionable", "Formulation"), (None, "a", "480 g/L", None, "Formulation"),
    (None, "a 1,5 kg / l", None, None, "Formulation"), (None, "a 95,5 %", None, None, "Technical"),
    (None, "a 89 %", None, None, "Unknown"), (None, "a", "900 g/kg", None, "Technical"),
    (None, "a", "899 g/kg", None, "Unknown"), ("techno", "a", None, "scx", "Unknown"),
    (None, None, None, None, "Unknown"), ("", "", "", "", "Unknown"),
])
def test_category(spark, product, ai, conc, form, want):
    df = spark.createDataFrame([(product, ai, conc, form)], "p string, a string, c string, f string")
    assert df.select(category(*map(F.col, "pacf"))).first()[0] == want


ENGLISH = {
    "ABAMECTINA 8,4%": "Abamectin 8,4%",
    "IMAZAPIC 52,5%, IMAZAPIR 17,5%": "Imazapic 52,5%, Imazapyr 17,5%",
    "Glifosato (sal) 48 %;": "Glyphosate 48 %", "metalaxil-m + MANCOZEB": "Metalaxyl-M + Mancozeb",
    "metalaxil 5": "Metalaxyl 5", "Clorpirifós": "Chlorpyrifos", "klorpirifos metil": "Chlorpyrifos metil",
    "clorpirifos metil": "Chlorpyrifos-methyl", "parakuat diklorida setara dengan 276": "Paraquat dichloride 276",
    "hidróxido de cobre": "Copper hydroxide", "xglifosato": None, "glifosato2": None, "unknown": None,
    "": None, "2,4-D Dimetilamina": "2,4 2,4-D", "espinosad/azufre": "Spinosad/Sulphur",
}


def test_english_names(spark):
    df = spark.createDataFrame([(k,) for k in ENGLISH], "v string")
    assert {r[0]: r[1] for r in df.select("v", to_english(F.col("v"))).collect()} == ENGLISH
    joined = reg.attach_english(df.withColumnRenamed("v", "active_ingredient").union(
        spark.createDataFrame([(None,)], "v string")))
    got = {r["active_ingredient"]: r["active_ingredient_en"] for r in joined.collect()}
    assert got == {**ENGLISH, None: None}


def test_vocabulary_rules(spark):
    table = default_vocabulary()
    assert set(table) == {name_key(v) for n, own in INGREDIENTS.items() for v in (n, *own)}
    assert len(set(table.values())) == 139 and table["sulfur"] == "Sulphur"
    own = vocabulary([("agua bendita", "Holy water")])
    df = spark.createDataFrame([("Agua bendita 5%",), ("glifosato",)], "v string")
    unlisted = spark.createDataFrame([("Glifosate 48%",), ("Tebuconazola",)], "v string")
    assert [r[0] for r in unlisted.select(to_english(F.col("v"))).collect()] == [None, None]
    assert [r[0] for r in df.select(to_english(F.col("v"), own)).collect()] == ["Holy water 5%", None]


def test_registry_mapping(spark):
    tc = spark.createDataFrame([(" Nom ", "Glyphosate", "95 %", "", "7")],
                               "`Nombre` string, `Product (English)` string, `Concentración` string, "
                               "`Empresa` string, `N° Registro` string")
    row = reg.map_registry(tc, "Argentina_TC ").first().asDict()
    assert (row["country"], row["product"], row["company"], row["formulation_type"], row["registration_no"]) == (
        "Argentina", "Nom", None, "Technical", "7")
    assert row["source_sheet"] == "Argentina_TC" and row["raw_json"].startswith('{"Nombre":" Nom "')
    with pytest.raises(KeyError):
        reg.map_registry(tc, "Atlantis")
    with pytest.raises(ValueError):
        reg.load({"Atlantis": tc})
    full = reg.load({"Argentina_TC": tc}).first()
    assert full["category"] == "Technical" and full["ai_search"] == "glyphosate glyphosate"
    assert len(reg.REGISTRIES) == 21 and all(set(v) <= set(reg.TARGETS) for v in reg.REGISTRIES.values())
    assert reg.country_name("south africa") == "South Africa"


def test_registration_negatives_keep_missing_names(spark):
    df = spark.createDataFrame([("a", "glyphosate"), (None, None)], "active_ingredient string, ai_search string")
    df = df.withColumn("active_ingredient_en", F.lit(None).cast("string"))
    for cond, n in (("notcontains|gly", 1), ("notequals|A", 1), ("contains|GLY-", 1), ("odd|x", 2)):
        assert reg.RegistrationFilter(ai=[cond]).apply(df).count() == n


def test_details(spark):
    df = spark.createDataFrame([("1", '{"a":"x","b":" ","c":"y"}'), ("2", None)], "id string, raw_json string")
    assert sorted(map(tuple, reg.details(df).collect())) == [("1", "a", "x"), ("1", "c", "y")]


def test_ledger_load_and_search(spark):
    raw = spark.createDataFrame([("2020-01-31 00:00:00", "ACME", "1,000", "5", None, "z")],
                                "`Date` string, `Importer` string, `Cantidad` string, `FOB Total USD` string, "
                                "`Quarter` string, `Otra` string")
    row = ar.load(raw, F.lit("f.csv")).first().asDict()
    assert str(row.pop("date")) == "2020-01-31"
    assert row == {"importer": "ACME", "quantity": None, "fob_total_usd": 5.0, "destination_country": "ARGENTINA",
                   "trade_type": "IMPORT", "source_file": "f.csv"}
    assert ar.search_terms("a  b AND c and d") == (["a  b", "c", "d"], "and")
    assert ar.search_terms("x and y OR z") == (["x and y", "z"], "or")
    assert ar.search_terms("and x") == (["and x"], "and") and ar.search_terms(" ") == ([], "and")
    text = str(ar.term_search("a AND b or c"))
    assert "%a AND b%" in text and "%c%" in text and ar.term_search("  ") is None


def test_market_sort_falls_back(spark):
    cells = {**{k: "x" for k in agbio.KEYS}, **{c: "1" for c in agbio.CROPS}, "total_usd_m": "14"}
    raw = spark.createDataFrame([tuple(cells[c] for c in agbio.COLUMNS)], [*agbio.COLUMNS])
    df = agbio.load(raw, F.lit("m.csv"))
    assert agbio.list_rows(df, "cereals").first()["total_usd_m"] == 14.0
    assert agbio.MarketFilter(q="X", country="x").apply(df).count() == 1
