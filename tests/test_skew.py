"""A third of all rows share one key: results stay whole and match a plain count."""
import collections

import pytest
from pyspark.sql import functions as F

from cargolake.operators import advanced, analytics as a, cleaning as c, entities
from cargolake.schema import SHIPMENT_COLUMNS, SHIPMENT_SCHEMA
from support import plan

ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """Every third row is a copy of one shipment, spread over 40 files."""
    copy = F.col("id") % 3 == 0
    own = F.col("id").cast("string")
    made = {"Importer": F.when(copy, "HOT CO").otherwise(F.concat(F.lit("CO "), own)),
            "Supplier": F.when(copy, "HOT SUPPLIER").otherwise(F.concat(F.lit("S "), F.col("id") % 7)),
            "HSN": F.when(copy, "38089999").otherwise(F.lpad(own, 8, "0")), "Value": F.lit(2.0),
            "Quantity": F.lit(1.0), "Product Description": F.when(copy, "hot herbicide").otherwise(
                F.concat(F.lit("item k"), F.lpad(F.col("id") % 5, 3, "q"))),
            "Trade Type": F.lit("IMPORT"), "Origin Country": F.when(copy, "CHINA").otherwise("PERU"),
            "Date": F.lit("2024-05-01").cast("date"),
            "Source File": F.concat(F.lit("f"), F.lpad((F.col("id") % 40).cast("string"), 2, "0"))}
    types = {f.name: f.dataType for f in SHIPMENT_SCHEMA}
    return spark.range(0, ROWS, 1, 8).select(
        *(made.get(n, F.lit(None)).cast(types[n]).alias(n) for n in SHIPMENT_COLUMNS)).cache()


def test_dedupe(hot):
    kept = c.dedupe_across_files(hot)
    assert kept.count() == ROWS * 2 // 3 + 1
    assert kept.filter("Importer = 'HOT CO'").first()["Source File"] == "f00"


def test_repeats_within_files(hot):
    assert c.drop_repeats(hot).filter("Importer = 'HOT CO'").count() == 40


def test_duplicates(hot):
    rows = advanced.duplicates(hot).collect()
    assert {r["occurrences"] for r in rows} == {ROWS // 3} and len(rows) == 40


def test_roll_ups(hot):
    top = a.top_parties(hot, "Importer", 1).first()
    assert (top["name"], top["shipments"], top["total_value"]) == ("HOT CO", ROWS // 3, ROWS * 2 / 3)
    code = a.by_hsn(hot, 1).first()
    assert (code["hsn"], code["shipments"], code["top_importer"]) == ("38089999", ROWS // 3, "HOT CO")
    by_country = {r["country"]: r["unique_importers"] for r in a.by_country(hot).collect()}
    assert by_country == {"CHINA": 1, "PERU": ROWS * 2 // 3}
    shares = advanced.supplier_shares(hot, "co", 1).first()
    assert shares["supplier"] == "HOT SUPPLIER" and shares["share_pct"] == pytest.approx(100 / 3)


def test_keywords(hot):
    want = collections.Counter()
    for i in range(ROWS):
        want.update(["hot", "herbicide"] if i % 3 == 0 else ["item", "k" + str(i % 5).rjust(3, "q")[:2]])
    got = {r["keyword"]: r["occurrences"] for r in advanced.keywords(hot).collect()}
    assert got["hot"] == got["herbicide"] == ROWS // 3 and got["item"] == want["item"]


def test_names(hot):
    assert entities.entity_counts(hot, "Importer").filter("name = 'HOT CO'").first()["shipments"] == ROWS // 3
    assert entities.suggest(hot, "Importer", "hot").first()["name"] == "HOT CO"


def test_every_grouping_combines_before_its_shuffle(hot):
    for df in (a.top_parties(hot, "Importer"), a.monthly(hot), advanced.keyword_counts(hot), a.market_coverage(hot),
               entities.entity_counts(hot, "Supplier"), c.drop_repeats(hot)):
        text = plan(df)
        first = text.rindex("Exchange hashpartitioning")
        assert "HashAggregate" in text[first:]


def test_no_large_explicit_broadcast(hot):
    hinted = "ResolvedHint (strategy=broadcast)"
    for df in (advanced.duplicates(hot), a.by_hsn(hot)):
        assert hinted not in df._jdf.queryExecution().analyzed().toString()
